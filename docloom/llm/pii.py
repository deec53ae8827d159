"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans, which always stay.  The network finds what the patterns can't: the same four kinds in
forms that they don't take, such as addresses with a written "at" and "dot", numbers with other separators or without a
plus sign, and two numbers side by side that a greedy pattern joins and then drops.  It reads every text from end to end,
in pieces that overlap, leaving out only pieces in which no span could pass the test below; it is trained in numpy from the base spans of a bounded sample (windows around digits, at-signs and
bracketed "at" and "dot") and from labelled spans planted in lines of the sample's words, among look-alikes that are none.
Pieces are decoded by Viterbi, and their spans are reconciled over the whole text: among overlapping proposals that count the
one deepest inside its piece wins, base spans win over all.  A span that the network proposes counts if it is certain enough
and if, with separators and brackets taken out, it has the content of its kind (``well_formed``).
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_rows, stored, trim_memory

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only start where a run of digits does, which the lookbehind says for the sake of very long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What windows to learn from are cut around.
_DIGIT = re.compile(r"[0-9@]|[\[({<] ?(?:[aA][tT]|[dD][oO][tT])\b")
_NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    d = _NOT_DIGIT.sub("", s)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping pattern matches per kind, failing ones dropped; by kind as in KINDS, then start."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:  # a match holds one at-sign and all that may stand before it
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for kind, rx in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, m.start(), m.end()) for m in rx.finditer(text) if _valid(kind, m.group())]
    return out


_AT = re.compile(r" *[\[({<] *at *[\])}>] *| +at +| *@ *", re.I)
_DOT = re.compile(r" *[\[({<] *(?:dot|\.) *[\])}>] *| +dot +| *\. *", re.I)
_SEPARATED = {"ip": re.compile(r"[0-9 .,\[\](){}-]*"), "card": re.compile(r"[0-9 ./_-]*"), "phone": re.compile(r"[+0-9 ./()_-]*")}


def well_formed(kind: str, s: str) -> bool:
    """Whether ``s`` has the content of its kind once separators and written-out signs are undone."""
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", s, count=1))
        return len(s) <= 80 and _EMAIL.fullmatch(plain) is not None and plain.rpartition(".")[2].isalpha()
    if not _SEPARATED[kind].fullmatch(s):
        return False
    parts = [p for p in _NOT_DIGIT.split(s) if p]
    if kind == "ip":
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    d = "".join(parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and (s[0] in "+(" or d[0] == "0")


#: No span is ``well_formed`` without one of these: its digits, or what ``_AT`` takes (of whose spaces one is enough).
_SIGN = re.compile(r"[0-9@]|[\[({<] *at *[\])}>]| at ", re.I)


# --- the network -----------------------------------------------------------------------------

WINDOW, STEP, REACH = 96, 64, 24  # of what is learned from
READ, OVERLAP = 1024, 128  # of what is read
HIDDEN, EMBED = 24, 12
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@.+-()_%\"'=:/, \n"
_CODE = {c: i + 2 for i, c in enumerate(_CHARS)}
SYMBOLS = len(_CHARS) + 2  # 0 pads, 1 is any other character


def _codes(text: str) -> np.ndarray:
    return np.array([_CODE.get(c, 1) for c in text], np.int64)


@dataclass
class Model:
    p: dict[str, np.ndarray]
    sure: float = 0.8


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {
        "E": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "V": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)),
        "W": rng.normal(0, 0.25, (2, EMBED, 4 * HIDDEN)), "U": rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)),
        "a": np.tile(np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)], (2, 1, 1)),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


#: Sigmoids are taken as tanh of half the argument, so that one call serves all four gates.
_HALF = np.r_[np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)
_SHIFT = np.r_[np.full(3 * HIDDEN, 0.5), np.zeros(HIDDEN)].astype(np.float32)


def _lstm(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple]:
    """Outputs (time x direction x batch x HIDDEN, each direction in its own reading order) and what the backward pass needs."""
    n, _, b, _ = x.shape
    pre = (x @ p["W"] + p["a"]) * _HALF
    u = p["U"] * _HALF
    h, c = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
    gates = np.empty((n, 2, b, 4 * HIDDEN), np.float32)
    out, cell, tanh = (np.empty((n, 2, b, HIDDEN), np.float32) for _ in range(3))
    for t in range(n):
        z = h @ u
        z += pre[t]
        np.tanh(z, out=z)
        z *= _HALF
        z += _SHIFT
        gates[t] = z
        c = z[..., HIDDEN : 2 * HIDDEN] * c
        c += z[..., :HIDDEN] * z[..., 3 * HIDDEN :]
        cell[t] = c
        np.tanh(c, out=tanh[t])
        h = z[..., 2 * HIDDEN : 3 * HIDDEN] * tanh[t]
        out[t] = h
    return out, (gates, cell, tanh)


def _lstm_back(dout: np.ndarray, x: np.ndarray, out: np.ndarray, kept: tuple, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> np.ndarray:
    gates, cell, tanh = kept
    n, _, b, _ = x.shape
    before = np.concatenate([np.zeros_like(cell[:1]), cell[:-1]])
    i, f, o, k = (gates[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
    # what each gate's share of the cell's and the output's change is multiplied with, for all times at once
    by_cell = np.concatenate([k * i * (1 - i), before * f * (1 - f), np.zeros_like(o), i * (1 - k**2)], -1)
    by_out = tanh * o * (1 - o)
    into = o * (1 - tanh**2)
    back = np.swapaxes(p["U"], 1, 2)
    dz = np.empty_like(gates)
    dh, dc = np.zeros_like(out[0]), np.zeros_like(out[0])
    for t in range(n - 1, -1, -1):
        dh = dh + dout[t]
        dc = dc + dh * into[t]
        z = dz[t]
        np.multiply(np.concatenate([dc] * 4, -1), by_cell[t], out=z)
        z[..., 2 * HIDDEN : 3 * HIDDEN] = dh * by_out[t]
        dh = z @ back
        dc = dc * f[t]
    prev = np.concatenate([np.zeros_like(out[:1]), out[:-1]])
    flat = lambda v: np.swapaxes(v, 0, 1).reshape(2, n * b, -1)
    g["W"] = np.swapaxes(flat(x), 1, 2) @ flat(dz)
    g["U"] = np.swapaxes(flat(prev), 1, 2) @ flat(dz)
    g["a"] = flat(dz).sum(1, keepdims=True)
    return dz @ np.swapaxes(p["W"], 1, 2)


def _emissions(codes: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple]:
    one = p["E"][codes.T]
    x = np.stack([one, one[::-1]], 1)
    out, kept = _lstm(x, p)
    h = np.concatenate([out[:, 0], out[::-1, 1]], 2)
    return h @ p["V"] + p["c"], (x, h, out, kept)


def _crf(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals time x batch x tag, expected transitions, and log partition functions.

    Forward and backward weights are kept as probabilities, scaled to 1 at each time.
    """
    n = len(e)
    top = e.max(2, keepdims=True)
    w, m = np.exp(e - top), trans.max()
    move = np.exp(trans - m)
    a, b, scale = np.empty_like(w), np.ones_like(w), np.empty(w.shape[:2], w.dtype)
    for t in range(n):
        x = w[t] if t == 0 else (a[t - 1] @ move) * w[t]
        scale[t] = x.sum(1)
        a[t] = x / scale[t][:, None]
    ahead = np.empty_like(w[1:])
    for t in range(n - 2, -1, -1):
        ahead[t] = w[t + 1] * b[t + 1] / scale[t + 1][:, None]
        b[t] = ahead[t] @ move.T
    pairs = move * (a[:-1].reshape(-1, len(trans)).T @ ahead.reshape(-1, len(trans)))
    return a * b, pairs, np.log(scale).sum(0) + top[..., 0].sum(0) + m * (n - 1)


def _viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, b, _ = e.shape
    best, back = e[0], np.zeros(e.shape, np.int64)
    for t in range(1, n):
        s = best[:, :, None] + trans
        back[t] = s.argmax(1)
        best = e[t] + s.max(1)
    tags = np.zeros((n, b), np.int64)
    tags[-1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t][np.arange(b), tags[t]]
    return tags


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows to learn from, which cover all characters within REACH of a sign of ``_DIGIT``.

    Only the sample for learning is cut so; the fitted network reads all of every text (``pieces``).
    """
    out: list[int] = []
    end = 0
    for m in _DIGIT.finditer(text):
        if m.start() + REACH < end and out:
            continue
        lo = max(0, m.start() - REACH) if not out or m.start() - REACH > out[-1] + STEP else out[-1] + STEP
        out.append(lo)
        end = lo + WINDOW
    return out


def _plant(rng: np.random.Generator, words: list[str], unseen: bool = False) -> tuple[str, list[Span]]:
    """A line of the sample's words with planted spans, plain and disguised, and look-alikes that are none.

    ``unseen`` takes disguises that are never trained on, for measuring how the network carries over.
    """
    pick = lambda: words[int(rng.integers(len(words)))] if words else "x"
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    one = lambda *c: c[int(rng.integers(len(c)))]
    name = lambda: "".join(c for c in pick().lower() if c in _LOCAL and c.isalpha()) or "a"
    parts: list[tuple[str, str | None]] = [(pick(), None) for _ in range(int(rng.integers(2, 9)))]
    for _ in range(int(rng.integers(1, 4))):
        k = int(rng.integers(0, 14))
        if k < 3:  # e-mail
            kind, at, dot = "email", "@", "."
            if k:
                at, dot = one(("{at}", "."), (" <at> ", " <dot> "), ("(AT)", "(DOT)")) if unseen else one((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("(at)", "."), (" [at] ", "."), (" @ ", " . "), (" @ ", "."), (" AT ", " DOT "), (" [AT] ", "."))
            own = name() + one("", f".{name()}", f".{num(2)}", num(int(rng.integers(1, 4))))
            if "@" not in at and not at.strip().isalpha():
                own = own.replace(".", one(".", dot))
            s = own + at + name() + one("", num(1)) + one("", f"{dot}example", f"{dot}mail") + dot + one("com", "org", "net", "de", "info")
            if at == " AT " and not any(c in "0123456789" for c in s):
                s = num(2) + s
            if not well_formed("email", s):
                continue
        elif k < 5:
            kind = "ip"
            sep = one(".", " . ", "[.]", ". ", " .") if k == 3 else "."
            s = one(" [.] ", "(.)").join(str(int(x)) for x in rng.integers(0, 256, 4)) if unseen and k == 3 else sep.join(str(int(x)) for x in rng.integers(0, 256, 4))
        elif k < 8:
            d = num(int(rng.integers(12, 19)))
            d += next(c for c in "0123456789" if luhn(d + c))
            kind, step = "card", one(4, 4, 4, 5, 6)
            cut = [d[i : i + step] for i in range(0, len(d), step)]
            s = d if k == 5 else one(" / ", "__", ". ").join(cut) if unseen and k == 7 else one(" ", "-").join(cut) if k == 6 else one(".", "/", "  ", " - ", "_", "--").join(cut)
        elif k < 11:
            kind = "phone"
            plain = (f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}")
            odd = (f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} / {num(6)}", f"00{num(2)} {num(3)} {num(6)}", f"+{num(2)}/{num(3)}/{num(6)}", f"0{num(2)}-{num(4)}-{num(4)}", f"({num(3)}) {num(3)} {num(4)}")
            s = one(*plain) if k == 8 else one(f"0{num(3)}_{num(6)}", f"+{num(2)} / {num(3)} / {num(5)}", f"(0{num(2)}){num(7)}") if unseen else one(*odd)
            if not well_formed("phone", s):
                continue
        else:
            kind = None
            bad = num(15)
            bad += next(c for c in "0123456789" if not luhn(bad + c))
            s = one(
                num(int(rng.integers(1, 9))), f"{pick()}={hashlib.md5(num(4).encode()).hexdigest()[:18]}", f'"{hashlib.sha1(num(5).encode()).hexdigest()}"', f"AKIA{num(3)}XQZ{num(4)}",
                f"{num(1)}.{num(1)}.", f"{num(2)}:{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(1)}.{num(2)}", bad, f"{num(3)},{num(3)},{num(3)}", f"{num(2)}. {num(2)}. {num(4)}",
                f"({num(4)})", f"[{num(2)}]", f"{num(4)} - {num(4)}", f"{pick()} at {pick()}. {pick()}", f"{pick()} ({one('at', 'dot')} {pick()} {pick()})", f"{num(2)}, {num(2)}, {num(2)}, {num(2)}", f"{num(2)} {num(2)} {num(2)}", num(12),
            )
        at = int(rng.integers(len(parts) + 1))
        parts.insert(at, (s, kind))
    text, spans = "", []
    for s, kind in parts:
        text += one(" ", " ", " ", "\n") if text else ""
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s
        text += one("", "", "", ",", ".") if kind else ""
    return text, spans


def _sample(texts: list[str], rng: np.random.Generator, most: int, vocabulary: int = 20_000) -> tuple[list[tuple[str, list[Span]]], list[str]]:
    """At most ``most`` windows, labelled by their base spans, and some words, both drawn from all of ``texts``."""
    cuts = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    examples: list[tuple[str, list[Span]]] = []
    words: list[str] = []
    at, spans = -1, []
    for j in np.sort(rng.permutation(len(cuts))[:most]):
        i, s = cuts[j]
        if i != at:
            at, spans = i, base_spans(texts[i])
        cut = texts[i][s : s + WINDOW]
        examples.append((cut, [(k, max(0, a - s), min(len(cut), b - s)) for k, a, b in spans if a < s + WINDOW and b > s]))
    for t in texts:
        own = t.split()
        words += [own[j] for j in rng.permutation(len(own))[: max(1, vocabulary // len(texts))]]
    return examples, words


def train(texts: list[str], seed: int = 4, steps: int = 800, batch: int = 48, most: int = 3000) -> Model:
    """Fit on at most ``most`` windows of ``texts`` labelled by their base spans, and as many planted lines."""
    rng = np.random.default_rng(seed)
    examples, words = _sample(texts, rng, most)
    examples += [_plant(rng, words) for _ in range(max(1500, len(examples)))]
    p = _start(rng)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    for step in range(1, steps + 1):
        own = [examples[int(i)] for i in rng.integers(0, len(examples), batch)]
        codes, gold = np.zeros((batch, WINDOW), np.int64), np.zeros((WINDOW, batch), np.int64)
        for j, (text, spans) in enumerate(own):
            c = _codes(text[:WINDOW])
            codes[j, : len(c)] = c
            for kind, a, b in spans:
                k = 1 + 2 * KINDS.index(kind)
                gold[a : min(b, WINDOW), j] = k + 1
                if a < WINDOW:
                    gold[a, j] = k
        e, (x, h, out, kept) = _emissions(codes, p)
        q, pairs, _ = _crf(e, p["T"])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        de = q.copy()
        de[np.arange(WINDOW)[:, None], np.arange(batch)[None], gold] -= 1
        de /= batch
        g["T"] = pairs / batch
        np.add.at(g["T"], (gold[:-1].ravel(), gold[1:].ravel()), -1 / batch)
        g["V"], g["c"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), de.sum((0, 1))
        dh = de @ p["V"].T
        dx = _lstm_back(np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]], 1), x, out, kept, p, g)
        both = (dx[:, 0] + dx[::-1, 1]).reshape(-1, EMBED)
        hot = np.zeros((len(both), SYMBOLS), np.float32)
        hot[np.arange(len(both)), codes.T.ravel()] = 1
        g["E"] = hot.T @ both
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * 0.5 ** (3 * step / steps)
        for k, v in p.items():
            d = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m, s = state[k]
            m += 0.1 * (d - m)
            s += 0.005 * (d * d - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-8)
    return Model(p)


def pieces(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the pieces in which a text of n characters is read: all of it, each piece overlapping the next."""
    return [(a, min(n, a + READ)) for a in range(0, max(1, n - OVERLAP), READ - OVERLAP)] if n else []


def _read(codes: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """The emissions (time x batch x tag) of ``_emissions``, without what only learning needs.

    Twice the outputs are carried, and gates without their halves, so that fewer passes over them are needed.
    """
    b, n = codes.shape
    table = (p["E"] @ p["W"] + p["a"]) * _HALF
    u, v = p["U"] * _HALF * np.float32(0.5), (p["V"] * np.float32(0.5)).reshape(2, HIDDEN, TAGS)
    e = np.empty((n, b, TAGS), np.float32)
    e[:] = p["c"]
    h, c = np.zeros((2, b, HIDDEN), np.float32), np.zeros((2, b, HIDDEN), np.float32)
    z, one = np.empty((2, b, 4 * HIDDEN), np.float32), np.ascontiguousarray(codes.T)
    for t in range(n):
        np.matmul(h, u, out=z)
        z[0] += table[0][one[t]]
        z[1] += table[1][one[n - 1 - t]]
        np.tanh(z, out=z)
        z[..., : 3 * HIDDEN] += 1
        c *= z[..., HIDDEN : 2 * HIDDEN]
        c += z[..., :HIDDEN] * z[..., 3 * HIDDEN :]
        c *= np.float32(0.5)
        np.multiply(np.tanh(c), z[..., 2 * HIDDEN : 3 * HIDDEN], out=h)
        e[t] += h[0] @ v[0]
        e[n - 1 - t] += h[1] @ v[1]
    return e


def _not_plain(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which sequences of a batch have a better path than the one without any span: Viterbi's scores, less that path's."""
    w = np.ascontiguousarray((e - e[..., :1]).transpose(0, 2, 1))
    step = (trans - trans[0, 0])[:, :, None]
    best = w[0]
    for t in range(1, len(w)):
        best = (best[:, None] + step).max(0)
        best += w[t]
    return np.flatnonzero((best > 0).any(0))


def _may_hold(text: str, a: int, z: int) -> bool:
    """Whether a span that counts could lie in a piece, or a part of it that leads to one."""
    return _SIGN.search(text, a, z) is not None


def _network_spans(model: Model, texts: list[str], base: list[list[Span]], block: int = 256) -> list[list[Span]]:
    """Spans that count in the reconciled pieces of each text, those deepest inside a piece first.

    A span counts if it is ``well_formed``, isn't cut out of a longer run of letters or digits, and overlaps no base span; others
    are dropped before the pieces are reconciled, so that none stands in the way of one that counts.
    A span that a piece's edge may have cut, and that is too long to be whole in the next piece, is read again in a piece of
    twice the length round it, if what was seen of it holds a sign; of any span that counts, some piece shows such a part.
    So a piece without any sign neither gives a span nor has anything read again, whatever the network says of it, and
    leaving it out can't change the result.
    """

    def counts(i: int, kind: str, a: int, b: int) -> bool:
        t = texts[i]
        free = not (a and t[a - 1].isalnum()) and not (b < len(t) and t[b].isalnum())
        return free and well_formed(kind, t[a:b]) and all(b <= y or z <= a for _, y, z in base[i])

    todo = [(i, a, z) for i, t in enumerate(texts) for a, z in pieces(len(t)) if _may_hold(t, a, z)]
    done = set(todo)
    got: list[set[tuple[int, Span]]] = [set() for _ in texts]
    while todo:
        todo.sort(key=lambda x: x[2] - x[1])
        more: list[tuple[int, int, int]] = []
        for first in range(0, len(todo), block):
            own = todo[first : first + block]
            codes = np.zeros((len(own), max(WINDOW, own[-1][2] - own[-1][1])), np.int64)
            for j, (i, a, z) in enumerate(own):
                codes[j, : z - a] = _codes(texts[i][a:z])
            e = _read(codes, model.p)
            some = _not_plain(e, model.p["T"])
            if not len(some):
                continue
            tags, (q, _, _) = _viterbi(e[:, some], model.p["T"]), _crf(e[:, some], model.p["T"])
            for j, k0 in enumerate(some):
                i, s, z = own[k0]
                n, at = z - s, np.flatnonzero(tags[:, j])
                at, t = at[at < n], 0
                for t0 in at.tolist():
                    if t0 < t:
                        continue
                    k, t = int(tags[t0, j]), t0 + 1
                    kind = (k - 1) // 2
                    while t < n and tags[t, j] == 2 + 2 * kind:
                        t += 1
                    inside = (t0 > 0 or s == 0) and (t < n or z == len(texts[i]))
                    if not inside and t - t0 >= OVERLAP and _SIGN.search(texts[i], s + t0, s + t):
                        wide = (i, max(0, s - n // 2), min(len(texts[i]), z + n // 2))
                        if wide not in done:
                            done.add(wide)
                            more.append(wide)
                    elif inside and k % 2 == 1 and float(q[np.arange(t0, t), j, tags[t0:t, j]].min()) >= model.sure and counts(i, KINDS[kind], s + t0, s + t):
                        got[i].add((-min(t0, n - t), (KINDS[kind], s + t0, s + t)))
        todo = more
    out = []
    for found in got:
        kept: list[Span] = []
        for _, x in sorted(found):
            if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
                kept.append(x)
        out.append(kept)
    return out


def find_spans(model: Model | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: these and the network's that overlap none of them.

    A span of the network must be ``well_formed`` and must not be cut out of a longer run of letters or digits.
    """
    base = [base_spans(t) for t in texts]
    extra = _network_spans(model, texts, base) if model is not None else [[] for _ in texts]
    order = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(b + x, key=lambda s: (order[s[0]], s[1]))) for b, x in zip(base, extra)]


def _show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans_of(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_email, n_ip, n_card, n_phone (all spans), base_sha256 and spans.

    Offsets are code points, ends exclusive.  Null counts as empty: no spans, the digest of the empty string.
    Rows stay, repeated ones too; clashing columns are replaced.  One narrow pass over whole texts.
    """
    new = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")
    keep = [c for c in docs.columns if c not in (*new, text)]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for a in range(0, b.num_rows, 500):
                texts = [t or "" for t in b.column(b.num_columns - 1).slice(a, 500).to_pylist()]
                for base, every in find_spans(shared.value, texts):
                    count = [sum(s[0] == k for s in every) for k in KINDS]
                    rows.append((*count, hashlib.sha256(_show(base).encode()).hexdigest(), _show(every)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], [*keep, *new])

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``<kind>``; where spans overlap, the union is replaced under
    the first one's kind.  Null texts stay null.  A column ``n_chars``, if there is one, is brought up to date."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = list(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str, spans: list[Span]) -> str:
        out, at = [], 0
        for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [t[at:a], f"<{k}>"]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index(text)
            texts = b.column(at).to_pylist()
            done: list[str | None] = []
            for a in range(0, len(texts), 500):
                part = texts[a : a + 500]
                done += [None if t is None else clean(t, every) for t, (_, every) in zip(part, find_spans(shared.value, [t or "" for t in part]))]
            cols = list(b.columns)
            cols[at] = pa.array(done, b.schema.field(at).type)
            yield pa.record_batch(cols, names)
            trim_memory()

    out = docs.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kind.items()))
    return out.withColumn("n_chars", F.length(text).cast(kind["n_chars"])) if "n_chars" in names and text in names else out


def fit(docs: DataFrame, bound: int = 4000, max_bytes: int = 16 << 20, text: str = "text") -> Model:
    """Learn from at most ``bound`` documents, and ``max_bytes`` of text, that hold what a window is read around: those
    whose texts have the smallest hashes.

    Only hashes and lengths are sorted; the chosen hashes (32 kB) are broadcast to pick the texts.  The fitted model is
    stored under the digest of these hashes, and the same sample gives the same model back without training.  A sample
    without any text gives a model learned from planted lines alone.
    """
    t = F.col(text).cast("string")
    some = docs.select(t.alias("t"), F.xxhash64(t).alias("h")).where(F.col("t").rlike("[0-9@]|[\\[({<] ?(?:[aA][tT]|[dD][oO][tT])\\b"))
    chosen = [r["h"] for r in bounded_rows(some.select("h", F.octet_length("t").alias("size")).distinct(), "h", bound, max_bytes)]

    def learn() -> bytes:
        pick = docs.sparkSession.createDataFrame([(h,) for h in chosen], "h long")
        rows = some.join(F.broadcast(pick), "h").dropDuplicates(["h"]).orderBy("h").select("t")
        raw = io.BytesIO()
        np.savez(raw, **train([r.t for r in rows.toLocalIterator()]).p)
        return raw.getvalue()

    key = hashlib.sha256(f"{chosen} {WINDOW} {STEP} {REACH} {HIDDEN} {EMBED}".encode()).hexdigest()[:24]
    with np.load(io.BytesIO(stored(docs.sparkSession, f"pii-{key}", learn))) as z:
        return Model({k: z[k] for k in z.files})
