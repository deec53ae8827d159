"""Quality: a linear-chain conditional random field labels every line of a document good or bad.

A line is described by binned statistics of itself and of its neighbours; two states and their transitions are
trained in numpy from document labels (all lines of a document start with its label; lines of bad documents that look
good by themselves are relabelled before the chain is fitted).  A document's quality is the mean of
its lines' forward-backward marginals weighted by length, put on a probability scale by a logistic fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U64, labelled_sample, mix64, slices, word_hashes, word_spans
from docloom.llm.toxicity import _platt, _sigmoid

#: Upper bounds of the bins of each statistic.
BINS = {
    "upper": (0.02, 0.06, 0.12, 0.3, 0.6),
    "bang": (0.01, 0.1, 0.3, 0.7),
    "pipe": (0.01, 0.1, 0.3, 0.7),
    "symbol": (0.01, 0.05, 0.2, 0.5),
    "digit": (0.01, 0.05, 0.15, 0.4),
    "distinct": (0.2, 0.4, 0.6, 0.75, 0.9, 0.999),
    "again": (0.001, 0.05, 0.2, 0.5),
    "word": (2.5, 3.5, 4.5, 5.5, 7, 9, 14),
    "length": (20, 60, 150, 400, 1000, 4000),
    "copies": (0.001, 0.1, 0.3, 0.6),
    "whole": (0.2, 0.4, 0.6, 0.75, 0.9),
    "end": (0.5,),
}
SLOTS = [len(b) + 1 for b in BINS.values()]
BASE = np.r_[0, np.cumsum(SLOTS)]
WIDE = int(BASE[-1])
EDGE = 3 * WIDE  # first and last line, then the bias
DIMS = EDGE + 3


def _share(hashes: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each group."""
    o = np.lexsort((hashes, group))
    h, g = hashes[o], group[o]
    new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(g[new], minlength=n)


def lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active features of each non-blank line (rows of indices), the line's length, and each text's first line."""
    not_break = np.ones(256, bool)
    not_break[10] = False
    s, e, _ = word_spans(buf, off, not_break)
    ws, we, _ = word_spans(buf, off)
    n_words = np.searchsorted(ws, e) - np.searchsorted(ws, s)
    s, e = s[n_words > 0], e[n_words > 0]
    first = np.searchsorted(s, off)
    n = len(s)
    if not n:
        return np.zeros((0, 0), np.int64), np.zeros(0), first
    line = np.searchsorted(s, ws, "right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    size = (e - s).astype(float)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return (c[e] - c[s]).astype(float)

    latin = np.zeros(len(buf), bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    upper = ((buf >= 65) & (buf <= 90)) | latin
    alpha = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 0xC0)
    digit = (buf >= 48) & (buf <= 57)
    odd = np.zeros(256, bool)
    odd[[ord(c) for c in "#$%&*@<>{}[]\\^~=_+/"]] = True
    h = word_hashes(buf, ws, we)
    text_of_line = np.repeat(np.arange(len(off) - 1), np.diff(first))
    per_text = np.maximum(1, np.bincount(text_of_line[line], minlength=len(off) - 1))
    whole = _share(h, text_of_line[line], len(off) - 1) / per_text
    again = np.r_[False, (h[1:] == h[:-1]) & (line[1:] == line[:-1])]
    lh = mix64(np.add.reduceat(mix64(h + (np.arange(len(h)) - np.searchsorted(line, line)).astype(U64) * U64(0x9E3779B97F4A7C15)), np.searchsorted(line, np.arange(n))))
    o = np.lexsort((lh, text_of_line))
    new = np.r_[True, (lh[o][1:] != lh[o][:-1]) | (text_of_line[o][1:] != text_of_line[o][:-1])]
    run = np.cumsum(new) - 1
    times = np.empty(n)
    times[o] = np.bincount(run)[run]
    lines_in = np.diff(first)[text_of_line]
    last = buf[we[np.searchsorted(line, np.arange(n), "right") - 1] - 1]
    stats = {
        "upper": count(upper) / np.maximum(1, count(alpha)),
        "bang": count(buf == 33) / words,
        "pipe": count(buf == 124) / words,
        "symbol": count(odd[buf]) / words,
        "digit": count(digit) / size,
        "distinct": _share(h, line, n) / words,
        "again": np.bincount(line[again], minlength=n) / words,
        "word": np.bincount(line, (we - ws).astype(float), n) / words,
        "length": size,
        "copies": (times - 1) / np.maximum(1, lines_in),
        "whole": whole[text_of_line],
        "end": np.isin(last, [46, 33, 63]).astype(float),
    }
    own = np.stack([BASE[k] + np.searchsorted(b, stats[name]) for k, (name, b) in enumerate(BINS.items())], 1)
    is_first = np.zeros(n, bool)
    is_first[first[:-1][np.diff(first) > 0]] = True
    is_last = np.r_[is_first[1:], True]
    none = np.full((1, own.shape[1]), -1)
    before = np.where(is_first[:, None], -1, np.concatenate([none, own[:-1]]))
    after = np.where(is_last[:, None], -1, np.concatenate([own[1:], none]))
    pad = DIMS  # the index of a weight that is always zero
    parts = [own, np.where(before < 0, pad, before + WIDE), np.where(after < 0, pad, after + 2 * WIDE), np.where(is_first, EDGE, pad)[:, None], np.where(is_last, EDGE + 1, pad)[:, None], np.full((n, 1), EDGE + 2)]
    return np.concatenate(parts, 1), size, first


def marginals(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions, and the log partition function, over chains side by side.

    ``score`` is a line's log odds of good before its chain is looked at; ``trans`` the 2 x 2 log potentials (bad 0, good 1).
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    start, count = first[:-1][order], n[order]
    emit = np.exp(np.clip(np.stack([-score / 2, score / 2], 1), -30, 30))
    t = np.exp(trans)
    alpha, norm = np.empty_like(emit), np.empty(len(emit))
    live = len(order)
    longest = int(count[0]) if live else 0
    lives = []
    for k in range(longest):
        while live and count[live - 1] <= k:
            live -= 1
        lives.append(live)
        i = start[:live] + k
        a = emit[i] * (alpha[i - 1] @ t if k else 1.0)
        norm[i] = a.sum(1)
        alpha[i] = a / norm[i][:, None]
    beta = np.ones_like(emit)
    pairs = np.zeros((2, 2))
    for k in range(longest - 2, -1, -1):
        i = start[: lives[k + 1]] + k
        ahead = emit[i + 1] * beta[i + 1] / norm[i + 1][:, None]
        beta[i] = ahead @ t.T
        pairs += np.einsum("na,nb->ab", alpha[i], ahead) * t
    p = alpha * beta
    used = np.log(norm).sum() if len(norm) else 0.0
    return p[:, 1] / p.sum(1) if len(p) else np.zeros(0), pairs, float(used)


@dataclass
class Model:
    weight: np.ndarray  # DIMS values and a zero
    trans: np.ndarray
    scale: tuple[float, float]


def _fit_chain(feat: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    w, trans = np.zeros(DIMS + 1), np.zeros((2, 2))
    inside = np.ones(len(y), bool)
    inside[first[:-1][np.diff(first) > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inside) - 1].astype(int), y[inside].astype(int)), 1)
    m, v = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    flat = feat.ravel()
    for step in range(1, steps + 1):
        p, pairs, _ = marginals(w[feat].sum(1), trans, first)
        d = (y - p) * share
        g = [np.bincount(flat, np.repeat(d, feat.shape[1]), DIMS + 1) / len(y) - 1e-4 * w, (seen - pairs) / len(y) - 1e-3 * trans]
        g[0][-1] = 0
        for k, x in enumerate((w, trans)):
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            x += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
        w[-1] = 0
    return w, trans


def _aggregate(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal of each text; 0 for a text without lines."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.bincount(text, size, len(first) - 1)
    g = np.where(total > 0, np.bincount(text, p * size, len(first) - 1) / np.maximum(total, 1), 0.5)
    g = np.clip(g, 1e-3, 1 - 1e-3)
    return np.log(g / (1 - g))


def train(texts: list[str], y: np.ndarray) -> Model:
    """Without rows of both classes the model gives the share of label 1 (a half if no rows)."""
    enc = [(t or "").encode() for t in texts]
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(DIMS + 1), np.zeros((2, 2)), (0.0, float(np.log(p / (1 - p)))))
    feat, size, first = [], [], [0]
    for e in enc:
        f, s, b = lines(np.frombuffer(e, np.uint8), np.array([0, len(e)]))
        if len(s):
            feat.append(f)
            size.append(s)
        first.append(first[-1] + len(s))
    feat, size, first = np.concatenate(feat), np.concatenate(size), np.array(first)
    text = np.repeat(np.arange(len(y)), np.diff(first))
    label = y[text]
    share = np.minimum(4.0, 0.5 + size / 200)
    # lines by themselves first: one that looks like those of good documents is good in a bad document too
    own = [k for k, name in enumerate(BINS) if name not in ("whole", "copies")]
    alone = feat[:, [*own, feat.shape[1] - 1]]
    each = np.arange(len(label) + 1)
    w, trans = _fit_chain(alone, each, label, share)
    p, _, _ = marginals(w[alone].sum(1), trans, each)
    worst = np.full(len(y), 2.0)
    np.minimum.at(worst, text, p)
    again = np.where((label == 0) & (p > 0.5) & (p > worst[text]), 1.0, label)
    w, trans = _fit_chain(feat, first, again, share)
    p, _, _ = marginals(w[feat].sum(1), trans, first)
    return Model(w, trans, _platt(_aggregate(p, size, first), y))


def score_texts(m: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    feat, size, first = lines(buf, off)
    z = np.zeros(len(off) - 1)
    if len(size):
        p, _, _ = marginals(m.weight[feat].sum(1), m.trans, first)
        z = _aggregate(p, size, first)
    return _sigmoid(m.scale[0] * z + m.scale[1])


def label_lines(m: Model, text: str) -> list[tuple[str, float]]:
    """The non-blank lines of one text with their probability of being good."""
    e = text.encode()
    feat, _, first = lines(np.frombuffer(e, np.uint8), np.array([0, len(e)]))
    p = marginals(m.weight[feat].sum(1), m.trans, first)[0] if len(feat) else []
    return list(zip([x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")], map(float, p)))


def scores(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score``, the probability of good quality; without its text unless ``keep_text``.

    Whole texts are read; a null or empty text, or one of blank lines only, gets the score of no evidence.  Rows stay,
    repeated ones too; a column named ``score`` is replaced.  One narrow pass; the model broadcast is a few kB.
    """
    keep = [c for c in docs.columns if c != "score" and (keep_text or c != text)]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty(b.num_rows)
            for a, z, buf, off in slices(b, "__text"):
                out[a:z] = score_texts(shared.value, buf, off)
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), pa.array(out)], [*keep, "score"])

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "score double"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, bound: int = 3000) -> Model:
    """Learn ``labels.quality`` from at most ``bound`` documents outside the held-out fold."""
    texts, y, _ = labelled_sample(docs, labels, "quality", modulus, held_out, bound)
    return train(texts, y)
