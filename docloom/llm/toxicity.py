"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters and digits, A-Z in lower case) are hashed into rows of one embedding table, one row for the
word and one for each of its first 4, 5 and 6 bytes, so that inflected forms share what they have in common; the sum
of the rows stands for the word.  Filters of widths 1, 2 and 3 slide over the text, their rectified outputs are max-pooled over
the whole text, and a logistic layer reads the pooled values.  A held-back part of the training rows calibrates the
score and sets a decision threshold for each language; the language never enters the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ALNUM, U64, labelled_sample, mix64, slices, word_hashes, word_spans

DIM, FILTERS, WIDTHS, LOG_ROWS = 8, 8, (1, 2, 3), 18
PREFIXES = (4, 5, 6)
MIN_DOCS = 3
PAD = max(WIDTHS)  # rows after each text, so that no window that counts reaches into the next one


@dataclass
class Model:
    embed: np.ndarray  # 2**LOG_ROWS + 1 rows, the last one zero for padding
    conv: np.ndarray  # DIM x (FILTERS * sum(WIDTHS))
    bias: np.ndarray  # FILTERS * len(WIDTHS)
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of every word, with PAD padding rows after each text; and where each text starts."""
    start, end, first = word_spans(buf, off, ALNUM)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    at = np.arange(len(start)) + PAD * text
    begin = first[:-1] + PAD * np.arange(len(off) - 1)
    rows = np.full((len(start) + PAD * (len(off) - 1), 1 + len(PREFIXES)), 1 << LOG_ROWS, np.int32)
    for k, n in enumerate((None, *PREFIXES)):
        h = mix64(word_hashes(buf, start, end if n is None else np.minimum(end, start + n), lower=True), 3 + k)
        rows[at, k] = (h >> U64(64 - LOG_ROWS)).astype(np.int32)
    return rows, begin


def _convolve(m: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = m.embed[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        x += m.embed[rows[:, k]]
    c = x @ m.conv
    out = np.empty((len(rows), FILTERS * len(WIDTHS)), np.float32)
    col = 0
    for k, w in enumerate(WIDTHS):
        s = c[:, col : col + FILTERS].copy()
        for j in range(1, w):
            s[:-j] += c[j:, col + j * FILTERS : col + (j + 1) * FILTERS]
        out[:, k * FILTERS : (k + 1) * FILTERS] = s
        col += w * FILTERS
    return x, out


def _pool(out: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Maxima over the windows that start at each text's words or at its first padding row, which sees only zeros."""
    end = np.r_[begin[1:], len(out)] - PAD + 1
    return np.maximum.reduceat(out, np.stack([begin, end], 1).ravel(), axis=0)[::2]


def logits(m: Model, rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    _, out = _convolve(m, rows)
    return np.maximum(_pool(out, begin) + m.bias, 0) @ m.out + m.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit, by Newton steps with a ridge towards (1, 0)."""
    w = np.array([1.0, 0.0])
    x = np.c_[z, np.ones(len(z))]
    for _ in range(50):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + 8.0 * (w - [1, 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 8.0 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(w[0], 0.05)), float(w[1])


def best_threshold(p: np.ndarray, y: np.ndarray, default: float) -> float:
    """The threshold of greatest F1, midway to the next score; ``default`` if either class has under 10 rows."""
    if y.sum() < 10 or (1 - y).sum() < 10:
        return default
    o = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ps = p[o]
    last = np.r_[ps[1:] < ps[:-1], True]
    k = int(np.where(last, f1, -1).argmax())
    return float((ps[k] + (ps[k + 1] if k + 1 < len(ps) else 0)) / 2)


def train(texts: list[str], y: np.ndarray, langs: list[str | None], seed: int = 7, batch: int = 32, visits: int = 16_000, epochs: int | None = None) -> Model:
    """Fit on whole texts, in as many epochs as make ``visits`` of rows (8 to 60) unless told.  Without rows of both classes
    the model gives the share of label 1 (a half if no rows)."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, ((1 << LOG_ROWS) + 1, DIM)).astype(np.float32)
    embed[-1] = 0
    n_out = FILTERS * len(WIDTHS)
    m = Model(embed, rng.normal(0, 0.4, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32), np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), 0.0)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        m.out[:] = 0
        m.shift = float(np.log(p / (1 - p)))
        return m
    enc = [tokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for t in texts]
    # a row that fewer than MIN_DOCS texts use says nothing about the next text: it stays zero
    used = np.zeros(len(embed), np.int32)
    for e in enc:
        used[np.unique(e)] += 1
    live_rows = used >= MIN_DOCS
    live_rows[-1] = False
    embed[~live_rows] = 0
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    if y[fit].max() == y[fit].min() or y[held].max() == y[held].min():
        held = fit = order
    pos, neg = fit[y[fit] == 1], fit[y[fit] == 0]
    m.shift = float(np.log(len(pos) / len(neg)))
    # a start that few rows can learn from: one dimension holds each row's smoothed log odds, one narrow filter reads it
    odds = np.zeros((2, len(embed)))
    for i in fit:
        odds[int(y[i]), np.unique(enc[i])] += 1
    lead = np.log((odds[1] + 0.5) / (len(pos) + 1)) - np.log((odds[0] + 0.5) / (len(neg) + 1))
    embed[live_rows, 0] = 0.1 * np.clip(lead[live_rows], -4, 6)
    m.conv[:, 0], m.conv[0, 0], m.out[0], m.bias[0] = 0, 1.0, 3.0, -0.5
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("conv", m.conv), ("bias", m.bias), ("out", m.out))}
    seen = np.full(len(embed), 1e-6, np.float32)
    t = 0
    epochs = int(np.clip(visits // len(fit), 8, 60)) if epochs is None else epochs
    for epoch in range(epochs):
        rate = 0.5 ** (3 * epoch / epochs)
        perm = rng.permutation(fit)
        for a in range(0, len(perm), batch):
            own = perm[a : a + batch]
            rows = np.concatenate([enc[i] for i in own])
            begin = np.r_[0, np.cumsum([len(enc[i]) for i in own])][:-1]
            x, out = _convolve(m, rows)
            top = _pool(out, begin)
            act = np.maximum(top + m.bias, 0)
            z = act @ m.out + m.shift
            g = ((_sigmoid(z) - y[own]) / len(own)).astype(np.float32)
            grads = {"out": act.T @ g + 1e-4 * m.out, "conv": 1e-5 * m.conv}
            ga = (g[:, None] * m.out) * (act > 0)
            grads["bias"] = ga.sum(0)
            text = np.repeat(np.arange(len(own)), np.diff(np.r_[begin, len(rows)]))
            touched, into = [], []
            col = 0
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                at = np.empty((len(own), FILTERS), np.int64)
                is_top = out[:, cols] == top[text, cols]
                for f in range(FILTERS):
                    r = np.flatnonzero(is_top[:, f])[::-1]
                    at[text[r], f] = r  # the first place of the maximum
                for j in range(w):
                    p = at + j
                    ok = p < len(rows)
                    p = np.minimum(p, len(rows) - 1)
                    wcols = slice(col + j * FILTERS, col + (j + 1) * FILTERS)
                    gk = ga[:, cols] * ok
                    grads["conv"][:, wcols] += np.einsum("nf,nfd->df", gk, x[p])
                    touched.append(rows[p].reshape(-1, rows.shape[1]))
                    into.append((gk[:, :, None] * m.conv[:, wcols].T[None]).reshape(-1, DIM))
                col += w * FILTERS
            t += 1
            m.shift -= 0.02 * rate * float(g.sum())
            for name, grad in grads.items():
                a1, a2 = state[name]
                a1 += 0.1 * (grad - a1)
                a2 += 0.01 * (grad * grad - a2)
                getattr(m, name)[...] -= 0.01 * rate * (a1 / (1 - 0.9**t)) / (np.sqrt(a2 / (1 - 0.99**t)) + 1e-8)
            r, d = np.concatenate(touched), np.concatenate(into)
            live = np.abs(d).sum(1) > 0
            r, d = r[live], d[live]
            for c in range(r.shape[1]):
                own_rows = live_rows[r[:, c]]
                u, inv = np.unique(r[own_rows, c], return_inverse=True)
                s = np.zeros((len(u), DIM), np.float32)
                np.add.at(s, inv, d[own_rows])
                seen[u] += (s * s).mean(1)
                m.embed[u] -= (0.1 * rate / np.sqrt(seen[u]))[:, None] * s
    z = np.array([float(logits(m, enc[i], np.zeros(1, np.int64))[0]) for i in held])
    m.scale = _platt(z, y[held])
    p = _sigmoid(m.scale[0] * z + m.scale[1])
    m.threshold = best_threshold(p, y[held], 0.3)
    for lang in {langs[i] for i in held if langs[i]}:
        own = np.array([k for k, i in enumerate(held) if langs[i] == lang])
        m.thresholds[lang] = best_threshold(p[own], y[held][own], m.threshold)
    return m


def scores(docs: DataFrame, model: Model, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``docs`` without its text, with ``score`` (0 to 1) and ``flagged`` (score against the language's threshold).

    Whole texts are read, null ones as empty; an empty text gets the score of no words.  A null or unknown language
    has the common threshold.  Rows stay, repeated ones too, those with a null doc_id as well; clashing columns are
    replaced.  A score that ties with a threshold is flagged.  One narrow pass; the model broadcast is about 8 MB whatever
    the corpus.
    """
    new = ("score", "flagged")
    keep = [c for c in docs.columns if c not in (*new, text)]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_lang = lang is not None and lang in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = np.empty(b.num_rows)
            for a, z, buf, off in slices(b, "__text", 1 << 18):
                out[a:z] = logits(m, *tokens(buf, off))
            p = _sigmoid(m.scale[0] * out + m.scale[1])
            limit = np.array([m.thresholds.get(x, m.threshold) for x in b.column(keep.index(lang)).to_pylist()]) if has_lang else m.threshold
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), pa.array(p), pa.array(p >= limit)], [*keep, *new])

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "score double, flagged boolean"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, bound: int = 6000) -> Model:
    """Learn ``labels.toxic`` from at most ``bound`` documents outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "toxic", modulus, held_out, bound))
