"""Benchmark decontamination: passages of a document within a small word edit distance of a benchmark item.

Per document, in one narrow pass:

1. the windows that start at each of its words, and the items, go through CGK random walks, which turn edit distance
   into Hamming distance: at each step a walk emits its current word and moves on or stays by a random bit of
   (walk, step, word).  A window is as long as an item; an item of 32 words or more is walked in pieces of 16 to 31
   words, one of which has at most its share of the edits;
2. bit-sampling LSH over the walks' outputs proposes window and item where all of a band's sampled steps agree.  The
   number of walks is the least that reaches the target recall in a simulation with as many edits as are allowed;
3. each proposal is verified by exact semi-global edit distance over the window's place and its surroundings.

Items of fewer than ``SHORT`` words, which leave the walks too few steps, are looked up exactly, as word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ALNUM, U64, grams, mix64, slices, word_hashes, word_spans

SHORT = 8  # words from which on items are walked
BANDS, SAMPLED = 8, 3  # bands of a walk, steps of a band
CLASSES = ((8, 12), (16, 24))  # least words of a piece, steps of its walks
TOP = 22  # log2 of a table's flags
DRIFT = 8  # words a walk may be from where its step would be on average


@dataclass
class Keys:
    """The band keys of the pieces of one size class, sorted, with the piece that each belongs to."""

    steps: np.ndarray  # walk x band x SAMPLED
    key: np.ndarray
    piece: np.ndarray
    flags: np.ndarray  # by the top bits of a key


@dataclass
class Index:
    """The items of one block: words, and the keys of their pieces (about 25 bytes per byte of item text)."""

    ids: np.ndarray
    words: list[np.ndarray]
    edits: np.ndarray
    vocabulary: np.ndarray  # sorted hashes of all words of walked items; a word's number is its place, from 1 on
    flags: np.ndarray
    piece_item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    piece_at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    classes: list[Keys] = field(default_factory=list)
    exact: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # words -> sorted sequence hashes, items, flags

    def __post_init__(self) -> None:
        self.size = np.array([len(x) for x in self.words])
        item = np.repeat(np.arange(len(self.words)), self.size)
        bits = max(16, min(26, (16 * len(item)).bit_length()))
        self.shift = U64(64 - bits)
        self.member = np.zeros(1 << bits, bool)
        self.member[self._member(item, self.numbers(np.concatenate(self.words)))] = True

    def numbers(self, w: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, 0 for a word of no walked item."""
        out = np.zeros(len(w), np.int32)
        if len(self.vocabulary):
            some = np.flatnonzero(self.flags[(w >> U64(64 - TOP)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocabulary, w[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[place] == w[some], place + 1, 0)
        return out

    def _member(self, item: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (mix64(item.astype(U64) << U64(32) | number.astype(U64), 3) >> self.shift).astype(np.int64)

    def own_words(self, number: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
        """For each place, how many of its words belong to its item (by hash, so rarely a few too many)."""
        out = np.zeros(len(item), np.int64)
        known = np.r_[0, np.cumsum(number > 0)]
        some = np.flatnonzero(known[hi] - known[lo] >= self.size[item] - self.edits[item])
        for a in range(0, len(some), chunk):
            k = some[a : a + chunk]
            n = hi[k] - lo[k]
            end = np.cumsum(n)
            v = number[np.repeat(lo[k] - end + n, n) + np.arange(end[-1])]
            hit = self.member[self._member(np.repeat(item[k], n), v)] & (v > 0)
            total = np.r_[0, np.cumsum(hit)]
            out[k] = total[end] - total[end - n]
        return out


def _walk(words: np.ndarray, number: np.ndarray, start: np.ndarray, walk: int, steps: list[int]) -> dict[int, np.ndarray]:
    """The word number that the walk emits at each of ``steps``, for windows that start at ``start``; 0 for a word of no
    item and past the end."""
    n = len(words)
    bits = np.append((mix64(words, 1000 + walk) >> U64(33)).astype(np.int32), np.int32(0))  # one for each step; the end stays
    here = np.append(number, np.int32(0))
    idx = np.arange(n + 1, dtype=np.int32)
    at, move = start.astype(np.int32), np.empty(n + 1, np.int32)
    out = {}
    for j in range(max(steps) + 1):
        if j in steps:
            out[j] = here.take(at, mode="clip")
        np.right_shift(bits, j, out=move)
        move &= 1
        move += idx
        at = move.take(at, mode="clip")
    return out


def _band_keys(words: np.ndarray, number: np.ndarray, start: np.ndarray, classes: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, band over all walks, windows, keys) for the bands whose sampled words all belong to items.

    ``classes`` has, for each size class, the steps of its bands (walk x band x SAMPLED); all share the walks.
    """
    with np.errstate(over="ignore"):
        for r in range(max(map(len, classes))):
            own = [(c, s[r]) for c, s in enumerate(classes) if r < len(s)]
            out = _walk(words, number, start, r, sorted({int(j) for _, s in own for j in s.ravel()}))
            known = {j: v > 0 for j, v in out.items()}
            for c, steps in own:
                for b, band in enumerate(steps.tolist()):
                    ok = known[band[0]] & known[band[1]]
                    ok &= known[band[2]]
                    ok = np.flatnonzero(ok)
                    key = np.full(len(ok), U64(r * BANDS + b + 1))
                    for j in band:
                        key = key * U64(0x9FB21C651E98DF25) + out[j][ok].astype(U64)
                    yield c, r * BANDS + b, ok, mix64(key, 9)


def _sampled(walks: int, length: int, seed: int = 20) -> np.ndarray:
    rng = np.random.default_rng([seed, length])
    return np.stack([np.stack([np.sort(rng.choice(length, SAMPLED, replace=False)) for _ in range(BANDS)]) for _ in range(walks)])


def simulated_recall(size: int, edits: int, length: int, walks: int, trials: int = 300, seed: int = 5) -> float:
    """Share of random pieces of ``size`` words that LSH still proposes after ``edits`` random word edits."""
    rng = np.random.default_rng([seed, size, edits])
    fresh = lambda n: rng.integers(1, 1 << 62, n).astype(U64)
    steps, found = _sampled(walks, length), 0
    for _ in range(trials):
        item = fresh(size)
        w = list(item)
        for _ in range(edits):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind < 2)] = fresh(1).tolist() if kind != 1 else []
        text = np.concatenate([fresh(3), np.array(w, U64), fresh(size)])
        voc = np.unique(np.concatenate([item, text]))
        num = lambda x: (np.searchsorted(voc, x) + 1).astype(np.int32)
        mine = {k: set(v.tolist()) for _, k, _, v in _band_keys(item, num(item), np.zeros(1, np.int64), [steps])}
        found += any(not mine[k].isdisjoint(v.tolist()) for _, k, _, v in _band_keys(text, num(text), np.arange(len(text)), [steps]))
    return found / trials


_walks_for: dict[tuple[float, float], list[int]] = {}


def walks_for(target: float, max_edit: float) -> list[int]:
    """The least number of walks, for each size class, that reaches the target recall at the most edits allowed."""
    if (target, max_edit) not in _walks_for:
        out = []
        for least, length in CLASSES:
            r = 2
            while r < 16 and min(simulated_recall(n, int(max_edit * n), length, r) for n in (least, 2 * least - 1)) < target:
                r += 1
            out.append(r)
        _walks_for[target, max_edit] = out
    return _walks_for[target, max_edit]


def build_index(items: list[tuple[int, str]], max_edit: float, target: float = 0.97) -> Index | None:
    ids, words = [], []
    for i, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        s, e, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
        if len(s):
            ids.append(i)
            words.append(word_hashes(raw, s, e, lower=True))
    if not ids:
        return None
    size = np.array([len(w) for w in words])
    long = size >= SHORT
    voc = np.unique(np.concatenate([words[i] for i in np.flatnonzero(long)])) if long.any() else np.zeros(0, U64)
    ix = Index(np.array(ids), words, np.where(long, np.floor(max_edit * size + 1e-9), 0).astype(int), voc, _flags(voc))
    for n in np.unique(size[~long]).tolist():
        own = np.flatnonzero(size == n)
        h = np.array([grams(words[i], n)[0] for i in own], U64)
        o = np.argsort(h, kind="stable")
        ix.exact[n] = (h[o], own[o], _flags(h))
    if not long.any():
        return ix
    start, item, at, length = [], [], [], []
    flat, off = np.concatenate(words), np.r_[0, np.cumsum(size)]
    for i in np.flatnonzero(long):
        n = max(1, int(size[i]) // 16)
        cut = np.arange(n) * int(size[i]) // n
        start.append(off[i] + cut)
        item.append(np.full(n, i))
        at.append(cut)
        length.append(np.diff(np.r_[cut, size[i]]))
    start, ix.piece_item, ix.piece_at, length = (np.concatenate(x) for x in (start, item, at, length))
    number = ix.numbers(flat)
    for c, ((least, steps), walks) in enumerate(zip(CLASSES, walks_for(target, max_edit))):
        most = CLASSES[c + 1][0] if c + 1 < len(CLASSES) else 1 << 30
        own = np.flatnonzero((length >= least) & (length < most))
        if not len(own):
            continue
        s = _sampled(walks, steps)
        keys, pieces = [], []
        # a walk may run past the end of its piece into what follows it there; an item's end is a wall
        ends = off[ix.piece_item[own] + 1]
        for k in range(0, len(own), 1 << 14):
            got, mine = _item_keys(flat, number, start[own[k : k + (1 << 14)]], ends[k : k + (1 << 14)], s)
            keys.append(got)
            pieces.append(own[k : k + (1 << 14)][mine])
        key, piece = np.concatenate(keys), np.concatenate(pieces)
        o = np.argsort(key, kind="stable")
        ix.classes.append(Keys(s, key[o], piece[o], _flags(key)))
    return ix


def _item_keys(flat: np.ndarray, number: np.ndarray, start: np.ndarray, end: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of pieces of items laid out one after the other, each walled off from the next."""
    width = np.minimum(end - start, int(steps.max()) + 1)
    at = np.repeat(start, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    base = np.cumsum(width + 1) - (width + 1)  # a word of no item stands between two pieces
    into = np.repeat(base, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    w, n = np.zeros(int((width + 1).sum()), U64), np.zeros(int((width + 1).sum()), np.int32)
    w[into], n[into] = flat[at], number[at]
    got = [(ok, key) for _, _, ok, key in _band_keys(w, n, base, [steps])]
    # what a walk emits behind the wall belongs to the next piece: such bands only propose more, and are verified
    return np.concatenate([k for _, k in got]), np.concatenate([o for o, _ in got])


def _flags(key: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << TOP, bool)
    out[(key >> U64(64 - TOP)).astype(np.int64)] = True
    return out


def _lookup(table: np.ndarray, flags: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in h, place in the sorted table) for all equal pairs."""
    hit = np.flatnonzero(flags[(h >> U64(64 - TOP)).astype(np.int64)])
    lo, hi = np.searchsorted(table, h[hit], "left"), np.searchsorted(table, h[hit], "right")
    n = hi - lo
    hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
    return np.repeat(hit, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def edit_distance_in(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between ``item`` and any part of ``text``, with that part's start and end (first end, then latest start)."""
    n = len(text)
    idx = np.arange(n + 1)
    row, frm = np.zeros(n + 1, np.int64), idx.copy()
    diag, src = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
    for i, w in enumerate(item):
        diag[0], src[0] = i + 1, 0
        np.add(row[:-1], text != w, out=diag[1:])
        up = row + 1
        src[1:] = np.where(diag[1:] <= up[1:], frm[:-1], frm[1:])
        level = np.minimum(diag, up) - idx
        low = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == low, idx, 0))
        row, frm = low + idx, src[at]
    end = int(row.argmin())
    return int(row[end]), int(frm[end]), end


def proposals(ix: Index, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word of the window, word where the item would start) for each window that agrees with a piece of
    an item in any band."""
    piece, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if ix.classes and len(w):
        number = ix.numbers(w)
        every = np.arange(len(w), dtype=np.int32)
        for c, _, ok, key in _band_keys(w, number, every, [c.steps for c in ix.classes]):
            own = ix.classes[c]
            at, k = _lookup(own.key, own.flags, key)
            piece.append(own.piece[k])
            start.append(ok[at])
    both = np.unique(np.concatenate(piece) << 32 | np.concatenate(start))
    piece, start = both >> 32, both & ((1 << 32) - 1)
    return ix.piece_item[piece], start, start - ix.piece_at[piece]


def matches_in(ix: Index, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first word, end word) for each text and item that match, at the best place."""
    start, end, first = word_spans(buf, off, ALNUM)
    w = word_hashes(buf, start, end, lower=True)
    if not len(w):
        return
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def note(t: int, i: int, found: tuple[int, int, int]) -> None:
        best[t, i] = min(best.get((t, i), found), found)

    for n, (h, own, flags) in ix.exact.items():
        at, k = _lookup(h, flags, grams(w, n))
        for p, i in zip(at.tolist(), own[k].tolist()):
            t = int(text[p])
            if text[p + n - 1] == t and (w[p : p + n] == ix.words[i]).all():
                note(t, i, (0, p - int(first[t]), p + n - int(first[t])))
    item, window, at = proposals(ix, w)
    if len(item):
        # proposals of one text and item that stand near each other are one place
        t = text[window]
        o = np.lexsort((at, t, item))
        item, t, at = item[o], t[o], at[o]
        lead = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (t[1:] != t[:-1]) | (at[1:] - at[:-1] > ix.edits[item[1:]] + DRIFT)])
        last = np.r_[lead[1:], len(item)] - 1
        item, t, reach = item[lead], t[lead], ix.edits[item[lead]] + DRIFT
        lo = np.maximum(at[lead] - reach, first[t])
        hi = np.minimum(at[last] + ix.size[item] + reach, first[t + 1])
        # every edit spoils at most one word of the item, so enough of the words here must be its own
        own = ix.own_words(ix.numbers(w), item, lo, hi)
        for k in np.flatnonzero(own >= ix.size[item] - ix.edits[item]).tolist():
            i = int(item[k])
            d, x, y = edit_distance_in(ix.words[i], w[lo[k] : hi[k]])
            if d <= ix.edits[i]:
                base = int(lo[k] - first[t[k]])
                note(int(t[k]), i, (d, base + x, base + y))
    for (tt, i), (d, x, y) in sorted(best.items()):
        yield tt, i, d, x, y


def _blocks(benchmark: DataFrame, max_bytes: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``max_bytes`` of text, each small enough to broadcast; one block at a time is on the driver."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // max_bytes))
    for k in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.25, target: float = 0.97, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, n_edits, item_words, start_word, end_word) for every document and item that match.

    Words are runs of ASCII letters and digits and non-ASCII characters, in lower case.  A document matches an item of
    L words if some part of it is within floor(max_edit * L) word edits; the best part is given (fewest edits, then
    the earliest), in word positions, end exclusive.  Items of fewer than 8 words match exactly, at their first place;
    null items, items without words and null texts match nothing.  A null doc_id is kept as such; repeated rows give
    repeated matches.  Texts of any length are read whole.  ``target`` is the recall that the number of walks is chosen
    for, at the most edits allowed; each match is verified.  A benchmark beyond ``block_bytes`` takes one pass over the
    documents per block.
    """
    out, rows = None, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_edits int, item_words int, start_word int, end_word int"
    for block in _blocks(benchmark, block_bytes):
        ix = docs.sparkSession.sparkContext.broadcast(build_index(block, max_edit, target))

        def run(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if ix.value is None:
                    continue
                found = [(b.column(0)[a + t].as_py(), int(ix.value.ids[i]), d, len(ix.value.words[i]), x, y) for a, _, buf, off in slices(b, "text") for t, i, d, x, y in matches_in(ix.value, buf, off)]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["doc_id", "item_id", "n_edits", "item_words", "start_word", "end_word"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.25, target: float = 0.97, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns as they are: one narrow pass per block of items."""
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {k}" for c, k in kind.items())
    for block in _blocks(benchmark, block_bytes):
        ix = docs.sparkSession.sparkContext.broadcast(build_index(block, max_edit, target))

        def run(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                if ix.value is not None:
                    for a, _, buf, off in slices(b, "text"):
                        for t, *_ in matches_in(ix.value, buf, off):
                            keep[a + t] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
