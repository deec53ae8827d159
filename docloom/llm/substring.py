"""Repeated word spans across documents, by compaction of a De Bruijn graph of word windows.

A window of ``k`` words is an edge of the graph from the node of its first to that of its last k - 1 words.  Only edges
that occur in at least two documents matter, so these are found first:

1. every document sends the minimisers of its windows (the smallest of each window's short grams; equal windows have
   equal minimisers), each sender once with a count; those that at least two documents have come back as a bitmap of
   fixed size, and those that very many have as a bounded list of hot ones;
2. windows whose minimiser hits the bitmap are grouped by minimiser, so all copies of an edge meet in one group.  Windows
   of hot minimisers go by the hash of the whole window instead: their first places are aggregated where they are and
   joined back, so no task holds all copies of a passage.  An edge's canonical place is its first document and position;
3. each document's repeated edges are merged to runs in source coordinates;
4. the graph: each source's canonical edges give their nodes, nodes meet by hash, and where more than one edge comes in
   or goes out a path ends.  The branching places are joined to their sources, and what lies between them is one
   nonbranching path, compacted to (source document, start, number of edges);
5. verification: each path is read at its source coordinates, its words' 128-bit digest is joined to the runs, and every
   document compares its own words before it gives any of them up.  If a single digest differs, two windows had the same
   hash by chance or by design, and the whole is done again with cryptographic window hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import U64, discard, grams, materialise, mix64, parts_for, slices, sized, total_bytes, word_hashes, word_spans
from docloom.llm.urlfilter import BlockedBloom

SHORT = 5  # words of a minimiser
FLUSH = 1 << 18  # windows a worker holds before it sends them
HOT_LEAST, HOT_MOST = 1 << 12, 1 << 21  # documents that make a minimiser hot, at least; hot minimisers, at most
SEGMENTS = 256  # pieces in which the bitmap comes to the driver


def _minimisers(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Word hashes; short grams; starts of whole windows; the minimiser position, text and first word of that text of each."""
    start, end, first = word_spans(buf, off)
    w = word_hashes(buf, start, end)
    g = grams(w, SHORT)
    n = len(w) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return w, g, z, z, z, z
    low = g[:n].copy()
    for j in range(1, k - SHORT + 1):
        np.minimum(low, g[j : j + n], out=low)
    at = np.zeros(n, np.int64)
    idx = np.arange(n)
    for j in range(k - SHORT, -1, -1):
        np.copyto(at, idx + j, where=g[j : j + n] == low)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    whole = idx + k <= first[text[:n] + 1]
    s = np.flatnonzero(whole)
    return w, g, s, at[s], text[s], first[text[s]]


def _route(g: np.ndarray) -> np.ndarray:
    """Minimisers as spread over all 64-bit values: as minima they crowd at the low end."""
    return mix64(g, 51)


def _by_part(part: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(part, kind="stable")
    p = part[order]
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    arrays = [a[order] for a in arrays]
    for a, b in zip(cut, [*cut[1:], len(p)]):
        yield int(p[a]), [x[a:b] for x in arrays]


def _sum_equal(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(v, kind="stable")
    v, n = v[o], n[o]
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)
    return v[at], np.add.reduceat(n, at) if len(at) else n


def _shared(keyed: DataFrame, k: int, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of 2**bits over the top bits of the minimisers that at least two documents have, and the hot minimisers.

    A minimiser is hot if more than ``HOT_LEAST`` documents have it, and more than one in ``HOT_MOST`` of all counted
    ones, so that there are at most ``HOT_MOST`` hot ones (16 MB) whatever the corpus.
    """
    pbits = parts.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(got: list[np.ndarray]) -> pa.RecordBatch:
            v = np.concatenate(got)
            v, n = _sum_equal(v, np.ones(len(v), np.int64))
            rows = list(_by_part((v >> U64(64 - pbits)).astype(np.int32) if pbits else np.zeros(len(v), np.int32), [v, n.astype(np.uint32)]))
            often = [x[1] if (x[1] > 1).any() else x[1][:0] for _, x in rows]
            return pa.record_batch([pa.array([p for p, _ in rows], pa.int32()), pa.array([x[0].tobytes() for _, x in rows], pa.binary()), pa.array([n.tobytes() for n in often], pa.binary())], ["part", "g", "n"])

        got, held = [], 0
        for b in batches:
            for _, _, buf, off in slices(b, "text"):
                _, g, _, at, text, _ = _minimisers(buf, off, k)
                if not len(at):
                    continue
                new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
                v, t = _route(g[at[new]]), text[new]
                o = np.argsort(v, kind="stable")  # texts ascend, so a text's repeats are neighbours
                v, t = v[o], t[o]
                got.append(v[np.r_[True, (v[1:] != v[:-1]) | (t[1:] != t[:-1])]])
                held += len(got[-1])
                if held > FLUSH:
                    yield packed(got)
                    got, held = [], 0
        if got:
            yield packed(got)

    def meet(t: pa.Table) -> pa.Table:
        v = [np.frombuffer(x.as_py(), U64) for x in t["g"]]
        n = [np.frombuffer(x.as_py(), np.uint32).astype(np.int64) if len(x.as_py()) else np.ones(len(g), np.int64) for x, g in zip(t["n"], v)]
        v, n = _sum_equal(np.concatenate(v), np.concatenate(n))
        top = np.unique(v[n > 1] >> U64(64 - bits)).astype(np.int64)
        hot = n > HOT_LEAST
        own = np.unique(top >> (bits - 8))  # one row per piece of the bitmap, of the bits set in it
        rows = [(int(s), (top[top >> (bits - 8) == s] & ((1 << (bits - 8)) - 1)).astype(np.uint32).tobytes(), b"", b"", 0) for s in own]
        rows.append((-1, b"", v[hot].tobytes(), n[hot].tobytes(), int(n.sum())))
        return pa.table({c: pa.array(x, y) for c, x, y in zip(("segment", "top", "hot", "n", "total"), zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:  # as they come: no group is held whole
            for s, x in zip(b.column(0).to_pylist(), b.column(1)):
                own.setdefault(s, np.zeros(1 << (bits - 8), bool))[np.frombuffer(x.as_py(), np.uint32)] = True
        for s, x in own.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], ["segment", "bits"])

    sent = sized(keyed.mapInArrow(send, "part int, g binary, n binary"), parts * (1 << 20), "part")
    met = materialise(sent.groupBy("part").applyInArrow(meet, "segment int, top binary, hot binary, n binary, total long"), "minimisers")
    least = max(HOT_LEAST, (met.agg(F.sum("total")).first()[0] or 0) // HOT_MOST)
    hot = [np.zeros(0, U64)]
    for r in met.where("segment = -1 and length(hot) > 0").select("hot", "n").toLocalIterator():
        hot.append(np.frombuffer(r.hot, U64)[np.frombuffer(r.n, np.int64) > least])
    got = met.where("segment >= 0").select("segment", "top").repartition(min(parts, SEGMENTS), "segment").mapInArrow(unite, "segment int, bits binary").toArrow()  # 2**bits bits in all
    out = np.zeros((SEGMENTS, (1 << (bits - 8)) // 8), np.uint8)
    for p, x in zip(got["segment"].to_pylist(), got["bits"].to_pylist()):
        out[p] |= np.frombuffer(x, np.uint8)
    discard(met)
    return out.reshape(-1), np.sort(np.concatenate(hot))


def _window_hashes(w: np.ndarray, s: np.ndarray, k: int, raw: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for each window: two polynomials over its words' hashes, or with ``raw`` (bytes, word starts and ends) a
    cryptographic digest of its words."""
    if raw is not None:
        buf, start, end = raw
        data = buf.tobytes()
        word = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
        got = np.frombuffer(b"".join(hashlib.blake2b(b" ".join(word[i : i + k]), digest_size=16).digest() for i in s.tolist()), U64).reshape(-1, 2)
        return got[:, 0].copy(), got[:, 1] & U64(0xFFFFFFFF)
    h1, h2 = np.zeros(len(s), U64), np.zeros(len(s), U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            x = w[s + j]
            h1 = h1 * U64(0x9FB21C651E98DF25) + x
            h2 = (h2 ^ x) * U64(0xD6E8FEB86659FD93)
            h2 ^= h2 >> U64(32)
    return h1, h2 >> U64(32)


_PIECE = "doc_id long, tid long, start int, n int, src_doc long, src_tid long, src_start int"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tid"))


def _candidates(keyed: DataFrame, k: int, bitmap, hot, bits: int, parts: int, strong: bool, want_hot: bool) -> DataFrame:
    """Windows whose minimiser is shared: packed by minimiser, or with ``want_hot`` one row per window of a hot one."""
    pbits = parts.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, most = bitmap.value, hot.value

        def packed(got: list, ids: np.ndarray, tids: np.ndarray) -> pa.RecordBatch:
            v, h1, h2, pos, row = (np.concatenate(x) for x in zip(*got))
            if want_hot:
                cols = (h1.view(np.int64), h2.astype(np.int64), ids[row], tids[row], pos)
                return pa.record_batch([pa.array(c) for c in cols], ["h1", "h2", "doc_id", "tid", "pos"])
            part = (v >> U64(64 - pbits)).astype(np.int32) if pbits else np.zeros(len(v), np.int32)
            out = []
            for p, (a1, a2, ap, ar) in _by_part(part, [h1, h2, pos, row]):
                rows, inv = np.unique(ar, return_inverse=True)
                out.append((p, a1.tobytes(), a2.astype(np.uint32).tobytes(), ap.tobytes(), inv.astype(np.uint16 if len(rows) < 1 << 16 else np.uint32).tobytes(), ids[rows].tobytes(), tids[rows].tobytes()))
            cols = list(zip(*out))
            return pa.record_batch([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "h1", "h2", "pos", "row", "ids", "tids"])

        for b in batches:
            ids, tids = b.column(0).to_numpy(), b.column(2).to_numpy()
            got, held = [], 0
            for row, _, buf, off in slices(b, "text"):
                w, g, s, at, text, word0 = _minimisers(buf, off, k)
                if not len(s):
                    continue
                v = _route(g[at])
                top = (v >> U64(64 - bits)).astype(np.int64)
                hit = (known[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1 == 1
                if len(most):
                    place = np.minimum(np.searchsorted(most, v), len(most) - 1)
                    hit &= (most[place] == v) == want_hot
                elif want_hot:
                    continue
                if not hit.any():
                    continue
                s, v, text, word0 = s[hit], v[hit], text[hit], word0[hit]
                h1, h2 = _window_hashes(w, s, k, (buf, *word_spans(buf, off)[:2]) if strong else None)
                got.append((v, h1, h2, (s - word0).astype(np.int32), (text + row).astype(np.int32)))
                held += len(s)
                if held > FLUSH:
                    yield packed(got, ids, tids)
                    got, held = [], 0
            if got:
                yield packed(got, ids, tids)

    return keyed.mapInArrow(send, "h1 long, h2 long, doc_id long, tid long, pos int" if want_hot else "part int, h1 binary, h2 binary, pos binary, row binary, ids binary, tids binary")


def _meet(t: pa.Table) -> pa.Table:
    """Of the windows of one group those that an earlier document has, as pieces of runs."""
    cols: list[list[np.ndarray]] = [[], [], [], [], []]
    for r in t.to_pylist():
        ids = np.frombuffer(r["ids"], np.int64)
        row = np.frombuffer(r["row"], np.uint16 if len(ids) < 1 << 16 else np.uint32)
        for c, x in zip(cols, (np.frombuffer(r["h1"], U64), np.frombuffer(r["h2"], np.uint32), np.frombuffer(r["pos"], np.int32), ids[row], np.frombuffer(r["tids"], np.int64)[row])):
            c.append(x)
    h1, h2, pos, doc, tid = (np.concatenate(c) for c in cols)
    o = np.lexsort((pos, tid, doc, h2, h1))
    h1, h2, pos, doc, tid = h1[o], h2[o], pos[o], doc[o], tid[o]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = doc > doc[first]
    first = first[later]
    pos, doc, tid, sd, st, sp = pos[later], doc[later], tid[later], doc[first], tid[first], pos[first]
    o = np.lexsort((pos, tid, doc))
    pos, doc, tid, sd, st, sp = pos[o], doc[o], tid[o], sd[o], st[o], sp[o]
    at, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(pos):
        same = np.r_[False, (doc[1:] == doc[:-1]) & (tid[1:] == tid[:-1]) & (pos[1:] == pos[:-1])]  # a repeated row
        pos, doc, tid, sd, st, sp = (c[~same] for c in (pos, doc, tid, sd, st, sp))
        brk = np.r_[True, (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]) | (pos[1:] != pos[:-1] + 1) | (sd[1:] != sd[:-1]) | (st[1:] != st[:-1]) | (sp[1:] != sp[:-1] + 1)]
        at = np.flatnonzero(brk)
        n = np.diff(np.r_[at, len(pos)])
    return pa.table({"doc_id": doc[at], "tid": tid[at], "start": pos[at], "n": n.astype(np.int32), "src_doc": sd[at], "src_tid": st[at], "src_start": sp[at]})


def repeated_runs(docs: DataFrame, k: int = 13, max_bits: int = 28, strong: bool = False) -> DataFrame:
    """Runs of windows that an earlier document has too: (doc_id, tid, start, n, src_doc, src_tid, src_start).

    The ``n`` windows from word ``start`` on also start in document ``src_doc`` (the smallest doc_id that has them)
    from word ``src_start`` on.  ``tid`` is the hash of the row's text, so rows that share a doc_id keep apart.
    Rows with a null doc_id take no part; nulls and texts of fewer than k words have no window; very long texts are read
    whole.  Windows are equal here by 96 bits of hash, or 128-bit digests with ``strong``; ``remove_repeats`` verifies.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    size = total_bytes(docs)
    parts = 1 << (parts_for(size, 2 << 20) - 1).bit_length()
    bits = max(20, min(max_bits, (4 * size).bit_length()))
    flags, most = _shared(keyed, k, parts, bits)
    bitmap, hot = spark.sparkContext.broadcast(flags), spark.sparkContext.broadcast(most)
    pieces = sized(_candidates(keyed, k, bitmap, hot, bits, parts, strong, False), 2 * size, "part").groupBy("part").applyInArrow(_meet, _PIECE)
    if len(most):
        windows = _candidates(keyed, k, bitmap, hot, bits, parts, strong, True)
        first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tid", "pos")).alias("s"), F.max("doc_id").alias("last")).where("last > s.doc_id").drop("last")
        back = windows.join(first, ["h1", "h2"]).where("doc_id > s.doc_id")  # adaptive execution splits a hot window's rows
        back = back.select("doc_id", "tid", F.col("pos").alias("start"), F.lit(1).alias("n"), F.col("s.doc_id").alias("src_doc"), F.col("s.tid").alias("src_tid"), F.col("s.pos").alias("src_start"))
        pieces = pieces.unionByName(back)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = b.column(2)
            one = owner.flatten()
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(owner.offsets)))
            start, n, sd, st, sp = (one.field(i).to_numpy() for i in range(5))
            o = np.lexsort((start, row))
            row, start, n, sd, st, sp = (x[o] for x in (row, start, n, sd, st, sp))
            brk = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (sd[1:] != sd[:-1]) | (st[1:] != st[:-1]) | (sp[1:] != sp[:-1] + n[:-1])] if len(row) else np.zeros(0, bool)
            at = np.flatnonzero(brk)
            total = np.add.reduceat(n, at).astype(np.int32) if len(at) else n
            own = pa.array(row[at])
            yield pa.record_batch([b.column(0).take(own), b.column(1).take(own), pa.array(start[at]), pa.array(total), pa.array(sd[at]), pa.array(st[at]), pa.array(sp[at])], [c.split()[0] for c in _PIECE.split(", ")])

    by_doc = sized(pieces, size, "doc_id", "tid").groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n", "src_doc", "src_tid", "src_start")).alias("pieces"))
    return by_doc.mapInArrow(merge, _PIECE)


def _spans(runs: list, k: int, n_words: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, n in sorted(runs):
        e = min(n_words, s + n + k - 1)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def repeated_paths(docs: DataFrame, runs: DataFrame, k: int = 13) -> DataFrame:
    """The compacted graph: (src_doc, src_tid, sources, paths) for each text that canonical edges lie in.

    ``sources`` are the texts (start, words joined by a space) of its stretches of canonical edges and ``paths`` the
    nonbranching paths (start, n) in them: n edges from word ``start`` on, between whose ends no node has a second edge
    coming in or going out.  ``runs`` is the written result of ``repeated_runs``.
    """
    asked = runs.select("src_doc", "src_tid", "src_start", "n").distinct().groupBy("src_doc", "src_tid").agg(F.collect_list(F.struct("src_start", "n")).alias("asked"))
    bloom = BlockedBloom(runs.select("src_doc").distinct(), "src_doc")  # only texts of sources travel
    texts = bloom.mark(_keyed(docs), F.col("doc_id")).where("__maybe").select(F.col("doc_id").alias("src_doc"), F.col("tid").alias("src_tid"), "text").dropDuplicates(["src_doc", "src_tid"])
    parts = parts_for(total_bytes(docs), 8 << 20)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["src_doc", "src_tid", "sources", "part", "node", "at", "row", "ids"]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())])), pa.int32(), *(pa.binary() for _ in range(4)))

        def packed(rows: list, node: list, at: list, ids: list) -> pa.RecordBatch:
            h, p, r = np.concatenate(node), np.concatenate(at), np.repeat(np.arange(len(ids)), [len(x) for x in node])
            own = np.array(ids, np.int64)
            for q, (x, y, z) in _by_part((h % U64(parts)).astype(np.int64), [h, p, r]):
                here, inv = np.unique(z, return_inverse=True)
                rows.append((None, None, None, q, x.tobytes(), y.tobytes(), inv.astype(np.uint32).tobytes(), own[here].tobytes()))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        rows, node, at, ids, held = [], [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                doc, tid, text, asks = (b.column(c)[i].as_py() for c in range(4))
                words = text.encode().split()
                found = []
                for a, e in _union_of([(x["src_start"], x["src_start"] + x["n"]) for x in asks]):
                    piece = b" ".join(words[a : e + k - 1])
                    found.append({"start": a, "text": piece.decode()})
                    buf = np.frombuffer(piece, np.uint8)
                    s, t, _ = word_spans(buf, np.array([0, len(buf)]))
                    h = grams(word_hashes(buf, s, t), k - 1)  # nodes a .. e of the edges a .. e - 1
                    way = np.r_[2, np.full(len(h) - 2, 3), 1]  # 1: an edge comes in, 2: one goes out
                    node.append(h)
                    at.append((np.arange(a, a + len(h)) << 2 | way).astype(np.int64))
                    ids.append((doc, tid))
                    held += len(h)
                rows.append((doc, tid, found, None, None, None, None, None))
                if held > FLUSH // 2:
                    yield packed(rows, node, at, ids)
                    rows, node, at, ids, held = [], [], [], [], 0
        if held:
            yield packed(rows, node, at, ids)

    def branching(t: pa.Table) -> pa.Table:
        h, p, own = [], [], []
        for x in t.to_pylist():
            h.append(np.frombuffer(x["node"], U64))
            p.append(np.frombuffer(x["at"], np.int64))
            own.append(np.frombuffer(x["ids"], np.int64).reshape(-1, 2)[np.frombuffer(x["row"], np.uint32)])
        h, p, own = np.concatenate(h), np.concatenate(p), np.concatenate(own)
        _, inv = np.unique(h, return_inverse=True)
        into, out = np.bincount(inv, p & 1), np.bincount(inv, p >> 1 & 1)
        cut = np.flatnonzero((p & 3 == 3) & ((into[inv] > 1) | (out[inv] > 1)))  # only nodes inside a stretch can end a path there
        return pa.table({"src_doc": own[cut, 0], "src_tid": own[cut, 1], "at": (p[cut] >> 2).astype(np.int32)})

    graph = materialise(
        sized(texts, total_bytes(docs), "src_doc", "src_tid").join(asked, ["src_doc", "src_tid"]).select("src_doc", "src_tid", "text", "asked").mapInArrow(
            cut_out, "src_doc long, src_tid long, sources array<struct<start:int,text:string>>, part int, node binary, at binary, row binary, ids binary"
        ),
        "graph",
    )
    cuts = graph.where("part is not null").select("part", "node", "at", "row", "ids")
    cuts = sized(cuts, total_bytes(docs), "part").groupBy("part").applyInArrow(branching, "src_doc long, src_tid long, at int")
    cuts = cuts.groupBy("src_doc", "src_tid").agg(F.array_sort(F.collect_list("at")).alias("cuts"))
    joined = graph.where("part is null").select("src_doc", "src_tid", "sources").join(cuts, ["src_doc", "src_tid"], "left")
    inside = lambda a, e: F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > a) & (c < e))

    def between(s):
        a, e = s["start"], s["start"] + F.size(F.split(s["text"], " ")) - (k - 1)
        c = inside(a, e)
        return F.transform(F.arrays_zip(F.concat(F.array(a), c).alias("a"), F.concat(c, F.array(e)).alias("b")), lambda z: F.struct(z["a"].alias("start"), (z["b"] - z["a"]).cast("int").alias("n")))

    return joined.select("src_doc", "src_tid", "sources", F.flatten(F.transform("sources", between)).alias("paths"))


def _union_of(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def _evidence(runs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """For each run its part of every path it goes along, and the digest of the source's words there:
    (doc_id, tid, start, n, proof), proof being 24 bytes (first edge and number of edges within the run, digest) each."""
    asked = runs.select("src_doc", "src_tid", "src_start", "n").distinct().groupBy("src_doc", "src_tid").agg(F.collect_list(F.struct("src_start", "n")).alias("asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                doc, tid, sources, lines, asks = (b.column(c)[i].as_py() for c in range(5))
                lines = sorted((p["start"], p["n"]) for p in lines)
                starts = np.array([a for a, _ in lines])
                words = {s["start"]: s["text"].encode().split() for s in sources}
                bases = np.array(sorted(words))
                for q in asks:
                    a, e, proof = q["src_start"], q["src_start"] + q["n"], b""
                    j = int(np.searchsorted(starts, a, "right")) - 1
                    base = int(bases[np.searchsorted(bases, a, "right") - 1])
                    while a < e:
                        stop = min(e, lines[j][0] + lines[j][1])
                        own = words[base][a - base : stop - base + k - 1]
                        proof += (a - q["src_start"]).to_bytes(4, "little") + (stop - a).to_bytes(4, "little") + _digest(own)
                        a, j = stop, j + 1
                    rows.append((doc, tid, q["src_start"], q["n"], proof))
            if rows:  # a batch of short rows
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["src_doc", "src_tid", "src_start", "n", "proof"])

    told = paths.join(asked, ["src_doc", "src_tid"]).select("src_doc", "src_tid", "sources", "paths", "asked")
    told = told.mapInArrow(answer, "src_doc long, src_tid long, src_start int, n int, proof binary")
    return runs.join(told, ["src_doc", "src_tid", "src_start", "n"]).select("doc_id", "tid", "start", "n", "proof")


def remove_repeats(docs: DataFrame, k: int = 13, digest: bool = False, strong: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, more) with ``n_words``, ``n_removed`` and, instead of its text, the kept text.

    A word goes if a window of ``k`` words of its document that covers it also starts in a document of smaller
    doc_id; kept words are joined by one space.  With ``digest`` the column is ``kept_sha256`` in place of ``text``.
    Null and empty texts keep no words; rows with a null doc_id lose none.  Rows that share a doc_id are judged each on
    its own text, never against each other; repeated rows get the same result each.  Very long texts are read whole.
    Among equal windows the smallest (doc_id, text hash, position) is the source; ties have no influence on what goes.
    Clashing columns are replaced.  The result is a written table; ``strong`` hashes are only used when verification
    finds a collision, or when asked for.
    """
    last = "kept_sha256" if digest else "text"
    new = ("n_words", "n_removed", last)
    keep = [c for c in docs.columns if c not in (*new, "text")]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    runs = materialise(repeated_runs(docs, k, strong=strong), "runs")
    paths = materialise(repeated_paths(docs, runs, k), "paths")
    proofs = _evidence(runs, paths, k).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("start", "n", "proof")).alias("__runs"))
    bloom = BlockedBloom(runs.select("doc_id").distinct(), "doc_id")  # other documents lose nothing and stay where they are
    text = F.col("text").cast("string")
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__tid"), text.alias("__text"))
    rows = bloom.mark(rows, F.col("__id"))
    cols = [f"c{i}" for i in range(len(keep))]
    none = F.lit(None).cast("array<struct<start:int,n:int,proof:binary>>").alias("__runs")
    stay = rows.where(~F.col("__maybe")).select(*cols, "__text", none)
    go = sized(rows.where("__maybe"), total_bytes(docs), "__id", "__tid").join(proofs, (F.col("__id") == proofs["doc_id"]) & (F.col("__tid") == proofs["tid"]), "left").select(*cols, "__text", "__runs")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept, wrong = [], [], [], []
            for text, found in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                left, bad = words, 0
                if found.is_valid:
                    good = []
                    for r in found.as_py():
                        for p in range(0, len(r["proof"]), 24):
                            a, m = (int.from_bytes(r["proof"][p + q : p + q + 4], "little") for q in (0, 4))
                            a += r["start"]
                            if _digest(words[a : a + m + k - 1]) == r["proof"][p + 8 : p + 24]:
                                good.append((a, m))
                            else:
                                bad += 1
                    left, at = [], 0
                    for s, e in _spans(good, k, len(words)):
                        left += words[at:s]
                        at = e
                    left += words[at:]
                gone.append(len(words) - len(left))
                whole = b" ".join(left)
                kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
                wrong.append(bad)
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(wrong, pa.int32())], [*cols, "n_words", "n_removed", "kept", "wrong"])

    schema = ", ".join([*(f"c{i} {kind[c]}" for i, c in enumerate(keep)), "n_words long, n_removed long, kept string, wrong int"])
    done = materialise(stay.unionByName(go).mapInArrow(strip, schema), "stripped")
    discard(runs)
    discard(paths)
    if not strong and done.where("wrong > 0").limit(1).count():
        discard(done)
        return remove_repeats(docs, k, digest, strong=True)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_removed", F.col("kept").alias(last))
