"""Exact top-k search by inner product with an M-tree.

Inner product becomes a metric question by one more coordinate: with M the greatest norm, a vector x is stored as
(x, sqrt(M^2 - |x|^2)) and a query as (q, 0), so that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x falls as the product grows.

The vectors are cut into shards round pivots, so that what is near lies together; each shard is a paged M-tree, built once
and stored, whose nodes keep a routing vector, a covering radius and, for each entry, its distance to the routing vector
(the parent distance).  A query first asks the shard with the smallest bound; its k-th best score there then rules out
whole shards by their roots, and only the rest are asked, with that score to start from.  A tree is searched best first:
|d(q, parent) - d(entry, parent)| bounds an entry's distance from below without computing it, and a page whose bound is
beyond the k-th best so far is never opened.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise

PAGE = 64  # entries of a page
SHARD = 1 << 14  # vectors of one tree
QUERIES = 1 << 10  # queries of one block
SAMPLE, PIVOTS = 1 << 12, 1 << 10  # vectors that pivots are chosen from, and pivots, at most
ROOTS = 1 << 14  # roots sent at a time (8 MB at 64 components)


class MTree:
    """A bulk-loaded M-tree over integer vectors and their ids."""

    def __init__(self, vec: np.ndarray, ids: np.ndarray, page: int = PAGE, norm2: int | None = None):
        v = vec.astype(np.float64)
        self.vec, self.ids = vec, ids
        n2 = (v * v).sum(1)
        self.m2 = float(norm2 if norm2 is not None else n2.max(initial=0))
        self.point = np.c_[v, np.sqrt(np.maximum(0, self.m2 - n2))]
        self.nodes: list[tuple] = []  # (router, radius, children or rows, parent distances, child radii, is leaf)
        self.root = self._build(np.arange(len(ids)), page)[0] if len(ids) else -1
        del self.point  # the routers have what is needed of it

    def _build(self, rows: np.ndarray, page: int) -> tuple[int, np.ndarray, float]:
        centre = self.point[rows].mean(0)
        router = self.point[rows[((self.point[rows] - centre) ** 2).sum(1).argmin()]]
        d = np.sqrt(((self.point[rows] - router) ** 2).sum(1))
        radius = float(d.max())
        if len(rows) <= page or radius == 0:
            o = np.argsort(d, kind="stable")
            self.nodes.append((router, radius, rows[o], d[o], None, True))
            return len(self.nodes) - 1, router, radius
        fan = int(min(page, max(2, -(-len(rows) // page))))
        seeds = [int(d.argmax())]  # far-apart seeds, then every row to the nearest
        near = ((self.point[rows] - self.point[rows[seeds[0]]]) ** 2).sum(1)
        owner = np.zeros(len(rows), np.int64)
        while len(seeds) < fan and near.max() > 0:
            s = int(near.argmax())
            e = ((self.point[rows] - self.point[rows[s]]) ** 2).sum(1)
            owner[e < near] = len(seeds)
            near = np.minimum(near, e)
            seeds.append(s)
        parts = [rows[owner == k] for k in range(len(seeds))]
        kids = [self._build(p, page) for p in parts if len(p)]
        self.nodes.append((router, radius, np.array([k[0] for k in kids]), np.array([np.sqrt(((k[1] - router) ** 2).sum()) for k in kids]), np.array([k[2] for k in kids]), False))
        return len(self.nodes) - 1, router, radius

    def search(self, q: np.ndarray, qid: int | None, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k greatest products as (score, id), ties to the smaller id, without ``qid``; and the distances computed.

        Scores below ``floor`` are of no interest and may be left out.
        """
        if self.root < 0:
            return [], 0
        qv = q.astype(np.float64)
        qp, qq = np.append(qv, 0.0), float(qv @ qv)
        slack = 1e-7 * (1 + self.m2 + qq)  # of rounding; only ever opens a page too many
        least = lambda: best[0][0] if len(best) == k and (floor is None or best[0][0] > floor) else floor
        limit = lambda: np.inf if least() is None else np.sqrt(max(0.0, qq + self.m2 - 2 * least()) + slack)
        best: list[tuple[int, int, int]] = []  # a heap whose head is the worst kept: (score, -id)
        heap = [(0.0, self.root, float(np.sqrt(((qp - self.nodes[self.root][0]) ** 2).sum())))]
        done = 1
        while heap:
            bound, at, dq = heapq.heappop(heap)
            if bound > limit():
                break
            _, _, kids, dist, radii, leaf = self.nodes[at]
            if leaf:
                rows = kids[np.abs(dq - dist) <= limit()]
                done += len(rows)
                score = self.vec[rows] @ q
                kept = rows
                if least() is not None:
                    ok = score >= least()
                    kept, score = rows[ok], score[ok]
                for r, s in zip(kept.tolist(), score.tolist()):
                    i = int(self.ids[r])
                    if i == qid:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            else:
                ok = np.abs(dq - dist) - radii <= limit()
                kids, radii = kids[ok], radii[ok]
                done += len(kids)
                routers = np.array([self.nodes[c][0] for c in kids]).reshape(len(kids), -1)
                d = np.sqrt(((routers - qp) ** 2).sum(1)) if len(kids) else np.zeros(0)
                for c, x, r in zip(kids.tolist(), d.tolist(), radii.tolist()):
                    low = max(bound, x - r)
                    if low <= limit():
                        heapq.heappush(heap, (low, c, x))
        return sorted(((s, -i) for s, i in best), key=lambda t: (-t[0], t[1])), done


def quantise(df: DataFrame, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * component as double); rows with a null id, a null vector, or null or
    non-finite components are left out."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vec_id).isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("x"))


def _lifted(x: np.ndarray, m2: float) -> np.ndarray:
    v = x.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(0, m2 - (v * v).sum(1)))]


def _dense(col: pa.ChunkedArray | pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vector in a list column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(np.asarray(col.offsets))
    flat, start = col.values.to_numpy(), np.asarray(col.offsets)[:-1]
    out = []
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        out.append((d, rows, flat[start[rows][:, None] + np.arange(d)]))
    return out


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Of a sample of points ``count`` far from each other, one after the other."""
    own = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(own) < count and near.max() > 0:
        own.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[own[-1]]) ** 2).sum(1))
    return sample[own]


def _trees(v: DataFrame, n: int) -> tuple[DataFrame, dict[int, float]]:
    """The stored trees (tree, d, router, radius, blob), and the greatest squared norm of each length of vector."""
    spark = v.sparkSession
    norm = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    m2 = {r["d"]: float(r["m2"]) for r in v.groupBy(F.size("x").alias("d")).agg(F.max(norm).alias("m2")).toLocalIterator()}
    few = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    pivots = {d: _pivots(_lifted(x, m2[d]), min(PIVOTS, -(-n // SHARD))) for d, _, x in _dense(few["x"])} if few.num_rows else {}
    told = spark.sparkContext.broadcast((pivots, m2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, m2 = told.value
        for b in batches:
            cell, size = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int32)
            for d, rows, x in _dense(b.column(1)):
                size[rows] = d
                p = pivots.get(d)
                for a in range(0, len(rows), 4096) if p is not None else ():
                    own = _lifted(x[a : a + 4096], m2[d])
                    cell[rows[a : a + 4096]] = ((p * p).sum(1)[None] - 2 * own @ p.T).argmin(1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(size), pa.array(cell)], ["vec_id", "x", "d", "cell"])

    placed = materialise(v.select("vec_id", "x").mapInArrow(place, "vec_id long, x array<long>, d int, cell long"), "placed")
    shards = placed.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    sub = F.pmod(F.xxhash64("vec_id"), F.col("shards"))
    keyed = placed.join(F.broadcast(shards), ["d", "cell"]).withColumn("tree", F.concat_ws("-", *(c.cast("string") for c in (F.col("d"), F.col("cell"), sub))))

    def build(t: pa.Table) -> pa.Table:
        d, rows, x = _dense(t["x"])[0]
        tree = MTree(x, t["vec_id"].to_numpy()[rows], norm2=told.value[1][d])
        router, radius = tree.nodes[tree.root][:2]
        return pa.table({"tree": [t["tree"][0].as_py()], "d": pa.array([d], pa.int32()), "router": pa.array([router.tolist()], pa.list_(pa.float64())), "radius": [radius], "blob": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = materialise(keyed.select("tree", "vec_id", "x").groupBy("tree").applyInArrow(build, "tree string, d int, router array<double>, radius double, blob binary"), "trees")
    discard(placed)
    return trees, m2


def _ask(asked: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, done) for queries (query_id, x, floor, tree) against the trees they name; each pair of a
    query and a tree has one more row that gives the distances computed.

    A tree's queries come in blocks, so that many queries of one tree don't meet in one task.
    """
    blocks = asked.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    left = asked.join(blocks, "tree").select("query_id", "x", "floor", "tree", block)
    right = trees.join(blocks, "tree").select("tree", "blob", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(q: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and t.num_rows:
            tree = pickle.loads(t["blob"][0].as_py())
            ids, floor = q["query_id"].to_pylist(), q["floor"].to_pylist()
            for _, rows, x in _dense(q["x"]):
                for i, v in zip(rows.tolist(), x):
                    got, done = tree.search(v, ids[i], k, floor[i])
                    out += [(ids[i], c, s, 0) for s, c in got] + [(ids[i], None, None, done)]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score", "done"), cols)})

    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(search, "query_id long, vec_id long, score long, done long")


def _bounds(q: DataFrame, trees: DataFrame, m2: dict[int, float], first: bool) -> DataFrame:
    """(query_id, x, floor, tree, low): the trees that can hold a product of at least ``floor`` (or any, if that is null) with
    the query, and the least distance that their roots allow; with ``first`` only the one of these with the least."""
    spark, out = q.sparkSession, None
    roots = trees.select("tree", "d", "router", "radius")
    slices = max(1, -(-roots.count() // ROOTS))
    for s in range(slices):
        got = roots.where(F.pmod(F.xxhash64("tree"), F.lit(slices)) == s).orderBy("tree").toArrow()
        names, size = np.array(got["tree"].to_pylist()), got["d"].to_numpy()
        own = {d: (names[size == d], np.array([got["router"][i].as_py() for i in np.flatnonzero(size == d)]), got["radius"].to_numpy()[size == d]) for d in np.unique(size).tolist()}
        told = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for b in batches:
                floor = b.column(2)
                some, tree, low = [np.zeros(0, np.int64)], [np.zeros(0, "U1")], [np.zeros(0)]
                for d, rows, x in _dense(b.column(1)):
                    if d not in told.value:
                        continue
                    names, router, radius = told.value[d]
                    v = np.c_[x.astype(np.float64), np.zeros(len(x))]
                    qq = (v * v).sum(1)
                    for a in range(0, len(rows), 512):
                        r = rows[a : a + 512]
                        dist = np.sqrt(np.maximum(0, qq[a : a + 512, None] + (router * router).sum(1)[None] - 2 * v[a : a + 512] @ router.T))
                        slack = 1e-6 * (1 + np.sqrt(m2[d]) + np.sqrt(qq[a : a + 512]))[:, None]
                        bound = np.maximum(0, dist - radius[None] - slack)
                        least = floor.take(pa.array(r)).to_numpy(zero_copy_only=False).astype(float)
                        reach = np.sqrt(np.maximum(0, qq[a : a + 512] + m2[d] - 2 * least))
                        ok = np.isnan(least)[:, None] | (bound <= reach[:, None] + slack)
                        if first:
                            best = np.lexsort((dist, bound), axis=1)[:, 0]
                            ok = np.zeros_like(ok)
                            ok[np.arange(len(r)), best] = True
                        i, j = np.nonzero(ok)
                        some.append(r[i])
                        tree.append(names[j])
                        low.append(bound[i, j])
                own = pa.array(np.concatenate(some))
                yield pa.record_batch([b.column(0).take(own), b.column(1).take(own), floor.take(own), pa.array(np.concatenate(tree).astype(str)), pa.array(np.concatenate(low))], ["query_id", "x", "floor", "tree", "low"])

        part = q.select("query_id", "x", "floor").mapInArrow(run, "query_id long, x array<long>, floor long, tree string, low double")
        out = part if out is None else out.unionByName(part)
    if first and slices > 1:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("low", "tree"))).where("__n = 1").drop("__n")
    return out


def _found(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    v = materialise(vectors.select("vec_id", "x"), "vectors")
    trees, m2 = _trees(v, v.count())
    q = materialise(queries.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "x", F.lit(None).cast("long").alias("floor")), "queries")
    near = materialise(_bounds(q, trees, m2, True), "nearest")
    one = materialise(_ask(near, trees, k), "found")
    # the k-th best score so far of each query: what can't reach it needn't be looked at
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = one.where("vec_id is not null").withColumn("__n", F.row_number().over(place)).where(F.col("__n") == k).select("query_id", F.col("score").alias("floor"))
    left = _bounds(q.drop("floor").join(kth, "query_id", "left"), trees, m2, False)
    left = left.join(near.select("query_id", "tree"), ["query_id", "tree"], "left_anti")
    return one.unionByName(_ask(left, trees, k))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` greatest inner products over all rows but its own id.

    Both inputs have (vec_id long, x array<long>); further columns are not looked at.  Ties go to the smaller vec_id, ranks
    count from 1; with fewer candidates all are given.  Vectors of another length than the query's are no candidates.  Of
    repeated ids every copy of a candidate counts, and a repeated query is asked once.  An empty table gives no rows.  Scores
    are exact as long as the sum of any partial products stays within 64 bits and squared norms within 53.  Neither side
    is broadcast; what is sent to all tasks are pivots (at most ``PIVOTS``) and roots of trees (at most ``ROOTS`` at a time).
    """
    found = _found(vectors, queries, k).where("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
