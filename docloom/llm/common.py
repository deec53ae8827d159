"""Shared pieces: shared-folder tables, Arrow batch slicing, vectorised word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


# --- tables in the shared folder -------------------------------------------------------------

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors
    cost a re-read instead of a recomputation.

    ``instead_of``, a table made by this function that nothing reads any more once ``df`` is written, is deleted.
    Whatever else an application leaves goes with ``clean_up`` or when its driver ends.  The shuffles of the write go with
    it, rather than when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    told = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if told is None else spark.conf.set(_CLEANUP, told)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    if instead_of is not None:
        discard(instead_of)
    if not _at_exit:
        _at_exit.append(True)
        atexit.register(_clean_at_exit)
    return out


_at_exit: list[bool] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise``; other frames are left alone."""
    if path := getattr(df, "_docloom_path", None):
        _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables and models this application has left in the shared folder."""
    _delete(spark, _folder(spark))


def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clean_up(spark)


def stored(spark: SparkSession, name: str, make: Callable[[], bytes]) -> bytes:
    """What ``make`` gives, made once: kept as a one-row table in the application's part of the shared folder."""
    path = f"{_folder(spark)}/models/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([(make(),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return bytes(spark.read.parquet(path).first().model)


def bounded_rows(df: DataFrame, key: str, rows: int, max_bytes: int) -> list[tuple]:
    """The rows of ``df`` with the smallest values of ``key``, at most ``rows`` of them and together of at most
    ``max_bytes`` by the column ``size``; a row that doesn't fit any more is passed over.  Only ``rows`` short rows
    come to the driver."""
    out, total = [], 0
    for r in df.orderBy(key, "size").limit(rows).toLocalIterator():
        if total + r["size"] <= max_bytes:
            out.append(r)
            total += r["size"]
    return out


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """About how many bytes ``df`` has; only ever used to choose a number of partitions.

    Catalyst's estimate (file sizes for a scan) will do; where it has none, the texts are measured.
    """
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return told if told < 1 << 50 else int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def parts_for(n_bytes: float, per_part: int = 16 << 20, least: int = 8) -> int:
    return int(max(least, -(-n_bytes // per_part)))


def sized(df: DataFrame, n_bytes: float, *keys: str, per_part: int = 32 << 20) -> DataFrame:
    """``df`` by its keys in partitions of about ``per_part`` bytes, where the session's number of shuffle partitions would make
    larger ones; what is grouped or joined by these keys next isn't moved again.  Smaller data is left to adaptive
    execution."""
    n = parts_for(n_bytes, per_part, 1)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


# --- Arrow -----------------------------------------------------------------------------------


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def trim_memory() -> None:
    """Give freed memory back: a worker is used for one stage after the other, and would keep the most that any has needed."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library: memory stays with the worker
    _LIBC = None


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text: (first row, end row, bytes, offsets).

    Null texts count as empty; no text is ever cut.
    """
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    trim_memory()


# --- words and hashes ------------------------------------------------------------------------


def _table(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([keep(b) for b in range(256)])


SPACE_SEPARATED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_pows: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pows[0]) < n + 1:
        m = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                p = np.full(m, U64(base))
                p[0] = 1
                _pows[k] = np.cumprod(p, dtype=U64)
    return _pows[0], _pows[1]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + U64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def word_spans(buf: np.ndarray, off: np.ndarray, keep: np.ndarray = SPACE_SEPARATED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in concatenated texts, and per text the index of its first word (n + 1 values).

    ASCII separators never occur inside a multi-byte UTF-8 character, so bytes give the words of code points.
    """
    w = keep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    prev = np.zeros(len(buf), bool)
    prev[1:] = w[:-1]
    start = np.flatnonzero(w & (~prev | edge[:-1]))
    nxt = np.zeros(len(buf), bool)
    nxt[:-1] = w[1:]
    end = np.flatnonzero(w & (~nxt | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, block: int = 1 << 19) -> np.ndarray:
    """64-bit hash of every word: differences of a polynomial prefix hash, in blocks so that memory stays flat."""
    out = np.empty(len(start), U64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + block, "right")))
            lo, hi = int(start[a]), int(end[b - 1])
            piece = buf[lo:hi]
            pw, inv = _powers(hi - lo)
            h = np.zeros(hi - lo + 1, U64)
            np.cumsum(((LOWER[piece] if lower else piece).astype(U64) + U64(1)) * pw[: hi - lo], out=h[1:])
            s, e = start[a:b] - lo, end[a:b] - lo
            out[a:b] = (h[e] - h[s]) * inv[s]
            a = b
    return mix64(out)


def grams(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each index on (last k - 1 entries dropped; text borders are the caller's affair)."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, U64((salt * 0xD6E8FEB86659FD93 + k) & (2**64 - 1)))
    with np.errstate(over="ignore"):
        c = U64((0xA0761D6478BD642F + 2 * salt) | 1)
        for j in range(k):
            h = h * c + words[j : j + n]
    return mix64(h, salt)


# --- connected components --------------------------------------------------------------------


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, by hooking and pointer jumping."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        if not (lo < hi).any():
            return nodes, nodes[root]
        np.minimum.at(root, hi, lo)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt


def components(edges: DataFrame, small: int = 2_000_000) -> DataFrame:
    """(node, component) for edges (a, b) of longs; a component is named by its smallest node.

    Up to ``small`` edges (32 MB) are joined in one task; more are contracted by alternating large-star and
    small-star rounds, each a pair of grouped aggregations whose result is written before the next.
    Null ends and self-loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = materialise(e, "edges")
    n = e.count()  # counted on the written table
    if n <= small:

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if got:
                node, comp = _union(*(np.concatenate(x) for x in zip(*got)))
                yield pa.record_batch([pa.array(node), pa.array(comp)], ["node", "component"])

        return e.coalesce(1).mapInArrow(one, "node long, component long")
    before, last = None, e
    while True:
        # large star: every node's larger neighbours are linked to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node and its smaller neighbours are linked to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a")
        e = e.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = last = materialise(e, "stars", last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# --- labels ----------------------------------------------------------------------------------


def crc_mod(df_col: str, m: int):
    return F.crc32(F.col(df_col).cast("string").cast("binary")) % m


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int, max_bytes: int = 64 << 20):
    """At most ``bound`` labelled documents, of at most ``max_bytes`` of text, to learn from: (texts, labels, langs) on the driver.

    Only rows whose crc32(doc_id as text) mod ``modulus`` isn't ``held_out`` are looked at.  The sample is the
    rows of smallest hash, so it is the same at every run; its size is bounded, hence the broadcast.
    """
    pick = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_y"))
        .where(crc_mod("doc_id", modulus) != held_out)
        .select("_y", F.xxhash64("doc_id").alias("_h"))
        .orderBy("_h")
        .limit(bound)
    )
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    mine = docs.select(F.xxhash64("doc_id").alias("_h"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang"))
    sized = mine.select("_h", F.octet_length("text").alias("size")).join(F.broadcast(pick), "_h")
    chosen = [(r["_h"], r["_y"]) for r in bounded_rows(sized, "_h", bound, max_bytes)]
    got = mine.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "_h long, _y int").dropDuplicates(["_h"])), "_h").dropDuplicates(["_h"])
    got = got.toArrow().sort_by("_h")
    return got["text"].to_pylist(), np.array(got["_y"].to_pylist(), float), got["lang"].to_pylist()


def sub_batch(batch: pa.RecordBatch, extra: dict[str, pa.Array], keep: list[str]) -> pa.RecordBatch:
    cols = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.record_batch([*cols, *extra.values()], [*keep, *extra])


def env_single_thread() -> None:
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(k, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
