"""Queries on files: sources of all formats, sinks read back, stores, the whole pipeline, streams.

The files are made from the table of nations, in the shared folder, since the tables come as Parquet only.
"""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import extraction as X
from docloom.operators import store as S
from docloom.operators.domains import DOMAINS
from docloom.operators.providers import checked
from docloom.plans import knowledge
from docloom.plans.catalog import query, table
from docloom.plans.entity_queries import _MENTIONS, _RAW, _raw_events
from docloom.plans.graph_queries import PARTS, parts
from docloom.plans.stream_queries import _shared
from docloom.sources import documents as D
from docloom.sources import pages as P
from docloom.sources import sinks as K
from docloom.sources.pdf import write_text
from docloom.streaming import refresh as R


def _place(spark: SparkSession, name: str) -> str:
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(data)
    out.close()


def _docx(*paragraphs: str) -> bytes:
    raw = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return raw.getvalue()


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each nation in a file: text with a byte-order mark, Latin-1 Markdown, a document, rich text, an unknown kind, a blank."""
    at = _place(spark, "files")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():  # 25 rows
        k, name = r.n_nationkey, r.n_name
        ext, data = (
            ("txt", "﻿" + name + "  of  texts\nline " + str(k)), ("md", (name + " é").encode("latin-1")), ("docx", _docx(name, " ", "second")), ("rtf", "{\\rtf1{\\fonttbl{\\f0 X;}}" + name + "\\par caf\\'e9}"), ("xyz", name), ("txt", " \n "),
        )[k % 6]
        _put(spark, f"{at}/n{k}.{ext}", data.encode() if isinstance(data, str) else data)
    return D.read_files(spark, at)


_NAME = "CASE n_nationkey % 6 WHEN 0 THEN 'n' || n_nationkey || '.txt' WHEN 1 THEN 'n' || n_nationkey || '.md' WHEN 2 THEN 'n' || n_nationkey || '.docx' WHEN 3 THEN 'n' || n_nationkey || '.rtf' WHEN 4 THEN 'n' || n_nationkey || '.xyz' ELSE 'n' || n_nationkey || '.txt' END"


def _file() -> Column:
    return F.regexp_extract("source_file", "([^/]*)$", 1).alias("file")


@query(f"""SELECT {_NAME} AS file, CASE n_nationkey % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'docx' ELSE 'rtf' END AS file_type,
CASE n_nationkey % 6 WHEN 0 THEN n_name || ' of texts' || chr(10) || 'line ' || n_nationkey WHEN 1 THEN n_name || ' é' WHEN 2 THEN n_name || chr(10) || chr(10) || 'second' ELSE n_name || chr(10) || 'café' END AS content
FROM nation WHERE n_nationkey % 6 < 4""")
def files_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)[0].select(_file(), "file_type", "content")


@query(f"SELECT {_NAME} AS file, CASE n_nationkey % 6 WHEN 4 THEN 'unsupported extension' ELSE 'blank or too large' END AS error FROM nation WHERE n_nationkey % 6 >= 4")
def files_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)[1].select(_file(), "error")


@query("SELECT CASE WHEN n_nationkey % 6 < 4 THEN 'success' ELSE 'failed' END AS status, count(*) AS n FROM nation GROUP BY 1")
def files_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.load_status(*_files(spark, sf_dir)).withColumnRenamed("count", "n")


@query("SELECT page_id, regexp_matches(lower(url || '.' || page_id % 3), '\\.(docx|md|pdf|rtf|txt)$') AS plain, page_id % 2 = 0 AS dressed FROM pages")
def file_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    plain = D.is_supported(F.concat("url", F.lit("."), (F.col("page_id") % 3).cast("string")))
    dressed = D.is_supported(F.concat(F.lit("/a.b/x"), F.when(F.col("page_id") % 2 == 0, F.lit(".DOCX")).otherwise(F.lit(".doc"))))
    return p.select("page_id", plain.alias("plain"), dressed.alias("dressed"))


@query("SELECT 'text' AS file_type, r_name AS source_file, r_name || ' ' || r_regionkey AS content FROM region")
def texts_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.r_name, f" {r.r_name} \t {r.r_regionkey}\n") for r in table(spark, sf_dir, "region").toLocalIterator()]
    return D.from_texts(spark, rows).select("file_type", "source_file", "content")


@query("SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 3")
def json_rows_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities stored as a file each; files that are broken are left out."""
    at = _place(spark, "json")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator():
        _put(spark, f"{at}/{r.n_nationkey}.json", (f'{{"id": "n{r.n_nationkey}",\n "name": "{r.n_name}"}}' if r.n_nationkey % 4 != 3 else '{"id": ').encode())
    return S.read_json_rows(spark, at, "id string, name string")


@query("SELECT 'n_' || n_regionkey AS document, printf('chunk_%03d', n_nationkey) AS chunk, n_name AS value FROM nation")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "chunks")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), F.col("n_regionkey").cast("string")).alias("doc_id"), F.col("n_nationkey").cast("int").alias("chunk_id"), F.col("n_name").alias("text"))
    K.write_chunk_files(n, at)
    return spark.read.text(at).select("document", "chunk", "value")


@query("SELECT 'd_' || n_regionkey AS document, CAST(n_nationkey AS INTEGER) AS page, n_name || CASE WHEN n_regionkey = 1 THEN ' again' ELSE '' END AS text FROM nation")
def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages foldered by document, one document written again; what is there of the others stays."""
    at = _place(spark, "pages")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("d:"), F.col("n_regionkey").cast("string")).alias("doc_id"), F.col("n_nationkey").cast("int").alias("page"), F.col("n_name").alias("text"))
    K.write_pages(n, at)
    K.write_pages(n.where("doc_id = 'd:1'").withColumn("text", F.concat("text", F.lit(" again"))), at)
    return spark.read.parquet(at).select("document", "page", "text")


@query("SELECT n_name AS prompt_preview, CAST(length(n_name) AS INTEGER) AS prompt_length, CASE WHEN n_regionkey > 0 THEN 2 END AS reply_length, CASE WHEN n_regionkey = 0 THEN 'timeout' END AS error FROM nation")
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "calls")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("prompt"), F.when(F.col("n_regionkey") > 0, F.lit("ok")).alias("reply"), F.when(F.col("n_regionkey") == 0, F.lit("timeout")).alias("error"))
    K.call_log(n.where("error is null"), at)
    K.call_log(n.where("error is not null"), at)
    return spark.read.parquet(at).select("prompt_preview", "prompt_length", "reply_length", "error")


@query("SELECT * FROM (VALUES ('all', true), ('no model', false), ('blank prompt', false)) t(config, accepted)")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, c in (("all", {"model": "m", "vision_prompt": "p"}), ("no model", {"vision_prompt": "p"}), ("blank prompt", {"model": "m", "vision_prompt": " "})):
        try:
            checked(c)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "config string, accepted boolean")


@query(f"WITH {_MENTIONS} SELECT (SELECT count(*) FROM ok) AS entities, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM ok) AS relations")
def knowledge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from documents to a graph, each a table that a second run finds and doesn't make again."""
    at = _place(spark, "graph")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = knowledge.build(spark, docs, at, ["literary"], strategy="line")
    again = knowledge.build(spark, docs.limit(0), at, ["literary"], strategy="line")
    store = knowledge.save(spark, again, f"{at}/store")
    meta = store.metadata().select("entities", "chunks", "relations")
    return meta.intersect(first.status().select("entities", "chunks", "relations"))


@query(f"SELECT 2 AS versions, count(*) AS rows FROM ({PARTS})")
def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version made the latest again after a later one; of all only as many as are kept stay."""
    s = S.Store(spark, _place(spark, "store"), keep=2)
    p = parts(spark, sf_dir)
    first = s.save("entities", p)
    s.save("entities", p.limit(1))
    s.restore("entities", first)
    return s.load("entities").agg(F.lit(len(s.versions("entities"))).alias("versions"), F.count(F.lit(1)).alias("rows"))


@query(f"""WITH {_RAW} SELECT event_id, name, type FROM cl WHERE type IN ({', '.join(repr(t) for t in DOMAINS['literary'].types)}) AND confidence >= CASE type WHEN 'CHARACTER' THEN 0.4 ELSE 0.6 END AND NOT starts_with(name, 'c')""")
def entity_validate_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain's own predicate beside the common rules."""
    rows = X.validate(_raw_events(spark, sf_dir), list(DOMAINS["literary"].types), hook=lambda r: ~F.startswith("name", F.lit("c")))
    return rows.select("event_id", "name", "type")


@query("SELECT strftime(time_bucket(INTERVAL 5 minutes, ts), '%Y-%m-%d %H:%M:%S') AS at, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows over the events as a stream; each batch's windows are written, and merged when read."""
    at = _place(spark, "windows")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    write = lambda rows, batch: R.windowed_counts(rows).write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")
    R.each_batch(stream, write, f"{at}/state", every=None).awaitTermination()
    got = spark.read.parquet(f"{at}/rows").groupBy(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type")
    return got.agg(F.sum("n").alias("n"))


@query("SELECT sha256(n_name) AS doc_id, n_name AS text FROM nation")
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of arriving text files as a document; files of the same names in a second run add nothing."""
    at = _place(spark, "lines")
    table(spark, sf_dir, "nation").select("n_name").repartition(3).write.text(f"{at}/in")
    for _ in range(2):
        R.each_batch(R.lines_as_documents(spark, f"{at}/in"), R.append_once(f"{at}/rows", ["doc_id"]), f"{at}/state", every=None).awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("doc_id", "text")


@query("SELECT 'p' || page_id AS path, CASE page_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'changed' END AS change FROM pages WHERE page_id % 5 < 3")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reload has to do between two listings of a folder."""
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 5).alias("k"))
    before = p.where("k <> 0").select("path", F.lit(1).alias("modified"))
    after = p.where("k <> 1").select("path", F.when(F.col("k") == 2, F.lit(2)).otherwise(F.lit(1)).alias("modified"))
    return R.changes(before, after.union(after))


# --- PDF -----------------------------------------------------------------------------------------


def _pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region (path, content): a page for each of its nations, of two lines, and the names as outline."""

    def make(batches):
        import pyarrow as pa

        for b in batches:
            files = [write_text([[name, f"page of {name}"] for name in names], [(name, i) for i, name in enumerate(names)]) for names in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(files, pa.binary())], ["path", "content"])

    names = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.mapInArrow(make, "path string, content binary")


_NTH = "SELECT 'r' || n_regionkey AS source_file, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS page FROM nation"


@query(f"SELECT source_file, page, n_name || chr(10) || 'page of ' || n_name AS text, 595.0::DOUBLE AS width, round(1200 / 595.0, 6)::DOUBLE AS zoom FROM ({_NTH})")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan(_pdfs(spark, sf_dir), P.read_pages, P.PAGES).select("source_file", "page", "text", "width", F.round("zoom", 6).alias("zoom"))


@query(f"SELECT source_file, page AS ord, 1 AS level, n_name AS title, page + 1 AS page FROM ({_NTH})")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan(_pdfs(spark, sf_dir), P.read_outline, P.OUTLINE).select("source_file", "ord", "level", "title", "page")


@query(f"SELECT source_file, page, ord, CASE ord WHEN 0 THEN n_name ELSE 'page of ' || n_name END AS text, CAST(CASE ord WHEN 0 THEN 16 ELSE 11 END AS DOUBLE) AS font_size, CASE ord WHEN 0 THEN 16 ELSE 0 END AS flags FROM ({_NTH}), (VALUES (0), (1)) o(ord)")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan(_pdfs(spark, sf_dir), P.read_lines, P.LINES).select("source_file", "page", "ord", "text", "font_size", "flags")


@query("""WITH n AS (SELECT n_regionkey AS k, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey)
SELECT 'r' || k AS path, s AS section, CASE WHEN s = 0 THEN array_to_string(list_transform(names[2:3], lambda x: x || chr(10) || 'page of ' || x), chr(12)) END AS text,
CASE s WHEN 1 THEN 'ValueError: start after end' WHEN 2 THEN 'ValueError: out of range' END AS error FROM n, (VALUES (0), (1), (2)) t(s)""")
def pdf_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges as files of their own, read again; ranges that can't be are refused."""
    files = _pdfs(spark, sf_dir)
    wanted = files.select("path").join(spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 3, 99)], "section int, start_page int, end_page int"))
    cut = P.cut_pages(files, wanted)
    read = P.scan(cut.where("error is null").select(F.concat_ws("/", "path", F.col("section").cast("string")).alias("path"), "content"), P.read_pages, P.PAGES)
    text = read.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\f").alias("text"))
    return cut.join(text, F.concat_ws("/", "path", F.col("section").cast("string")) == F.col("source_file"), "left").select("path", "section", "text", "error")


@query(f"SELECT source_file, page, CASE WHEN page % 2 = 0 THEN 'Text' END AS label, CASE WHEN page % 2 = 1 THEN 'ValueError: page ' || page END AS error FROM ({_NTH})")
def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by a stand-in for a layout model that fails on every second page: those are rows with an error."""

    def reader(data: bytes):
        pages = iter(range(1_000_000))

        def detect(images):
            if len(images) > 1:
                raise ValueError("one at a time")
            n = next(pages)
            if n % 2:
                raise ValueError(f"page {n}")
            return [[{"x1": 0.0, "y1": 0.0, "x2": 1.0, "y2": 1.0, "label": "Text", "confidence": 0.9}]]

        return P.layout_reader(detect)(data)

    return P.scan(_pdfs(spark, sf_dir), reader, P.BOXES).select("source_file", "page", "label", "error")


@query("""SELECT 'r' || n_regionkey AS source_file, string_agg(n_name || chr(10) || 'page of ' || n_name, chr(10) || chr(10) ORDER BY n_name) AS content, CAST(count(*) AS VARCHAR) AS pages FROM nation GROUP BY n_regionkey""")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files through the document reader."""
    at = _place(spark, "pdf")
    for r in _pdfs(spark, sf_dir).toLocalIterator():  # five small files
        _put(spark, f"{at}/{r.path}.pdf", bytes(r.content))
    docs = D.read_files(spark, at, "*.pdf")[0]
    return docs.select(F.regexp_extract("source_file", "([^/]*).pdf$", 1).alias("source_file"), "content", F.col("metadata")["page_count"].alias("pages"))
