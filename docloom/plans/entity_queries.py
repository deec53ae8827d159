"""Queries on extraction, validation and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import replies as R
from docloom.functions import text as T
from docloom.operators import extraction as X
from docloom.operators.domains import DOMAINS, THRESHOLDS
from docloom.operators.providers import RuleClassifier
from docloom.plans.catalog import query, table, trim_sql
from docloom.plans.chunk_queries import _CHUNK_LINE, chunk_line

TYPES = list(DOMAINS["literary"].types)
_MENTIONS = f"""ch AS ({_CHUNK_LINE}),
m AS (SELECT doc_id, chunk_id, 'CHARACTER' AS type, unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS name FROM ch
 UNION ALL SELECT doc_id, chunk_id, 'ADDRESS', unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+')) FROM ch
 UNION ALL SELECT doc_id, chunk_id, 'DATE', unnest(regexp_extract_all(text, '[0-9]{{2,}}')) FROM ch),
v AS (SELECT doc_id, chunk_id, name, type, round(least(1.0, length(name) / 10.0), 3) AS confidence FROM m),
ok AS (SELECT * FROM v WHERE length(name) BETWEEN 2 AND 100 AND confidence >= 0.2
       AND confidence >= CASE type WHEN 'CHARACTER' THEN 0.4 WHEN 'ADDRESS' THEN 0.5 WHEN 'DATE' THEN 0.6 ELSE 0.3 END)"""


@query(f"WITH {_MENTIONS} SELECT * FROM ok")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.mentions(chunk_line(spark, sf_dir))
    return X.second_gate(X.validate(found, TYPES)).select("doc_id", "chunk_id", "name", "type", "confidence")


@query(f"WITH {_MENTIONS} SELECT type, count(*) AS n FROM ok GROUP BY type")
def entity_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_extract(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    name = F.concat(F.lit(" \t"), F.when(i % 11 == 0, F.lit("")).otherwise(F.concat("event_type", F.col("user_id").cast("string"))), F.lit("\n"))
    kind = F.when(i % 3 == 0, F.lit(" character")).when(i % 3 == 1, F.lit("Date ")).otherwise(F.lit("UNHEARD"))
    conf = F.when(i % 5 == 0, F.lit("bad")).when(i % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("0."), (i % 100 + 100).cast("string")))
    conf = F.when(i % 13 == 0, F.lit("7.5")).otherwise(conf)
    aliases = F.when(i % 4 == 0, F.lit(None).cast("array<string>")).otherwise(F.array(F.upper("event_type"), F.lit(" x "), F.lit("x"), F.lit(""), F.upper(F.concat("event_type", F.col("user_id").cast("string")))))
    return e.select("event_id", name.alias("name"), kind.alias("type"), F.lit(None).cast("string").alias("description"), conf.alias("confidence"), aliases.alias("aliases"), F.lit(None).cast("string").alias("evidence"))


_RAW = f"""raw AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || CAST(user_id AS VARCHAR) END AS name,
  CASE event_id % 3 WHEN 0 THEN 'CHARACTER' WHEN 1 THEN 'DATE' ELSE 'UNHEARD' END AS type,
  CASE WHEN event_id % 13 = 0 THEN '7.5' WHEN event_id % 5 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN NULL ELSE '0.' || CAST(event_id % 100 + 100 AS VARCHAR) END AS c,
  CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 11 = 0 THEN [upper(event_type), 'x', upper(event_type || CAST(user_id AS VARCHAR))] ELSE [upper(event_type), 'x'] END AS aliases FROM events),
cl AS (SELECT event_id, name, type, greatest(0.0, least(1.0, coalesce(TRY_CAST(c AS DOUBLE), 0.5))) AS confidence, aliases FROM raw WHERE length(name) BETWEEN 2 AND 100)"""


@query(f"""WITH {_RAW} SELECT event_id, name, type, confidence, array_to_string(aliases, '|') AS aliases FROM cl
WHERE type IN ({', '.join(repr(t) for t in TYPES)}) AND confidence >= CASE type WHEN 'CHARACTER' THEN 0.4 ELSE 0.6 END""")
def entity_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.validate(_raw_events(spark, sf_dir), TYPES).select("event_id", "name", "type", "confidence", F.array_join("aliases", "|").alias("aliases"))


@query(f"WITH {_RAW} SELECT event_id, name, type, confidence FROM cl WHERE confidence >= CASE type WHEN 'CHARACTER' THEN 0.3 WHEN 'DATE' THEN 0.5 ELSE 0.2 END")
def entity_validate_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a domain: any type, thresholds a tenth lower."""
    return X.validate(_raw_events(spark, sf_dir)).select("event_id", "name", "type", "confidence")


_DOMAIN = """dm AS (SELECT doc_id, unnest(CASE WHEN source = 'src0' THEN [f, 'simple'] ELSE [f] END) AS domain FROM
 (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'literary' WHEN 'de' THEN 'financial' WHEN 'fr' THEN 'owu' ELSE 'simple' END AS f FROM documents))"""


@query(f"WITH {_DOMAIN} SELECT domain, count(*) AS n FROM dm GROUP BY domain")
def entity_domain_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return X.fan_out(docs, RuleClassifier().domains(F.col("lang"), F.col("source"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_MENTIONS}, {_DOMAIN},
a AS (SELECT domain, count(*) AS raw FROM v JOIN dm USING (doc_id) GROUP BY domain),
b AS (SELECT domain, count(*) AS valid FROM ok JOIN dm USING (doc_id) WHERE confidence >= 0.3 GROUP BY domain)
SELECT domain, raw, CAST(coalesce(valid, 0) AS BIGINT) AS valid, CAST(raw - coalesce(valid, 0) AS BIGINT) AS rejected FROM a LEFT JOIN b USING (domain)""")
def extraction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    domains = X.fan_out(docs, RuleClassifier().domains(F.col("lang"), F.col("source"))).select("doc_id", "domain")
    raw = X.mentions(chunk_line(spark, sf_dir)).join(domains, "doc_id")
    return X.stats(raw, X.second_gate(X.validate(raw, TYPES)))


@query(f"""WITH n AS (SELECT doc_id, text, regexp_extract(text, '[A-Z][a-z]{{3,}}') AS name FROM documents),
p AS (SELECT *, strpos(lower(text), lower(name)) AS ps FROM n)
SELECT doc_id, name, CASE WHEN name <> '' AND ps > 0 THEN {trim_sql('substr(text, greatest(1, ps - 100), least(length(text), ps + length(name) - 1 + 100) - greatest(1, ps - 100) + 1)')} ELSE '' END AS context FROM p""")
def mention_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", "[A-Z][a-z]{3,}", 0).alias("name"))
    return d.select("doc_id", "name", T.around(F.col("text"), F.col("name")).alias("context"))


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("event_id") % 5, F.col("props")
    said = F.when(k == 0, F.concat(F.lit("Sure.\n```json\n"), p, F.lit("\n```\nDone"))).when(k == 1, p).when(k == 2, F.concat(F.lit("```\n"), p, F.lit("\n```"))).when(k == 3, F.concat(F.lit("It is "), p, F.lit(" then"))).otherwise(F.lit("{no"))
    return table(spark, sf_dir, "events").select("event_id", said.alias("reply"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def llm_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir).select("event_id", F.get_json_object(R.robust_json(F.col("reply")), "$.k").cast("int").alias("k"))


@query("SELECT event_id, event_id % 5 IN (0, 2) AS fenced, CASE WHEN event_id % 5 < 3 AND event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events")
def llm_json_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reply")
    return _wrapped(spark, sf_dir).select("event_id", R.any_fence(r).isNotNull().alias("fenced"), F.get_json_object(R.simple_json(r, "k"), "$.k").cast("int").alias("k"))


@query("""SELECT event_id, event_type AS name, CAST(CASE WHEN event_id % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM events WHERE event_id % 3 <> 2""")
def llm_entity_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as an object in a fence, as a bare list, and broken."""
    k = F.col("event_id") % 3
    one = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "type": "CHARACTER", "confidence": '), F.when(F.col("event_id") % 2 == 0, F.lit("0.9")).otherwise(F.lit('"x"')), F.lit("}"))
    said = F.when(k == 0, F.concat(F.lit('```json\n{"entities": ['), one, F.lit('], "relationships": []}\n```'))).when(k == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"entities": ['), one))
    rows = X.from_replies(table(spark, sf_dir, "events").select("event_id", said.alias("reply")))
    return X.validate(rows, TYPES).select("event_id", "name", "confidence")


@query("SELECT p_partkey AS id, array_to_string(list_concat([p_brand], list_concat(CASE WHEN lower(p_type) <> lower(p_name) THEN [p_type] ELSE [] END, ['x'])), '|') AS aliases FROM part")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.array("p_name", F.upper("p_brand"), F.concat(F.lit(" "), "p_type"), F.lit(" x "), F.lit(""), F.lit("X"))
    merged = X.merge_aliases(F.array("p_brand"), new, F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(merged, "|").alias("aliases"))


@query(f"SELECT type, CAST(coalesce(t, 0.3) AS DOUBLE) AS threshold FROM (SELECT DISTINCT upper(event_type) AS type FROM events UNION SELECT unnest({list(THRESHOLDS)})) LEFT JOIN (SELECT unnest({list(THRESHOLDS)}) AS type, unnest({list(THRESHOLDS.values())}) AS t) USING (type)")
def type_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.domains import threshold

    kinds = table(spark, sf_dir, "events").select(F.upper("event_type").alias("type")).union(spark.createDataFrame([(t,) for t in THRESHOLDS], "type string")).distinct()
    return kinds.select("type", threshold(F.col("type")).cast("double").alias("threshold"))
