"""The memory graph read from delivered tables: one row per id, cleaned labels, edges from verdicts.

``CTE`` is the same derivation in SQL, for the oracles: mem, ent, ses, men, lv and the edge tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.operators.graph import Graph
from lorekeep.runtime import clean, table

#: The moment that stands for "now" in registered queries.
AS_OF = "2026-01-01 00:00:00"
_MEMORY = (
    "id sessionid writekey content kind normalizedkind timestamp expiresat validfrom validto confidence salience status embedding".split()
)


def memories(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Memories, one row per id (deliveries of one id are equal but for their arrival), status cleaned."""
    cols = list(columns or _MEMORY)
    m = table(spark, d, "memories", *cols)
    if "status" in cols:
        m = m.withColumn("status", clean(F.col("status")))
    return m.dropDuplicates(["id"])


def mentions(spark: SparkSession, d: str) -> DataFrame:
    role = clean(F.col("role"))
    m = table(spark, d, "mentions", "memory_id", "entity_id", "role")
    m = m.withColumn("role", F.when(role.isin(*schema.ROLES), role).otherwise("context"))
    return m.groupBy("memory_id", "entity_id").agg(F.min("role").alias("role")).withColumn("editorrun", F.lit(None).cast("string"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """(lo, hi, verdict, similarity): the latest verdict of each unordered pair."""
    p = table(spark, d, "match_pairs").where("left_id <> right_id")
    p = p.groupBy(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi"))
    return p.agg(F.max_by(F.struct(clean(F.col("verdict")).alias("verdict"), "similarity"), F.struct("createdat", "pair_id")).alias("r")).select("lo", "hi", "r.*")


def load_graph(spark: SparkSession, d: str) -> Graph:
    none = F.lit(None).cast("string")
    mem = memories(spark, d).withColumns({"sessionboosted": F.lit(None).cast("boolean"), "confidencedecayedon": F.lit(None).cast("date"), "editorrun": none})
    ent = table(spark, d, "entities").drop("loadedat").withColumns({"embeddingtext": none, "editorrun": none})
    men = mentions(spark, d)
    v = verdicts(spark, d)
    edge = lambda rows, **more: rows.select(F.col("hi").alias("src_id"), F.col("lo").alias("dst_id"), *[c.alias(k) for k, c in more.items()], none.alias("editorrun"))
    of = lambda kind, what: v.where(F.col("lo").startswith(kind) & (F.col("verdict") == what))
    rel = edge(of("mem", "related"), type=F.lit("supports"), weight=F.col("similarity")).unionByName(
        edge(of("mem", "unsure"), type=F.lit("contradicts"), weight=F.col("similarity"))
    )
    ends = men.groupBy("memory_id").agg(F.min("entity_id").alias("src_id"), F.max("entity_id").alias("dst_id")).where("src_id <> dst_id")
    links = ends.select("src_id", "dst_id").distinct().select(
        "src_id", "dst_id", F.lit("knows").alias("relation"), F.lit("").alias("detail"), F.lit("neutral").alias("sentiment"),
        F.lit(0.5).alias("strength"), F.lit(True).alias("active"), none.alias("editorrun"),
    )
    incat = mem.where("normalizedkind is not null").select(F.col("id").alias("memory_id"), F.col("normalizedkind").alias("category"), F.lit(1.0).alias("score"))
    return Graph(
        memory=mem, entity=ent, session=table(spark, d, "sessions"), mentions=men, relates_to=rel, canonical=edge(of("mem", "duplicate")),
        supersedes=edge(of("mem", "update")), linked_to=links, merged_into=edge(of("ent", "same")), distinct_from=edge(of("ent", "different")),
        in_category=incat, category=incat.select(F.col("category").alias("name")).distinct(),
    )


CTE = """
WITH RECURSIVE mem AS (
  SELECT DISTINCT ON (id) id, sessionid, writekey, content, kind, normalizedkind, timestamp, expiresat, validfrom, validto,
    confidence, salience, lower(trim(status)) AS status, embedding FROM memories),
ent AS (SELECT * FROM entities), ses AS (SELECT * FROM sessions),
men AS (
  SELECT memory_id, entity_id, min(CASE WHEN lower(trim(role)) IN ('subject', 'object', 'context', 'source')
    THEN lower(trim(role)) ELSE 'context' END) AS role FROM mentions GROUP BY 1, 2),
lv AS (
  SELECT lo, hi, verdict, similarity FROM (
    SELECT least(left_id, right_id) AS lo, greatest(left_id, right_id) AS hi, lower(trim(verdict)) AS verdict, similarity,
      row_number() OVER (PARTITION BY least(left_id, right_id), greatest(left_id, right_id)
        ORDER BY createdat DESC NULLS LAST, pair_id DESC) AS rn
    FROM match_pairs WHERE left_id <> right_id) WHERE rn = 1),
canon AS (SELECT hi AS src_id, lo AS dst_id FROM lv WHERE starts_with(lo, 'mem') AND verdict = 'duplicate'),
rel AS (
  SELECT hi AS src_id, lo AS dst_id, CASE verdict WHEN 'related' THEN 'supports' ELSE 'contradicts' END AS type
  FROM lv WHERE starts_with(lo, 'mem') AND verdict IN ('related', 'unsure')),
sup AS (SELECT hi AS src_id, lo AS dst_id FROM lv WHERE starts_with(lo, 'mem') AND verdict = 'update'),
mrg AS (SELECT hi AS src_id, lo AS dst_id FROM lv WHERE starts_with(lo, 'ent') AND verdict = 'same'),
dif AS (SELECT hi AS src_id, lo AS dst_id FROM lv WHERE starts_with(lo, 'ent') AND verdict = 'different'),
lnk AS (
  SELECT DISTINCT src_id, dst_id, 'knows' AS relation FROM (
    SELECT memory_id, min(entity_id) AS src_id, max(entity_id) AS dst_id FROM men GROUP BY 1) WHERE src_id <> dst_id),
live AS (SELECT * FROM mem WHERE status IN ('raw', 'reviewed')),
vec AS (
  SELECT *, CAST(embedding AS DOUBLE[]) AS v FROM mem
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
batch AS (SELECT id FROM mem WHERE status = 'raw' ORDER BY timestamp NULLS FIRST, content, id LIMIT 50)
"""
