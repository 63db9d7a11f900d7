"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import components, leakage, mixing, names, neighbourhood, subjects, survivor, vectors
from lorekeep.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The member that gives each group of memories or entities its confidence, timestamp or aliases."""
    m = survivor.memory_best(table(spark, d, "memories"))
    return m.unionByName(survivor.entity_best(table(spark, d, "entities")))


def p1_alias_truth(spark: SparkSession, d: str) -> DataFrame:
    """Every alias of a group of entities that the quality model judges true."""
    return survivor.entity_survivors(table(spark, d, "entities")).values.select(
        "group_key", "value", F.round("p", 4).alias("p")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every id with a link."""
    return components.match_groups(table(spark, d, "match_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Raw memories with their near copies among reviewed ones and raw ones of other days."""
    return neighbourhood.memory_repeats(table(spark, d, "memories")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Most similar memories of memories and entities of entities, by embedding."""
    m = vectors.similar_pairs(table(spark, d, "memories", "id", "embedding"))
    return m.unionByName(vectors.similar_pairs(table(spark, d, "entities", "id", "embedding")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are spellings of one and the same real entity."""
    return names.variant_pairs(table(spark, d, "entities", "id", "name", "type", "aliases"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least eight consecutive words of an evaluation item."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")
    return leakage.leaked_items(docs, items).select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All documents without the leaked passages; those that leaked for the most part are dropped."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text")
    return leakage.without_leaks(docs, items)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return mixing.mix_sources(docs, table(spark, d, "mix_targets"), tokenizers=mixing.own_tokenizers(spark))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of all sources: documents, copies and their places in the shards."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the mix that the sources reach."""
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of every document."""
    docs, labels = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "doc_labels", "doc_id", "subject")
    return subjects.document_subjects(docs, labels).select("doc_id", "subject")


QUERIES = {"p8_found": p8_found, "p8_cleaned": p8_cleaned, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p6_found": p6_found, "p5_found": p5_found, "p4_found": p4_found, "p1_found": p1_found, "p1_alias_truth": p1_alias_truth, "p3_found": p3_found}

ORACLES = {
    "p1_found": """
WITH m0 AS (
  SELECT id, any_value(writekey) AS g, any_value(confidence) AS c, any_value(timestamp) AS t FROM memories
  WHERE writekey IS NOT NULL GROUP BY id
), m AS (
  SELECT id, g, CASE WHEN c >= 0 AND c <= 1 AND NOT isnan(c) THEN c END AS c,
    CASE WHEN t >= TIMESTAMP '2024-01-01 00:00:00' AND t < TIMESTAMP '2027-01-01 00:00:00' THEN t END AS t,
    count(*) OVER (PARTITION BY g) AS n FROM m0
), e AS (
  SELECT id, key AS g, firstseen AS t, len(list_distinct(list_filter(list_transform(aliases, lambda x: lower(trim(x))),
    lambda x: x IS NOT NULL AND x <> ''))) AS c, count(*) OVER (PARTITION BY key) AS n
  FROM entities WHERE key IS NOT NULL
), r AS (
  SELECT g, 'confidence' AS field, id, row_number() OVER (PARTITION BY g ORDER BY c DESC, t DESC NULLS LAST, id) AS rn
  FROM m WHERE n > 1 AND c IS NOT NULL
  UNION ALL
  SELECT g, 'timestamp', id, row_number() OVER (PARTITION BY g ORDER BY t DESC, c DESC NULLS LAST, id)
  FROM m WHERE n > 1 AND t IS NOT NULL
  UNION ALL
  SELECT g, 'aliases', id, row_number() OVER (PARTITION BY g ORDER BY c DESC, t DESC NULLS LAST, id)
  FROM e WHERE n > 1 AND c > 0
)
SELECT g AS group_key, field, id FROM r WHERE rn = 1""",
    "p8_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, list_aggregate(w[k:k + 7], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, list_aggregate(w[k:k + 7], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p4_found": r"""
WITH m AS (
  SELECT id, lower(trim(any_value(status))) AS st, CAST(any_value(timestamp) AS DATE) AS d,
    list_distinct(regexp_extract_all(lower(any_value(content)), '[a-z0-9]+')) AS w
  FROM memories GROUP BY id
), k AS (SELECT * FROM m WHERE st IN ('raw', 'reviewed') AND len(w) > 0),
p AS (
  SELECT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS n, len(y.w) AS o
  FROM k x JOIN k y ON x.id <> y.id AND x.st = 'raw' AND (y.st = 'reviewed' OR x.d <> y.d)
    AND len(x.w) >= 0.6 * len(y.w) AND len(y.w) >= 0.6 * len(x.w)
)
SELECT DISTINCT id_a, id_b FROM p WHERE i / (n + o - i) >= 0.6""",
    "p3_found": """
WITH RECURSIVE l AS (
  SELECT least(left_id, right_id) AS u, greatest(left_id, right_id) AS v, lower(trim(verdict)) AS x,
    row_number() OVER (PARTITION BY least(left_id, right_id), greatest(left_id, right_id)
      ORDER BY createdat DESC NULLS LAST, pair_id DESC) AS rn
  FROM match_pairs WHERE left_id <> right_id
), s AS (SELECT u, v FROM l WHERE rn = 1 AND x IN ('duplicate', 'same')),
b AS (SELECT u, v FROM s UNION SELECT v, u FROM s),
r(id, other) AS (SELECT u, u FROM b UNION SELECT r.id, b.v FROM r JOIN b ON r.other = b.u)
SELECT id, min(other) AS group_id FROM r GROUP BY id""",
}
