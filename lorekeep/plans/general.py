"""Queries for the general large-data operators: attribute history (p2) and skewed keys (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.history import attribute_history
from lorekeep.operators.skew import distinct_per_key, exact_quantiles
from lorekeep.runtime import clean, table

ROLES = ("subject", "object", "context", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every entity attribute, with its period of validity."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    return attribute_history(table(spark, d, "fact_updates")).select(
        "entity_id",
        "attribute",
        F.date_format("valid_from", stamp).alias("valid_from"),
        F.coalesce(F.date_format("valid_to", stamp), F.lit("open")).alias("valid_to"),
    ).distinct()


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    role = clean(F.col("role"))
    return table(spark, d, "mentions", "memory_id", "entity_id", "role", "loadedat").withColumn(
        "role", F.when(role.isin(*ROLES), role).otherwise("context")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct memories per entity and role, where there are more than 30."""
    m = _mentions(spark, d)
    return distinct_per_key(m, ["entity_id", "role"], "memory_id", "n_memories").where("n_memories > 30")


def p7_arrival_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of the arrival time of each entity's mentions."""
    q = exact_quantiles(_mentions(spark, d), ["entity_id"], "loadedat", [0.25, 0.5, 0.75])
    return q.select("entity_id", "prob", F.col("n").alias("n_rows"), F.unix_micros("value").alias("at_us"))


QUERIES = {"p2_found": p2_found, "p7_found": p7_found, "p7_arrival_quantiles": p7_arrival_quantiles}

ORACLES = {
    "p2_found": r"""
WITH r0 AS (
  SELECT entity_id, attribute, content, coalesce(validfrom, timestamp) AS s, validto, timestamp AS ts, update_id
  FROM fact_updates
  WHERE coalesce(lower(trim(status)), '') <> 'suppressed' AND content IS NOT NULL AND trim(content) <> ''
), r1 AS (
  SELECT *, CASE WHEN validto > s THEN validto END AS e,
    row_number() OVER (PARTITION BY entity_id, attribute, s ORDER BY ts DESC NULLS LAST, update_id DESC) AS rn
  FROM r0 WHERE s IS NOT NULL
), r2 AS (
  SELECT entity_id, attribute, s, e,
    trim(regexp_replace(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), '[.!\s]+$', '')) AS v
  FROM r1 WHERE rn = 1
), r3 AS (
  SELECT *, lag(v) OVER w AS pv, lag(e) OVER w AS pe, lag(s) OVER w AS ps FROM r2
  WINDOW w AS (PARTITION BY entity_id, attribute ORDER BY s)
), r4 AS (
  SELECT *, sum(CASE WHEN pv = v AND (pe IS NULL OR pe >= s) THEN 0 ELSE 1 END)
    OVER (PARTITION BY entity_id, attribute ORDER BY s) AS ver FROM r3
), r5 AS (
  SELECT entity_id, attribute, ver, min(s) AS f, arg_max(coalesce(e, TIMESTAMP '9999-01-01'), s) AS e
  FROM r4 GROUP BY ALL
), r6 AS (
  SELECT *, lead(f) OVER (PARTITION BY entity_id, attribute ORDER BY f) AS nf FROM r5
)
SELECT DISTINCT entity_id, attribute, strftime(f, '%Y-%m-%d %H:%M:%S') AS valid_from,
  CASE WHEN least(e, coalesce(nf, e)) = TIMESTAMP '9999-01-01' THEN 'open'
       ELSE strftime(least(e, coalesce(nf, e)), '%Y-%m-%d %H:%M:%S') END AS valid_to
FROM r6""",
    "p7_found": """
SELECT entity_id, CASE WHEN lower(trim(role)) IN ('subject', 'object', 'context', 'source')
    THEN lower(trim(role)) ELSE 'context' END AS role, count(DISTINCT memory_id) AS n_memories
FROM mentions GROUP BY 1, 2 HAVING count(DISTINCT memory_id) > 30""",
    "p7_arrival_quantiles": """
WITH p(prob) AS (VALUES (CAST(0.25 AS DOUBLE)), (0.5), (0.75)), m AS (
  SELECT entity_id, loadedat, row_number() OVER (PARTITION BY entity_id ORDER BY loadedat) AS rn,
    count(*) OVER (PARTITION BY entity_id) AS n FROM mentions WHERE loadedat IS NOT NULL)
SELECT entity_id, prob, n AS n_rows, epoch_us(loadedat) AS at_us
FROM m, p WHERE rn = greatest(1, CAST(ceil(prob * n) AS BIGINT))""",
}
