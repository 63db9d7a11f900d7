"""Retrieval queries over the memories; the suppressed ones stand for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring, vectors
from lorekeep.operators import retrieval as rt
from lorekeep.runtime import table
from lorekeep.sources.tables import AS_OF, CTE, load_graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CTE + sql
        return f

    return keep


def prompts(g) -> DataFrame:
    return g.memory.where((F.col("status") == "suppressed") & vectors.usable(F.col("embedding"))).select("id", "embedding")


_SEEDS = f"""
, q AS (SELECT id AS q, v AS qv FROM vec WHERE status = 'suppressed'),
ok AS (SELECT * FROM vec WHERE (status NOT IN ('archived', 'suppressed') OR status IS NULL) AND (expiresat IS NULL OR expiresat >= TIMESTAMP '{AS_OF}')),
sc AS (
  SELECT q.q, ok.id, list_cosine_similarity(qv, v) * (0.6 + 0.4 * coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.5))
    * (0.6 + 0.4 * coalesce(salience, 0.5)) * CASE WHEN validto <= TIMESTAMP '{AS_OF}' THEN 0.7 ELSE 1.0 END AS score FROM q, ok),
seed AS (SELECT q, id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rn FROM sc) WHERE rn <= 6)
"""


@query(_SEEDS + "SELECT q, id, round(score, 6) AS score FROM seed")
def retrieve_seeds(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    return rt.seeds(g, prompts(g), AS_OF).withColumn("score", F.round("score", 6))


_DEGREE = """
, deg AS (
  SELECT men.entity_id, count(*) AS n_live FROM men JOIN mem ON mem.id = men.memory_id JOIN ent ON ent.id = men.entity_id
  WHERE status IN ('active', 'raw', 'reviewed') AND (active IS NULL OR active) GROUP BY 1)
"""


@query(_DEGREE + "SELECT entity_id, n_live, n_live > 30 AS is_hub FROM deg")
def hub_entities(spark: SparkSession, d: str) -> DataFrame:
    return rt.entity_degrees(load_graph(spark, d)).withColumn("is_hub", F.col("n_live") > 30)


_HYBRID = _SEEDS + _DEGREE + f"""
, se AS (
  SELECT DISTINCT q, men.entity_id FROM seed JOIN men ON men.memory_id = seed.id JOIN ent ON ent.id = men.entity_id
  LEFT JOIN deg ON deg.entity_id = men.entity_id WHERE (active IS NULL OR active) AND coalesce(n_live, 0) <= 30),
ex AS (
  SELECT q, men.memory_id AS id, count(*) AS shared FROM se JOIN men USING (entity_id)
  WHERE NOT EXISTS (SELECT 1 FROM seed WHERE seed.q = se.q AND seed.id = men.memory_id) GROUP BY ALL),
exs AS (
  SELECT ex.q, ex.id, (coalesce(CASE WHEN len(m.embedding) <> 64 THEN 0
      WHEN list_aggregate(list_transform(m.embedding, lambda x: abs(x)), 'max') = 0 THEN 0
      ELSE list_cosine_similarity(q.qv, CAST(m.embedding AS DOUBLE[])) END, 0)
    * (0.6 + 0.4 * coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.5)) * (0.6 + 0.4 * coalesce(salience, 0.5))
    + least(0.3, 0.1 * shared)) * CASE WHEN validto <= TIMESTAMP '{AS_OF}' THEN 0.7 ELSE 1.0 END AS score
  FROM ex JOIN q ON q.q = ex.q JOIN mem m ON m.id = ex.id
  WHERE status IN ('active', 'raw', 'reviewed') AND (expiresat IS NULL OR expiresat > TIMESTAMP '{AS_OF}')),
allr AS (SELECT q, id, score, 'vector' AS source FROM seed UNION ALL SELECT q, id, score, 'graph' FROM exs),
hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM allr) WHERE rank <= 10)
"""


@query(_HYBRID + "SELECT q, id, source, rank, round(score, 6) AS score FROM hyb")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Vector seeds and graph expansion for every prompt, reranked."""
    g = load_graph(spark, d)
    return rt.retrieve(g, prompts(g), AS_OF).select("q", "id", "source", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_HYBRID + """
, act AS (SELECT id AS entity_id, name FROM ent WHERE active IS NULL OR active),
sn AS (SELECT q, hyb.id, act.entity_id, name FROM hyb JOIN men ON men.memory_id = hyb.id JOIN act USING (entity_id)),
rl AS (
  SELECT DISTINCT sn.q, sn.id, sn.entity_id, sn.name, o.name AS other, relation FROM sn JOIN lnk ON lnk.src_id = sn.entity_id
  JOIN act o ON o.entity_id = lnk.dst_id WHERE EXISTS (SELECT 1 FROM sn t WHERE t.q = sn.q AND t.name = o.name)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY q, id, entity_id ORDER BY other, relation) AS rn FROM rl),
ne AS (SELECT q, id, string_agg(DISTINCT name, '|' ORDER BY name) AS entities FROM sn GROUP BY ALL),
nr AS (SELECT q, id, string_agg(DISTINCT name || ' is ' || relation || ' of ' || other, '|' ORDER BY name || ' is ' || relation || ' of ' || other) AS relations
  FROM r3 WHERE rn <= 3 GROUP BY ALL)
SELECT hyb.q, hyb.id, coalesce(entities, '') AS entities, coalesce(relations, '') AS relations
FROM hyb LEFT JOIN ne ON ne.q = hyb.q AND ne.id = hyb.id LEFT JOIN nr ON nr.q = hyb.q AND nr.id = hyb.id""")
def retrieval_decorate(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    r = rt.decorate(g, rt.retrieve(g, prompts(g), AS_OF))
    return r.select("q", "id", F.array_join("entities", "|").alias("entities"), F.array_join("relations", "|").alias("relations"))


@query()
def retrieval_context_text(spark: SparkSession, d: str) -> DataFrame:
    """The text block for every prompt."""
    g = load_graph(spark, d)
    return rt.context_text(g, rt.retrieve(g, prompts(g), AS_OF, rt.LIMIT), AS_OF)


@query("""
, q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q, vec_id AS id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS c FROM q, embeddings)
SELECT q, id, round(c, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rank FROM s WHERE q <> id) WHERE rank <= 5""")
def vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest vectors of every twentieth one, among all."""
    e = table(spark, d, "embeddings", F.col("vec_id").alias("id"), "embedding")
    hits = vectors.top_k(e.where("id % 20 = 0"), e, 6).where("q <> id")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("q", "id", F.round("score", 6).alias("cosine"), "rank")


@query("""
SELECT vec_id, round((0.6 + 0.4 * (vec_id % 11) / 10.0) * (0.6 + 0.4 * (vec_id % 7) / 6.0) *
  CASE WHEN vec_id % 5 = 0 THEN 0.7 ELSE 1.0 END, 6) AS score FROM embeddings""")
def score_formula(spark: SparkSession, d: str) -> DataFrame:
    """The score of a perfect hit under various confidences, saliences and validities."""
    e = table(spark, d, "embeddings", "vec_id")
    at = F.lit(AS_OF).cast("timestamp")
    s = scoring.base_score(F.lit(1.0), (F.col("vec_id") % 11) / 10.0, (F.col("vec_id") % 7) / 6.0) * scoring.validity(F.when(F.col("vec_id") % 5 == 0, at), at)
    return e.select("vec_id", F.round(s, 6).alias("score"))
