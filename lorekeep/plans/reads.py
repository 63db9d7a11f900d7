"""Graph reads: scans, joins, aggregations, walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.operators import graph as gr
from lorekeep.runtime import clean, table
from lorekeep.sources.tables import CTE, load_graph, memories

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CTE + sql
        return f

    return keep


@query("SELECT count(*) AS n_raw FROM mem WHERE status = 'raw'")
def raw_count(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "id", "status").where("status = 'raw'").agg(F.count(F.lit(1)).alias("n_raw"))


@query("""
SELECT b.id, m.timestamp AS at, s.channel, (SELECT count(*) FROM men JOIN ent e ON e.id = men.entity_id WHERE men.memory_id = b.id) AS n_entities
FROM batch b JOIN mem m USING (id) LEFT JOIN ses s ON s.id = m.sessionid""")
def raw_batch(spark: SparkSession, d: str) -> DataFrame:
    """The oldest raw memories with the number of their entities; the limit is the batch size."""
    return gr.raw_batch(load_graph(spark, d)).select("id", F.col("timestamp").alias("at"), "channel", F.size("entities").cast("long").alias("n_entities"))


@query("""
SELECT id FROM live WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM canon c WHERE c.src_id = live.id)""")
def active_not_canonical(spark: SparkSession, d: str) -> DataFrame:
    return gr.active_embeddings(load_graph(spark, d)).select("id")


@query("SELECT id, name FROM ent WHERE id NOT IN (SELECT src_id FROM mrg)")
def unmerged_entities(spark: SparkSession, d: str) -> DataFrame:
    return gr.not_merged(load_graph(spark, d)).select("id", "name")


@query("""
SELECT normalizedkind AS name, count(*) AS n_members, arg_min(id, (coalesce(timestamp, TIMESTAMP '0001-01-01'), content, id)) AS first_id FROM mem
WHERE normalizedkind IS NOT NULL GROUP BY 1""")
def category_members(spark: SparkSession, d: str) -> DataFrame:
    """Categories with the number of their members and the earliest of them."""
    return gr.category_sizes(load_graph(spark, d))


@query("""
SELECT men.entity_id, count(*) AS n, arg_min(memory_id, (coalesce(timestamp, TIMESTAMP '0001-01-01'), memory_id)) AS first_id
FROM men JOIN live ON live.id = men.memory_id GROUP BY 1 HAVING count(*) > 1""")
def shared_entity_groups(spark: SparkSession, d: str) -> DataFrame:
    """Entities that several active memories mention."""
    return gr.shared_entities(load_graph(spark, d))


@query("""
, n AS (SELECT men.entity_id, count(*) AS n FROM men JOIN live ON live.id = men.memory_id GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)
SELECT n.entity_id, n, memory_id FROM n JOIN men ON men.entity_id = n.entity_id JOIN live ON live.id = men.memory_id""")
def shared_entity_members(spark: SparkSession, d: str) -> DataFrame:
    """Active memories of each entity that is shared but no hub."""
    return gr.shared_entity_groups(load_graph(spark, d), schema.HUB)


@query("""
, t AS (
  SELECT men.entity_id, content, row_number() OVER (PARTITION BY men.entity_id ORDER BY content, memory_id) AS rn,
    count(*) OVER (PARTITION BY men.entity_id) AS n FROM men JOIN mem ON mem.id = men.memory_id)
SELECT e.id AS entity_id, e.name, coalesce(e.normalizedtype, e.type) AS type, coalesce(max(t.n), 0) AS mentions,
  string_agg(t.content, '|' ORDER BY t.rn) FILTER (WHERE t.rn <= 3) AS samples
FROM ent e LEFT JOIN t ON t.entity_id = e.id WHERE e.id NOT IN (SELECT src_id FROM mrg) GROUP BY ALL""")
def resolution_entities(spark: SparkSession, d: str) -> DataFrame:
    e = gr.resolution_entities(load_graph(spark, d))
    return e.select("entity_id", "name", "type", "mentions", F.array_join("samples", "|").alias("samples"))


@query("""
SELECT DISTINCT a.entity_id AS lo, b.entity_id AS hi FROM men a JOIN men b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id""")
def co_mention_pairs(spark: SparkSession, d: str) -> DataFrame:
    return gr.co_mentioned_pairs(load_graph(spark, d).mentions)


@query("SELECT DISTINCT least(src_id, dst_id) AS lo, greatest(src_id, dst_id) AS hi FROM dif")
def judged_different(spark: SparkSession, d: str) -> DataFrame:
    return gr.unordered(load_graph(spark, d).distinct_from)


_CO = """
, p AS (SELECT * FROM ent WHERE type = 'Person' AND id NOT IN (SELECT src_id FROM mrg)),
x AS (SELECT men.memory_id, p.id, p.name, live.content FROM men JOIN p ON p.id = men.entity_id JOIN live ON live.id = men.memory_id),
y AS (SELECT a.id AS id_a, a.name AS name_a, b.id AS id_b, b.name AS name_b, a.memory_id, a.content
  FROM x a JOIN x b ON a.memory_id = b.memory_id AND (a.name < b.name OR (a.name = b.name AND a.id < b.id)))
"""


@query(_CO + "SELECT id_a, name_a, id_b, name_b, count(*) AS co_count, min(content) AS first_sample FROM y GROUP BY ALL")
def person_co_mentions(spark: SparkSession, d: str) -> DataFrame:
    return gr.entity_co_mentions(load_graph(spark, d)).select("id_a", "name_a", "id_b", "name_b", "co_count", F.col("samples")[0].alias("first_sample"))


@query(_CO + """
SELECT DISTINCT id_a, id_b FROM y WHERE NOT EXISTS (
  SELECT 1 FROM lnk WHERE (src_id = id_a AND dst_id = id_b) OR (src_id = id_b AND dst_id = id_a))""")
def unlinked_person_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    return gr.unlinked(gr.entity_co_mentions(g), g.linked_to, "id_a", "id_b").select("id_a", "id_b")


@query("""
SELECT m.id, count(men.entity_id) AS n_entities FROM live m LEFT JOIN men ON men.memory_id = m.id
WHERE validto IS NULL AND embedding IS NOT NULL AND m.id NOT IN (SELECT src_id FROM canon) GROUP BY 1""")
def current_memories(spark: SparkSession, d: str) -> DataFrame:
    return gr.current_memories(load_graph(spark, d)).select("id", F.size("entity_ids").cast("long").alias("n_entities"))


@query("""
SELECT DISTINCT least(src_id, dst_id) AS lo, greatest(src_id, dst_id) AS hi
FROM (SELECT src_id, dst_id FROM sup UNION ALL SELECT src_id, dst_id FROM rel WHERE type = 'contradicts')""")
def conflict_links(spark: SparkSession, d: str) -> DataFrame:
    return gr.conflict_links(load_graph(spark, d))


@query("SELECT id FROM mem WHERE status <> 'archived' AND id IN (SELECT src_id FROM canon)")
def surviving_ids(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    return gr.surviving(g, g.canonical.select(F.col("src_id").alias("id")).distinct())


@query("""
SELECT (SELECT count(*) FROM mem) AS memories, (SELECT count(*) FROM mem WHERE status = 'raw') AS raw,
  (SELECT count(*) FROM mem WHERE status = 'archived') AS archived, (SELECT count(*) FROM ent) AS entities,
  (SELECT count(*) FROM ses) AS sessions, (SELECT count(DISTINCT normalizedkind) FROM mem) AS categories,
  (SELECT count(*) FROM rel) AS relations, (SELECT count(*) FROM lnk) AS links""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return gr.graph_stats(load_graph(spark, d))


@query("""
, pairing AS (SELECT DISTINCT memory_id, entity_id FROM men WHERE memory_id IN (SELECT id FROM mem WHERE status IN ('raw', 'reviewed')))
SELECT count(*) AS pairs FROM (
  SELECT DISTINCT a.memory_id AS x, b.memory_id AS y FROM pairing a JOIN pairing b ON a.entity_id = b.entity_id AND a.memory_id < b.memory_id)""")
def relation_pair_count(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of raw or reviewed memories that share an entity."""
    g = load_graph(spark, d)
    live = g.memory.where("status in ('raw', 'reviewed')").select(F.col("id").alias("memory_id"))
    return gr.candidate_pair_count(g.mentions.join(live, "memory_id", "left_semi"))


@query("""
, step AS (SELECT src_id AS s, min(dst_id) AS d FROM canon GROUP BY 1),
walk(id, root, n) AS (
  SELECT s, s, 0 FROM step UNION ALL SELECT w.id, t.d, w.n + 1 FROM walk w JOIN step t ON t.s = w.root WHERE w.n < 1000)
SELECT id, arg_max(root, n) AS root FROM walk GROUP BY id""")
def canonical_follow(spark: SparkSession, d: str) -> DataFrame:
    """Where the chain of duplicates of each memory ends."""
    g = load_graph(spark, d)
    return gr.roots(g.canonical, g.canonical.select(F.col("src_id").alias("id")).distinct())


@query("""
, step AS (SELECT src_id AS s, min(dst_id) AS d FROM mrg GROUP BY 1),
walk(id, root, n) AS (
  SELECT id, id, 0 FROM ent UNION ALL SELECT w.id, t.d, w.n + 1 FROM walk w JOIN step t ON t.s = w.root WHERE w.n < 5)
SELECT id, arg_max(root, n) AS root FROM walk GROUP BY id""")
def merged_root(spark: SparkSession, d: str) -> DataFrame:
    """The surviving entity of each entity, at most five merges away."""
    g = load_graph(spark, d)
    return gr.roots(g.merged_into, g.entity.select("id"), max_hops=5)


@query("SELECT 'sessions.key' AS what, count(*) AS n FROM (SELECT key FROM ses WHERE key IS NOT NULL GROUP BY 1 HAVING count(*) > 1) "
       "UNION ALL SELECT 'memories.writekey', count(*) FROM (SELECT writekey FROM mem WHERE writekey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def uniqueness_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of values that break a uniqueness rule."""
    s = schema.duplicate_keys(table(spark, d, "sessions"), "key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("sessions.key").alias("what"), "n")
    m = schema.duplicate_keys(memories(spark, d, "id", "writekey"), "writekey").agg(F.count(F.lit(1)).alias("n")).select(F.lit("memories.writekey").alias("what"), "n")
    return s.unionByName(m)


@query("SELECT id, status, count(*) AS n FROM (SELECT id, lower(trim(status)) AS status FROM memories) GROUP BY ALL HAVING count(*) > 1")
def fingerprint_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Rows delivered more than once, as a multiset difference."""
    return table(spark, d, "memories", "id", "status").withColumn("status", clean(F.col("status"))).groupBy("id", "status").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT id, name FROM ent WHERE contains(lower(name), 'research') OR levenshtein(lower(name), 'assistant') <= 2")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Full-text style lookup of entity names: a contained word or a small edit distance."""
    n = F.lower("name")
    return table(spark, d, "entities", "id", "name").where(n.contains("research") | (F.levenshtein(n, F.lit("assistant")) <= 2))
