"""Consolidation queries: duplicates, classes, categories, conflicts, entities, relations, links, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.functions import text, vectors
from lorekeep.operators import editor as ed
from lorekeep.operators import graph as gr
from lorekeep.providers import HashVerdicts
from lorekeep.runtime import cut, table
from lorekeep.sources.tables import CTE, load_graph, memories, verdicts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CTE + sql
        return f

    return keep


def _batch(spark: SparkSession, d: str, most: int | None = schema.BATCH) -> DataFrame:
    """The oldest raw memories, as one run of the editor takes them; all raw ones without ``most``."""
    raw = memories(spark, d).where("status = 'raw'")
    return raw.orderBy(F.asc_nulls_first("timestamp"), "content", "id").limit(most) if most else raw


def _sides(spark: SparkSession, d: str, most: int | None = schema.BATCH) -> tuple[DataFrame, DataFrame]:
    rows = _active_vectors(load_graph(spark, d))
    rows = rows if most else cut(rows)  # read three times: counted, packed and compared
    return rows.join(_batch(spark, d, most).select("id"), "id", "left_semi"), rows


def _active_vectors(g) -> DataFrame:
    return gr.active_embeddings(g).where(vectors.usable(F.col("embedding"))).select("id", "embedding", "timestamp")


_PAIRS = """
, act AS (SELECT vec.id, v, timestamp FROM vec WHERE status IN ('raw', 'reviewed') AND id NOT IN (SELECT src_id FROM canon)),
prs AS (
  SELECT b.id AS id_a, a.id AS id_b, list_cosine_similarity(b.v, a.v) AS c FROM act b JOIN batch USING (id) JOIN act a ON a.id <> b.id
  WHERE NOT (a.id IN (SELECT id FROM batch) AND b.id < a.id))
"""


@query(_PAIRS + "SELECT id_a, id_b, round(c, 6) AS cosine FROM prs WHERE c >= 0.98")
def dedup_pairs_exact(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a batch memory and any active one with nearly the same vector."""
    b, rows = _sides(spark, d)
    return ed.duplicate_pairs(b, rows).withColumn("cosine", F.round("cosine", 6))


@query()
def dedup_pairs_exact_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of any raw memory and any active one with nearly the same vector."""
    b, rows = _sides(spark, d, None)
    return ed.duplicate_pairs(b, rows).withColumn("cosine", F.round("cosine", 6))


@query(_PAIRS + """SELECT id_a, id_b, round(c, 6) AS cosine,
  ['duplicate', 'update', 'related', 'distinct'][CAST('0x' || right(sha256(id_a || '|' || id_b), 1) AS INT) % 4 + 1] AS verdict
FROM prs WHERE c >= 0.4 AND c < 0.98""")
def dedup_pairs_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Pairs below the exact level (down to 0.4 on these vectors), with offline verdicts."""
    b, rows = _sides(spark, d)
    p = ed.duplicate_pairs(b, rows, 0.4, schema.EXACT)
    return HashVerdicts(["duplicate", "update", "related", "distinct"]).ask(p).withColumn("cosine", F.round("cosine", 6))


@query()
def dedup_pairs_semantic_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of any raw memory below the exact level (down to 0.4 on these vectors), with offline verdicts."""
    b, rows = _sides(spark, d, None)
    p = ed.duplicate_pairs(b, rows, 0.4, schema.EXACT)
    return HashVerdicts(["duplicate", "update", "related", "distinct"]).ask(p).withColumn("cosine", F.round("cosine", 6))


@query()
def dedup_fold(spark: SparkSession, d: str) -> DataFrame:
    """Which memories of the batch go into which others."""
    b, rows = _sides(spark, d)
    return ed.fold_duplicates(ed.duplicate_pairs(b, rows), rows)


@query()
def dedup_fold_all(spark: SparkSession, d: str) -> DataFrame:
    """Which raw memories go into which others, or others into them; folded by connected component."""
    b, rows = _sides(spark, d, None)
    return ed.fold_duplicates(cut(ed.duplicate_pairs(b, rows)), rows, by_component=True)


@query(r"""SELECT sha256(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[.!]+$', '')) AS key, count(*) AS n,
  min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def dedup_exact_text(spark: SparkSession, d: str) -> DataFrame:
    return ed.repeated_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _sql_case(col: str, names: tuple, syn: dict[str, str], exact: bool) -> str:
    pairs = [(n if exact else n.lower(), n) for n in names]
    out = " ".join(f"WHEN trim({col}) = '{a}' THEN '{b}'" if exact else f"WHEN lower(trim({col})) = '{a}' THEN '{b}'" for a, b in pairs)
    return f"CASE {out} {' '.join(f'''WHEN lower(trim({col})) = '{s}' THEN '{c}' ''' for s, c in syn.items())} END"


@query(f"SELECT id, {_sql_case('kind', schema.KINDS, schema.KIND_SYNONYMS, False)} AS normalizedkind FROM mem")
def classify_kind(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "id", "kind").select("id", text.kind_of(F.col("kind")).alias("normalizedkind"))


@query(f"SELECT id, {_sql_case('type', schema.ENTITY_TYPES, schema.ENTITY_TYPE_SYNONYMS, True)} AS normalizedtype FROM ent")
def classify_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities", "id", "type").select("id", text.type_of(F.col("type")).alias("normalizedtype"))


_CENT = """
, lab AS (SELECT label, embedding, vec_id FROM embeddings),
mean AS (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS m FROM lab, range(1, 65) t(p) GROUP BY ALL),
nrm AS (SELECT label, sqrt(sum(m * m)) + 1e-8 AS n FROM mean GROUP BY 1),
cen AS (SELECT mean.label, list(m / n ORDER BY p) AS c FROM mean JOIN nrm ON nrm.label = mean.label GROUP BY 1)
"""


@query(_CENT + "SELECT label, p, round(x, 6) AS x FROM (SELECT label, unnest(c) AS x, unnest(range(1, 65)) AS p FROM cen)")
def category_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Unit mean vectors of the labelled vectors, by component."""
    c = vectors.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p0", "x")).select("label", (F.col("p0") + 1).cast("long").alias("p"), F.round("x", 6).alias("x"))


@query(_CENT + """
SELECT vec_id AS id, label AS category, round(s, 6) AS score FROM (
  SELECT e.vec_id, cen.label, list_cosine_similarity(cen.c, CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings e, cen)
WHERE s >= 0.15 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label) = 1""")
def category_assign(spark: SparkSession, d: str) -> DataFrame:
    """The first near category of each vector (from 0.15 on these vectors)."""
    e = table(spark, d, "embeddings")
    c = vectors.centroids(e, "label", "embedding").select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("category"), "centroid")
    a = ed.assign_categories(e.select(F.col("vec_id").alias("id"), "embedding"), c, 0.15)
    return a.select("id", F.substring("category", 7, 20).cast("int").alias("category"), F.round("score", 6).alias("score"))


@query()
def category_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of similar memories in the batch."""
    b = _batch(spark, d).where(vectors.usable(F.col("embedding")))
    return ed.category_clusters(b, 0.15, 3)


@query()
def category_clusters_all(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of similar memories among all raw ones."""
    return ed.category_clusters(_batch(spark, d, None).where(vectors.usable(F.col("embedding"))), 0.15, 3)


@query("""
, cur AS (
  SELECT vec.id, status, v, list(men.entity_id) FILTER (WHERE men.entity_id IS NOT NULL) AS es FROM vec LEFT JOIN men ON men.memory_id = vec.id
  WHERE status IN ('raw', 'reviewed') AND validto IS NULL AND vec.id NOT IN (SELECT src_id FROM canon) GROUP BY ALL),
nb AS (
  SELECT b.id AS q, a.id, list_cosine_similarity(b.v, a.v) AS c FROM cur b JOIN batch USING (id) JOIN cur a ON a.id <> b.id
  WHERE list_has_any(a.es, b.es) AND (a.status <> 'raw' OR a.id IN (SELECT id FROM batch))),
tk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS rn FROM nb WHERE c >= 0.45),
pr AS (SELECT least(q, id) AS lo, greatest(q, id) AS hi, max(c) AS c FROM tk WHERE rn <= 8 GROUP BY ALL),
kn AS (SELECT src_id, dst_id FROM sup UNION ALL SELECT src_id, dst_id FROM rel WHERE type = 'contradicts')
SELECT lo, hi, round(c, 6) AS cosine FROM pr WHERE NOT EXISTS (
  SELECT 1 FROM kn WHERE least(src_id, dst_id) = lo AND greatest(src_id, dst_id) = hi)
ORDER BY c DESC, lo, hi LIMIT 200""")
def conflict_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that may contradict each other (from 0.45 on these vectors); at most 200 a run, as a feature."""
    g = load_graph(spark, d)
    cur = gr.current_memories(g).where(vectors.usable(F.col("embedding")))
    return ed.conflict_candidates(_batch(spark, d), cur, gr.conflict_links(g), 0.45).withColumn("cosine", F.round("cosine", 6))


@query()
def conflict_candidates_all(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of all raw memories that may contradict each other (from 0.45 on these vectors), without a cap."""
    g = load_graph(spark, d)
    cur = cut(gr.current_memories(g).where(vectors.usable(F.col("embedding"))))
    return ed.conflict_candidates(_batch(spark, d, None), cur, gr.conflict_links(g), 0.45, most=None).withColumn("cosine", F.round("cosine", 6))


@query("""
, t AS (SELECT id, coalesce(validfrom, timestamp) AS t, validto FROM mem),
o AS (
  SELECT CASE WHEN a.t > b.t OR (a.t = b.t AND vd = 'A') THEN a.id ELSE b.id END AS newer,
    CASE WHEN a.t > b.t OR (a.t = b.t AND vd = 'A') THEN b.id ELSE a.id END AS older
  FROM (SELECT lo, hi, ['A', 'B', 'none'][CAST('0x' || right(sha256(lo || '|' || hi), 1) AS INT) % 3 + 1] AS vd
    FROM lv WHERE starts_with(lo, 'mem') AND verdict IN ('update', 'unsure', 'related')) p
  JOIN t a ON a.id = p.lo JOIN t b ON b.id = p.hi WHERE a.t <> b.t OR (a.t = b.t AND vd IN ('A', 'B')))
SELECT older AS id, least(any_value(x.validto), min(n.t)) AS validto FROM o JOIN t n ON n.id = o.newer JOIN t x ON x.id = o.older GROUP BY 1""")
def supersede_validity(spark: SparkSession, d: str) -> DataFrame:
    """New ends of validity of memories that newer ones replace."""
    g = load_graph(spark, d)
    e = g.supersedes.select("src_id", "dst_id").unionByName(g.relates_to.select("src_id", "dst_id"))
    p = HashVerdicts(["A", "B", "none"], ("lo", "hi")).ask(gr.unordered(e))
    return ed.supersede(g.memory, ed.order_by_time(p, g.memory))


@query("SELECT id, coalesce(validfrom, timestamp) AS validfrom FROM mem")
def backfill_valid_from(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "id", "validfrom", "timestamp").select("id", F.coalesce("validfrom", "timestamp").alias("validfrom"))


_NAMES = r"""
, e AS (SELECT id AS entity_id, name, coalesce(normalizedtype, type) AS type, coalesce(aliases, []) AS aliases FROM ent WHERE id NOT IN (SELECT src_id FROM mrg)),
s0 AS (SELECT entity_id, name AS s, true AS own FROM e UNION ALL SELECT entity_id, unnest(aliases), false FROM e),
s AS (
  SELECT entity_id, array_to_string(list_sort(list_filter(string_split_regex(trim(regexp_replace(lower(s), '[^a-z0-9_]+', ' ', 'g')), ' +'), lambda w: w <> '')), ' ') AS str,
    bool_or(own) AS own FROM s0 WHERE s IS NOT NULL GROUP BY 1, 2 HAVING str <> ''),
p AS (
  SELECT a.entity_id AS lo, b.entity_id AS hi, bool_or(a.own AND b.own) AS same, bool_or(a.own) AS ab, bool_or(b.own) AS ba
  FROM s a JOIN s b ON a.str = b.str AND a.entity_id < b.entity_id GROUP BY ALL),
nm AS (
  SELECT lo, hi, (same OR (ab AND ba)) AND (x.type IS NULL OR y.type IS NULL OR x.type = y.type) AS is_match
  FROM p JOIN e x ON x.entity_id = lo JOIN e y ON y.entity_id = hi)
"""


@query(_NAMES + "SELECT lo, hi, is_match FROM nm")
def entity_name_match(spark: SparkSession, d: str) -> DataFrame:
    """Entities that share a name or alias, and whether they match."""
    return ed.name_candidates(gr.resolution_entities(load_graph(spark, d)), text.normal_name_ascii)


@query("SELECT id AS entity_id, name || ' (' || coalesce(normalizedtype, type, 'unknown type') || ')' || "
       "CASE WHEN len(list_filter(coalesce(aliases, []), lambda x: true)) > 0 THEN '. Also called: ' || array_to_string(aliases, ', ') ELSE '' END AS text "
       "FROM ent WHERE id NOT IN (SELECT src_id FROM mrg)")
def entity_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return ed.descriptor(gr.resolution_entities(load_graph(spark, d)))


@query("""
, e AS (SELECT id AS entity_id, coalesce(normalizedtype, type) AS type, CAST(embedding AS DOUBLE[]) AS v FROM ent
  WHERE id NOT IN (SELECT src_id FROM mrg) AND embedding IS NOT NULL AND len(embedding) = 64),
co AS (SELECT DISTINCT a.entity_id AS lo, b.entity_id AS hi FROM men a JOIN men b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id)
SELECT x.entity_id AS lo, y.entity_id AS hi, list_cosine_similarity(x.v, y.v) >= 0.95 AS certain FROM e x JOIN e y ON x.entity_id < y.entity_id
WHERE list_cosine_similarity(x.v, y.v) >= 0.8 AND (x.type IS NULL OR y.type IS NULL OR x.type = y.type)
  AND NOT EXISTS (SELECT 1 FROM co WHERE co.lo = x.entity_id AND co.hi = y.entity_id)""")
def entity_embedding_tier(spark: SparkSession, d: str) -> DataFrame:
    """Entity pairs by embedding, certain from 0.95."""
    g = load_graph(spark, d)
    e = gr.resolution_entities(g).select("entity_id", "type").join(g.entity.select(F.col("id").alias("entity_id"), "embedding"), "entity_id")
    return ed.embedding_tier(e.where(vectors.usable(F.col("embedding"))), gr.co_mentioned_pairs(g.mentions)).drop("cosine")


@query(_NAMES + """
, ed AS (SELECT lo AS a, hi AS b FROM nm WHERE is_match UNION SELECT hi, lo FROM nm WHERE is_match),
r(id, o) AS (SELECT a, a FROM ed UNION SELECT r.id, ed.b FROM r JOIN ed ON ed.a = r.o)
SELECT id, min(o) AS root FROM r GROUP BY id""")
def entity_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of entities that match by name."""
    return ed.min_label_groups(ed.name_candidates(gr.resolution_entities(load_graph(spark, d)), text.normal_name_ascii).where("is_match"))


def _link_sets(g):
    n = ed.name_candidates(gr.resolution_entities(g), text.normal_name_ascii)
    return n.where("not is_match").select("lo", "hi"), gr.co_mentioned_pairs(g.mentions).unionByName(gr.unordered(g.distinct_from)), n.where("is_match").select("lo", "hi")


@query(_NAMES + """
, ln AS (SELECT lo, hi FROM nm WHERE NOT is_match), gp AS (SELECT lo, hi FROM nm WHERE is_match),
dd AS (SELECT DISTINCT a.entity_id AS lo, b.entity_id AS hi FROM men a JOIN men b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id
  UNION SELECT least(src_id, dst_id), greatest(src_id, dst_id) FROM dif),
e0 AS (SELECT lo AS a, hi AS b FROM gp UNION SELECT hi, lo FROM gp),
e1 AS (SELECT a, b FROM e0 UNION SELECT lo, hi FROM ln UNION SELECT hi, lo FROM ln),
r0(id, o) AS (SELECT a, a FROM e0 UNION SELECT r0.id, e0.b FROM r0 JOIN e0 ON e0.a = r0.o),
r1(id, o) AS (SELECT a, a FROM e1 UNION SELECT r1.id, e1.b FROM r1 JOIN e1 ON e1.a = r1.o),
l0 AS (SELECT id, min(o) AS root FROM r0 GROUP BY 1), l1 AS (SELECT id, min(o) AS root FROM r1 GROUP BY 1),
bl AS (
  SELECT DISTINCT x.root FROM dd JOIN l1 x ON x.id = dd.lo JOIN l1 y ON y.id = dd.hi AND x.root = y.root
  WHERE NOT EXISTS (SELECT 1 FROM l0 u JOIN l0 w ON u.root = w.root WHERE u.id = dd.lo AND w.id = dd.hi))
SELECT lo, hi FROM ln JOIN l1 ON l1.id = ln.lo WHERE l1.root NOT IN (SELECT root FROM bl)""")
def consistent_links(spark: SparkSession, d: str) -> DataFrame:
    """Possible links between entities that join no pair known to differ."""
    return ed.consistent_links(*_link_sets(load_graph(spark, d)))


_TARGETS = _NAMES + """
, edg AS (SELECT lo AS a, hi AS b FROM nm WHERE is_match UNION SELECT hi, lo FROM nm WHERE is_match),
r(id, o) AS (SELECT a, a FROM edg UNION SELECT r.id, edg.b FROM r JOIN edg ON edg.a = r.o),
g AS (SELECT id, min(o) AS root FROM r GROUP BY id),
cnt AS (SELECT men.entity_id AS id, count(*) AS n FROM men JOIN mem ON mem.id = men.memory_id GROUP BY 1),
gt AS (SELECT g.id, root, first_value(g.id) OVER (PARTITION BY root ORDER BY coalesce(n, 0) DESC, name, g.id) AS dst_id
  FROM g JOIN ent ON ent.id = g.id LEFT JOIN cnt ON cnt.id = g.id),
tg AS (SELECT id AS src_id, dst_id FROM gt WHERE id <> dst_id)
"""


@query(_TARGETS + "SELECT src_id, dst_id FROM tg")
def merge_targets(spark: SparkSession, d: str) -> DataFrame:
    """The member that each other member of a group merges into."""
    e = gr.resolution_entities(load_graph(spark, d))
    return ed.merge_targets(ed.min_label_groups(ed.name_candidates(e, text.normal_name_ascii).where("is_match")), e)


@query(_TARGETS + "SELECT DISTINCT memory_id, coalesce(tg.dst_id, entity_id) AS entity_id FROM men LEFT JOIN tg ON tg.src_id = men.entity_id")
def merge_rewire(spark: SparkSession, d: str) -> DataFrame:
    """Mentions after the merges."""
    g = load_graph(spark, d)
    e = gr.resolution_entities(g)
    t = ed.merge_targets(ed.min_label_groups(ed.name_candidates(e, text.normal_name_ascii).where("is_match")), e)
    return ed.merge_entities(g, t, "run-1")["mentions"].select("memory_id", "entity_id")


@query("""
, m AS (SELECT men.memory_id, entity_id, status, memory_id IN (SELECT id FROM batch) AS inb FROM men JOIN live ON live.id = men.memory_id),
s AS (SELECT entity_id FROM m GROUP BY 1 HAVING count(*) > 1 AND count(*) <= 30 AND bool_or(inb)),
c AS (SELECT * FROM m WHERE entity_id IN (SELECT entity_id FROM s) AND (inb OR status <> 'raw'))
SELECT DISTINCT a.memory_id AS lo, b.memory_id AS hi FROM c a JOIN c b ON a.entity_id = b.entity_id AND a.memory_id < b.memory_id
WHERE (a.inb OR b.inb) AND NOT EXISTS (SELECT 1 FROM rel WHERE least(src_id, dst_id) = a.memory_id AND greatest(src_id, dst_id) = b.memory_id)""")
def relationship_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All pairs worth asking about, before the cap of a run."""
    return ed.relation_candidates(load_graph(spark, d), _batch(spark, d), most=None)


@query()
def relationship_candidates_all(spark: SparkSession, d: str) -> DataFrame:
    """All pairs worth asking about when every raw memory is taken."""
    return ed.relation_candidates(load_graph(spark, d), _batch(spark, d, None), most=None)


@query("""
SELECT CASE WHEN x = 'b_to_a' THEN hi ELSE lo END AS src_id, CASE WHEN x = 'b_to_a' THEN lo ELSE hi END AS dst_id, 'knows' AS relation
FROM (SELECT lo, hi, unnest(CASE CAST('0x' || right(sha256(lo || '|' || hi), 1) AS INT) % 3 WHEN 0 THEN ['a_to_b'] WHEN 1 THEN ['b_to_a'] ELSE ['a_to_b', 'b_to_a'] END) AS x
  FROM lv WHERE starts_with(lo, 'ent'))""")
def directed_entity_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the verdicts' directions; mutual ones give two."""
    p = verdicts(spark, d).where(F.col("lo").startswith("ent")).select("lo", "hi")
    p = HashVerdicts(["a_to_b", "b_to_a", "mutual"], ("lo", "hi")).ask(p)
    p = p.select(F.col("lo").alias("id_a"), F.col("hi").alias("id_b"), F.lit("knows").alias("relation"), F.col("verdict").alias("direction"))
    return ed.directed_links(p)


@query("""
, b AS (SELECT id, sessionid, confidence, trim(lower(substring(content, 1, 80))) AS k FROM mem WHERE status = 'raw' AND sessionid IS NOT NULL
  AND (confidence IS NULL OR NOT isnan(confidence)))
SELECT id, round(least(1.0, confidence + 0.1), 6) AS confidence FROM b WHERE confidence IS NOT NULL AND k IN (SELECT k FROM b GROUP BY 1 HAVING count(DISTINCT sessionid) > 1)""")
def confidence_boost(spark: SparkSession, d: str) -> DataFrame:
    """Raw memories whose opening occurs in several sessions."""
    m = memories(spark, d, "id", "sessionid", "content", "confidence", "status").where("status = 'raw'").withColumn("sessionboosted", F.lit(False))
    return ed.boosts(m.where("confidence is null or not isnan(confidence)")).where("confidence is not null").withColumn("confidence", F.round("confidence", 6))


@query("SELECT id, round(greatest(confidence - 0.05, 0.1), 6) AS confidence FROM mem WHERE status = 'reviewed' AND confidence > 0.1 AND NOT isnan(confidence)")
def confidence_decay(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "id", "confidence", "status").withColumn("confidencedecayedon", F.lit(None).cast("date"))
    return ed.decays(m, "2026-01-01").select("id", F.round("confidence", 6).alias("confidence"))


@query("SELECT id, floor((row_number() OVER (ORDER BY id) - 1) / 12)::BIGINT AS chunk FROM mem")
def chunk_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Memories in chunks of twelve, as model calls take them."""
    return ed.chunked(memories(spark, d, "id"), 12, "id")
