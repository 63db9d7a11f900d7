"""Capture queries: transcripts, filters, keys, upserts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text, vectors
from lorekeep.operators import writer as wr
from lorekeep.runtime import table
from lorekeep.sources.tables import CTE, load_graph, memories

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CTE + sql
        return f

    return keep


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the turns of a conversation that each author had that day."""
    t = table(spark, d, "documents", "doc_id", "text", "observedat", "sourceauthor").where("sourceauthor is not null and text is not null")
    conv = F.concat_ws("|", "sourceauthor", F.date_format("observedat", "yyyy-MM-dd"))
    role = F.element_at(F.array(F.lit("user"), F.lit("assistant"), F.lit("system")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.select(conv.alias("conv_id"), F.col("doc_id").alias("turn"), role.alias("role"), "text")


@query(r"""
, t AS (
  SELECT concat_ws('|', sourceauthor, strftime(observedat, '%Y-%m-%d')) AS conv, doc_id, ['user', 'assistant', 'system'][doc_id % 3 + 1] AS role,
    trim(regexp_replace(regexp_replace(text, '(?s)<graph-memories>.*?</graph-memories>', '', 'g'), '(?s)<relevant-memories>.*?</relevant-memories>', '', 'g')) AS x
  FROM documents WHERE sourceauthor IS NOT NULL AND text IS NOT NULL),
l AS (SELECT conv, doc_id, '[' || role || ']: ' || CASE WHEN length(x) > 600 THEN substring(x, 1, 600) || '... [truncated]' ELSE x END AS line
  FROM t WHERE role <> 'system' AND x <> '')
SELECT conv, count(*) AS n_turns, sha256(string_agg(line, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM l GROUP BY 1
HAVING length(string_agg(line, chr(10) || chr(10) ORDER BY doc_id)) >= 20""")
def transcript_build(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts, messages cut at 600 characters so that the cut occurs."""
    t = wr.transcripts(_turns(spark, d), most=600)
    return t.select("conv", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("transcript", 256).alias("digest"))


@query(r"""
SELECT id FROM mem WHERE salience >= 0.5 AND length(content) >= 20
  AND NOT regexp_matches(content, '^(ok|okay|好的?|谢谢|thanks|sure|got it|sounds good|明白|嗯|对)', 'i')""")
def writer_filter(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "id", "content", "salience")
    return m.where(text.worth_keeping(F.col("content"), F.col("salience"))).select("id")


@query(r"""SELECT id, sha256(sessionid || chr(10) || regexp_replace(trim(regexp_replace(lower(content), '\s+', ' ', 'g')), '[.!]+$', '')) AS writekey
FROM mem WHERE sessionid IS NOT NULL AND content IS NOT NULL""")
def write_key(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d, "id", "sessionid", "content").where("sessionid is not null and content is not null")
    return m.select("id", text.write_key(F.col("sessionid"), F.col("content")).alias("writekey"))


@query("""SELECT id, least(1.0, greatest(0.0, coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.5))) AS confidence FROM mem""")
def clamp_scores(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "id", "confidence").select("id", text.unit_interval(F.col("confidence")).alias("confidence"))


@query("""
, old AS (SELECT * FROM ses WHERE messagecount % 2 = 0), nw AS (SELECT id || '-new' AS id, key, 'again' AS summary, messagecount + 1 AS messagecount FROM ses WHERE key IS NOT NULL)
SELECT coalesce(old.id, nw.id) AS id, coalesce(old.key, nw.key) AS key, coalesce(nw.summary, old.summary) AS summary,
  coalesce(nw.messagecount, old.messagecount, 0) AS messagecount FROM old FULL JOIN nw ON old.key = nw.key""")
def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with an even message count, met by a second delivery of all."""
    s = table(spark, d, "sessions", "id", "key", "summary", "messagecount")
    new = s.where("key is not null").select(F.concat("id", F.lit("-new")).alias("id"), "key", F.lit("again").alias("summary"), (F.col("messagecount") + 1).alias("messagecount"))
    return wr.upsert_sessions(s.where("messagecount % 2 = 0"), new).fillna({"messagecount": 0})


@query("""
, f AS (SELECT id, sessionid, v FROM vec WHERE status IN ('archived', 'suppressed') AND sessionid IS NOT NULL),
h AS (
  SELECT f.id AS fact_id, m.id, list_cosine_similarity(f.v, m.v) AS c FROM f JOIN vec m ON m.sessionid = f.sessionid AND m.status IN ('raw', 'reviewed'))
SELECT fact_id, id, round(c, 6) AS cosine FROM h WHERE c >= 0.1 QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY round(c, 9) DESC, id DESC) = 1""")
def session_restatement_gate(spark: SparkSession, d: str) -> DataFrame:
    """The most similar active memory of the session for each set-aside one (from 0.1 on these vectors)."""
    m = memories(spark, d).where(vectors.usable(F.col("embedding")))
    facts = m.where("status in ('archived', 'suppressed') and sessionid is not null").select(F.col("id").alias("fact_id"), "sessionid", "embedding")
    return wr.restatements(facts, m, 0.1).withColumn("cosine", F.round("cosine", 6))


@query("""
SELECT id AS fact_id, CASE WHEN writekey IN (SELECT writekey FROM mem o WHERE o.status <> 'raw' AND o.sessionid = mem.sessionid AND writekey IS NOT NULL) THEN 'already_written' ELSE 'other' END AS outcome
FROM mem WHERE status = 'raw' AND sessionid IS NOT NULL AND writekey IS NOT NULL""")
def write_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Raw facts whose key is in their session already."""
    m = memories(spark, d)
    new = m.where("status = 'raw' and sessionid is not null and writekey is not null")
    facts = new.select(F.col("id").alias("fact_id"), "sessionid", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("pos"), "writekey", "embedding")
    old = m.where("status <> 'raw' and sessionid is not null")
    keys = old.where("writekey is not null").select(F.col("sessionid").alias("s"), F.col("writekey").alias("w")).distinct()
    had = new.join(keys, (F.col("sessionid") == F.col("s")) & (F.col("writekey") == F.col("w")), "left_semi").select(F.col("id").alias("had_id"))
    out = wr.write_facts(facts, old)
    out = out.join(had, F.col("fact_id") == F.col("had_id"), "left")
    return out.select("fact_id", F.when((F.col("outcome") == "already_written") & F.col("had_id").isNotNull(), "already_written").otherwise("other").alias("outcome"))


@query("""
, nw AS (SELECT name, any_value(type) AS type FROM ent WHERE active GROUP BY 1), old AS (SELECT DISTINCT ON (name) id, name FROM ent WHERE key IS NOT NULL ORDER BY name, id)
SELECT coalesce(old.id, 'ent-' || substring(sha256(nw.name), 1, 32)) AS id, coalesce(old.name, nw.name) AS name FROM old FULL JOIN nw ON nw.name = old.name""")
def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Entities with a key, met by a delivery of all active ones."""
    e = table(spark, d, "entities", "id", "name", "type", "aliases", "firstseen", "active", "key")
    old = e.where("key is not null").groupBy("name").agg(F.min_by(F.struct("id", "type", "aliases", "firstseen"), "id").alias("x")).select("x.id", "name", "x.type", "x.aliases", "x.firstseen")
    new = e.where("active").select("name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.col("firstseen").alias("seen"))
    return wr.upsert_entities(old, new).select("id", "name")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN id IN (SELECT src_id FROM canon) THEN 'suppressed' ELSE status END AS status FROM mem) GROUP BY 1")
def suppress_memories(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    return wr.suppress(g.memory, g.canonical.select(F.col("src_id").alias("id"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def parse_event_props(spark: SparkSession, d: str) -> DataFrame:
    """Typed access to JSON properties."""
    e = table(spark, d, "events", "event_type", "props").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k"))


@query()
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose text form does not give them back: none."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    back = e.withColumn("back", vectors.decode_vector(vectors.encode_vector("embedding")))
    return back.select("vec_id", (F.to_json("back") == F.to_json("embedding")).alias("same"))


@query("SELECT user_id, event_type, max(ts) AS last_at, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_attribute(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each attribute of each user."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
