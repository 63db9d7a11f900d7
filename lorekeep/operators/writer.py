"""Capture: transcripts, fact normalisation, idempotent upserts of sessions, facts, entities and links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.functions import text
from lorekeep.functions.vectors import _unit


def transcripts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", most: int = schema.MESSAGE_MOST) -> DataFrame:
    """(conv, transcript, n_turns): user and assistant turns in order, joined by blank lines; those under 20 characters are dropped."""
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), text.message_line(F.col("role"), F.col("text"), most).alias("line"))
    t = m.where("line is not null").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda r: r["line"]), "\n\n")
    return t.select("conv", joined.alias("transcript"), F.size("x").alias("n_turns")).where(F.length("transcript") >= schema.TRANSCRIPT_LEAST)


REPLY = (
    "facts array<struct<content:string,kind:string,confidence:double,salience:double,eventTimeStart:string,eventTimeEnd:string,"
    "sourceQuote:string,entities:array<struct<name:string,type:string,aliases:array<string>,role:string>>,"
    "relations:array<struct<targetContent:string,type:string,weight:double>>>>,"
    "entityLinks array<struct<source:string,target:string,relation:string,detail:string,sentiment:string,strength:double>>,sessionSummary string"
)


def parse_extractions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Model replies as typed columns; a reply without valid JSON has nulls."""
    r = F.from_json(text.first_json(F.col(reply)), REPLY)
    return replies.withColumn("r", r).select(*replies.columns, "r.*")


def normal_facts(extracted: DataFrame) -> DataFrame:
    """One row per kept fact with clamped scores, dates, entities with valid roles and relations that are not reserved."""
    f = extracted.where("facts is not null").select(*[c for c in extracted.columns if c not in ("facts", "entityLinks", "sessionSummary", "reply")], F.posexplode("facts").alias("pos", "f"))
    entities = F.transform(
        F.coalesce("f.entities", F.array().cast("array<struct<name:string,type:string,aliases:array<string>,role:string>>")),
        lambda e: F.struct(
            e["name"].alias("name"), F.coalesce(F.nullif(e["type"], F.lit("")), F.lit("Concept")).alias("type"),
            F.coalesce(e["aliases"], F.array().cast("array<string>")).alias("aliases"), text.valid_role(e["role"]).alias("role"),
        ),
    )
    relations = F.transform(
        F.filter(F.coalesce("f.relations", F.array().cast("array<struct<targetContent:string,type:string,weight:double>>")), lambda r: ~r["type"].startswith("editor:")),
        lambda r: F.struct(r["targetContent"].alias("target"), r["type"].alias("type"), text.unit_interval(r["weight"]).alias("weight")),
    )
    keep = [c for c in f.columns if c != "f"]
    return f.select(
        *keep, F.col("f.content").alias("content"), F.col("f.kind").alias("kind"), text.unit_interval(F.col("f.confidence")).alias("confidence"),
        text.unit_interval(F.col("f.salience")).alias("salience"), text.iso_date(F.col("f.eventTimeStart")).alias("eventtimestart"),
        text.iso_date(F.col("f.eventTimeEnd")).alias("eventtimeend"), F.substring("f.sourceQuote", 1, 100).alias("sourcequote"),
        entities.alias("entities"), relations.alias("relations"),
    ).where(text.worth_keeping(F.col("content"), F.col("salience")))


def normal_links(extracted: DataFrame) -> DataFrame:
    l = extracted.where("entityLinks is not null").select(F.explode("entityLinks").alias("l"))
    return l.select(
        "l.source", "l.target", "l.relation", F.coalesce("l.detail", F.lit("")).alias("detail"),
        F.coalesce("l.sentiment", F.lit("neutral")).alias("sentiment"), text.unit_interval(F.col("l.strength")).alias("strength"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key: a new key is added, an old one keeps its values but for ``overwrite``.  Null keys never match."""
    n = new.dropDuplicates(keys)
    o, m = old.alias("o"), n.select(*[F.col(c).alias(f"__{c}") for c in n.columns], F.lit(True).alias("__new"))
    j = o.join(m, [F.col(f"o.{k}") == F.col(f"__{k}") for k in keys], "full_outer")
    was = F.coalesce(*[F.col(f"o.{k}").isNotNull() for k in keys])

    def pick(c: str):
        if c not in n.columns:
            return F.col(f"o.{c}").alias(c)
        fresh = F.col(f"__{c}")
        if c in overwrite:
            return F.when(F.col("__new").isNotNull(), fresh).otherwise(F.col(f"o.{c}")).alias(c)
        return F.when(was, F.col(f"o.{c}")).otherwise(fresh).alias(c)

    return j.select(*[pick(c) for c in old.columns])


def upsert_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions by key: id, date and channel are set once, summary and message count always."""
    return upsert(sessions, new, ["key"], ("summary", "messagecount"))


def restatements(facts: DataFrame, memories: DataFrame, least: float = schema.RESTATEMENT) -> DataFrame:
    """(fact_id, id, cosine): for each fact (fact_id, sessionid, embedding) the most similar active memory of its session, if it
    reaches ``least``; an equi-join on the session, the best hit by aggregation."""
    from lorekeep.functions.vectors import cosine

    live = memories.where("status in ('raw', 'reviewed')").select("id", "sessionid", F.col("embedding").alias("me"))
    p = facts.join(live, "sessionid").withColumn("cosine", cosine(F.col("embedding"), F.col("me"))).where(F.col("cosine") >= least)
    best = p.groupBy("fact_id").agg(F.max_by(F.struct("id", "cosine"), F.struct(F.round("cosine", 9), "id")).alias("b"))
    return best.select("fact_id", "b.id", "b.cosine")


def _gate_session(old: list, keys: set, rows: pd.DataFrame, least: float) -> list[tuple]:
    """Outcome of each fact of a session in order; later facts see earlier written ones."""
    out, vecs = [], [v for v in old if v is not None]
    for r in rows.itertuples(index=False):
        if r.writekey in keys:
            out.append((r.fact_id, "already_written", None))
            continue
        best = None
        if r.embedding is not None and vecs:
            same = [v for v in vecs if len(v) == len(r.embedding)]
            if same:
                best = float((_unit([r.embedding]) @ _unit(same).T).max())
        if best is not None and best >= least:
            out.append((r.fact_id, "skipped_similar", best))
            continue
        out.append((r.fact_id, "written", None))
        keys.add(r.writekey)
        if r.embedding is not None:
            vecs.append(np.asarray(r.embedding))
    return out


def write_facts(facts: DataFrame, memories: DataFrame, least: float = schema.RESTATEMENT) -> DataFrame:
    """(fact_id, outcome, similarity): already_written, skipped_similar or written for each fact (fact_id, sessionid, pos, writekey,
    embedding), session by session in order of ``pos``.

    Only facts and memories of the sessions concerned are grouped; a session is one conversation.
    """
    live = memories.where("status in ('raw', 'reviewed') or writekey is not null").join(facts.select("sessionid").distinct(), "sessionid", "left_semi")
    live = live.select("sessionid", "writekey", F.when(F.col("status").isin("raw", "reviewed"), F.col("embedding")).alias("embedding"))

    def fold(key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values(["pos", "fact_id"])
        new["embedding"] = [None if x is None or np.ndim(x) == 0 else x for x in new["embedding"]]
        had = [x for x in old["embedding"] if x is not None and np.ndim(x)]
        rows = _gate_session(had, set(old["writekey"].dropna()), new, least)
        return pd.DataFrame(rows, columns=["fact_id", "outcome", "similarity"])

    kind = dict(facts.dtypes)["fact_id"]
    # fresh column identities: both sides may come from one table
    f = facts.select("sessionid", "fact_id", "pos", "writekey", "embedding").toDF("sid", "fact_id", "pos", "writekey", "embedding")
    live = live.toDF("sid2", "writekey", "embedding")
    return f.groupBy("sid").cogroup(live.groupBy("sid2")).applyInPandas(fold, f"fact_id {kind}, outcome string, similarity double")


def upsert_entities(entities: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities by name: a new one gets a deterministic id; a known one gains the aliases it lacks, in order."""
    new = seen.where("name is not null").groupBy("name").agg(F.min("type").alias("type"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("more"), F.min("seen").alias("seen"))
    j = entities.alias("o").join(new.select(F.col("name").alias("n"), F.col("type").alias("nt"), "more", "seen"), F.col("o.name") == F.col("n"), "full_outer")
    own = F.coalesce("o.aliases", F.array().cast("array<string>"))
    aliases = F.when(F.col("n").isNull(), F.col("o.aliases")).otherwise(F.concat(own, F.array_except(F.coalesce("more", F.array().cast("array<string>")), own)))
    fresh = F.col("o.id").isNull()
    value = {
        "id": F.coalesce("o.id", F.concat(F.lit("ent-"), F.substring(F.sha2("n", 256), 1, 32))), "name": F.coalesce("o.name", "n"),
        "type": F.when(fresh, F.col("nt")).otherwise(F.col("o.type")), "aliases": aliases, "firstseen": F.when(fresh, F.col("seen")).otherwise(F.col("o.firstseen")),
    }
    return j.select(*[(value[c] if c in value else F.col(f"o.{c}")).alias(c) for c in entities.columns])


def upsert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links by their ends; the last written wins in every property."""
    return upsert(links, new, ["src_id", "dst_id"], tuple(c for c in new.columns if c not in ("src_id", "dst_id")))


def suppress(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: the status of the given ids becomes suppressed; unknown ids change nothing."""
    hit = ids.select("id", F.lit(True).alias("__hit")).distinct()
    return memories.join(hit, "id", "left").withColumn("status", F.when(F.col("__hit"), "suppressed").otherwise(F.col("status"))).select(*memories.columns)


def forget_decision(ranked: DataFrame) -> DataFrame:
    """(q, id): what a request to forget by query suppresses: the only hit, or the best if it scores above 0.9."""
    n = ranked.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return ranked.where("rank = 1").join(n, "q").where("n = 1 or score > 0.9").select("q", "id")


def first_of_chunk(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
