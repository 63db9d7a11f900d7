"""Hybrid retrieval for many queries at once: vector seeds, graph expansion, rerank, decoration, context text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.functions import scoring, vectors
from lorekeep.operators.graph import Graph
from lorekeep.runtime import cut, maybe_broadcast

LIMIT, LEAST_SCORE, LEAST_PROMPT = 8, 0.1, 3
LIVE = ("active", "raw", "reviewed")


def seed_count(limit: int) -> int:
    return max(5, math.ceil(0.6 * limit))


def seeds(g: Graph, queries: DataFrame, as_of, limit: int = 10, overfetch: bool = False, dims: int = 64) -> DataFrame:
    """(q, id, score): the best vector hits.

    Archived, suppressed and expired memories are left out before ranking; with ``overfetch`` only among the
    three-fold nearest ones, as an approximate index would.  Scores weigh confidence, salience and validity.
    """
    n, now = seed_count(limit), F.lit(as_of).cast("timestamp")
    m = g.memory.where(vectors.usable(F.col("embedding"), dims))
    ok = ~F.col("status").isin("archived", "suppressed") & (F.col("expiresat").isNull() | (F.col("expiresat") >= now))
    weight = scoring.base_score(F.lit(1.0), F.nanvl("confidence", F.lit(None)), F.col("salience")) * scoring.validity(F.col("validto"), now)
    live = m.where(F.coalesce(ok, F.lit(True)))
    if not overfetch:  # the weight is the row's own, so each batch of rows ranks by the final score at once
        return vectors.top_k(queries, live, n, weight=weight).select("q", "id", "score")
    hits = vectors.top_k(queries, m, 3 * n).select("q", "id", F.col("score").alias("cosine"))
    scored = hits.join(live.select("id", weight.alias("w")), "id").select("q", "id", (F.col("cosine") * F.col("w")).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def entity_degrees(g: Graph) -> DataFrame:
    """(entity_id, n_live): live memories of each active entity."""
    live = g.memory.where(F.col("status").isin(*LIVE)).select(F.col("id").alias("memory_id"))
    act = g.entity.where("active is null or active").select(F.col("id").alias("entity_id"))
    return (
        g.mentions.select("memory_id", "entity_id").distinct().join(live, "memory_id", "left_semi").join(act, "entity_id", "left_semi")
        .groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_live"))
    )


def seed_entities(g: Graph, found: DataFrame, hub: int = schema.HUB) -> DataFrame:
    """(q, entity_id, seed_hits, n_live, is_hub): active entities of the seeds."""
    act = g.entity.where("active is null or active").select(F.col("id").alias("entity_id"))
    m = g.mentions.select(F.col("memory_id").alias("id"), "entity_id").distinct().join(act, "entity_id", "left_semi")
    hits = found.join(m, "id").groupBy("q", "entity_id").agg(F.count(F.lit(1)).alias("seed_hits"))
    return hits.join(entity_degrees(g), "entity_id", "left").fillna({"n_live": 0}).withColumn("is_hub", F.col("n_live") > hub)


def expansions(g: Graph, queries: DataFrame, found: DataFrame, as_of, hub: int = schema.HUB) -> DataFrame:
    """(q, id, score): live memories that share a non-hub entity with the seeds.

    Hubs are dropped before the join, so an entity adds at most ``hub`` memories per query.
    """
    now = F.lit(as_of).cast("timestamp")
    e = seed_entities(g, found, hub).where("not is_hub").select("q", "entity_id")
    live = g.memory.where(F.col("status").isin(*LIVE) & (F.col("expiresat").isNull() | (F.col("expiresat") > now)))
    m = g.mentions.select(F.col("memory_id").alias("id"), "entity_id").distinct()
    shared = e.join(m, "entity_id").join(found.select("q", "id"), ["q", "id"], "left_anti").groupBy("q", "id").agg(F.count(F.lit(1)).alias("shared"))
    qv = maybe_broadcast(queries.select(F.col("id").alias("q"), F.col("embedding").alias("qv")))
    cand = shared.join(live.select("id", "embedding", "confidence", "salience", "validto"), "id").join(qv, "q")
    sim = F.coalesce(vectors.cosine(F.col("qv"), F.col("embedding")), F.lit(0.0))
    base = scoring.base_score(sim, F.nanvl("confidence", F.lit(None)), F.col("salience"))
    return cand.select("q", "id", ((base + scoring.entity_bonus(F.col("shared"))) * scoring.validity(F.col("validto"), now)).alias("score"))


def retrieve(g: Graph, queries: DataFrame, as_of, limit: int = 10, categories: DataFrame | None = None, overfetch: bool = False) -> DataFrame:
    """(q, rank, id, score, source): the best of seeds and expansions for each query (columns id, embedding).

    ``categories`` (category names) restricts the memories first.  Queries without usable vectors have no rows.
    """
    q = cut(queries.where(vectors.usable(F.col("embedding"))).select("id", "embedding"))
    if categories is not None:
        own = g.in_category.join(categories, "category", "left_semi").select(F.col("memory_id").alias("id"))
        g = Graph(**(g.tables() | {"memory": g.memory.join(own, "id", "left_semi")}))
    s = cut(seeds(g, q, as_of, limit, overfetch))
    both = s.withColumn("source", F.lit("vector")).unionByName(expansions(g, q, s, as_of).withColumn("source", F.lit("graph")))
    best = both.groupBy("q", "id").agg(F.max_by(F.struct("score", "source"), F.col("score")).alias("b")).select("q", "id", "b.score", "b.source")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def decorate(g: Graph, ranked: DataFrame, most: int = 3) -> DataFrame:
    """(q, id, entities, relations): names of each result's entities and links among the entities of the query's results.

    An entity shows at most ``most`` links, by name and relation.  Links are looked up by both ends: a query's entities are
    paired with the names of its results first, as a hub has far more links than a query has names.
    """
    ranked = cut(ranked.select("q", "id"))
    act = g.entity.where("active is null or active").select(F.col("id").alias("entity_id"), "name")
    m = g.mentions.select(F.col("memory_id").alias("id"), "entity_id").distinct().join(act, "entity_id")
    seen = cut(ranked.join(m, "id"))
    names = seen.groupBy("q", "id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    links = g.linked_to.where("relation is not null").join(act.select(F.col("entity_id").alias("dst_id"), F.col("name").alias("other")), "dst_id")
    links = links.select(F.col("src_id").alias("entity_id"), "other", "relation").distinct()
    per = seen.groupBy("q").agg(F.collect_set("entity_id").alias("es"), F.collect_set("name").alias("others"))
    ends = per.select("q", F.explode("es").alias("entity_id"), "others").select("q", "entity_id", F.explode("others").alias("other"))
    w = Window.partitionBy("q", "entity_id").orderBy("other", "relation")
    l = ends.join(links, ["entity_id", "other"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    l = seen.join(l, ["q", "entity_id"])
    rel = l.groupBy("q", "id").agg(F.array_sort(F.collect_set(F.concat("name", F.lit(" is "), "relation", F.lit(" of "), "other"))).alias("relations"))
    empty = F.array().cast("array<string>")
    return ranked.select("q", "id").join(names, ["q", "id"], "left").join(rel, ["q", "id"], "left").select(
        "q", "id", F.coalesce("entities", empty).alias("entities"), F.coalesce("relations", empty).alias("relations")
    )


def context_text(g: Graph, ranked: DataFrame, as_of, least: float = LEAST_SCORE) -> DataFrame:
    """(q, context): the text block that is put before a prompt; queries without a good result have none."""
    now, ranked = F.lit(as_of).cast("timestamp"), cut(ranked)
    m = g.memory.select("id", "content", F.coalesce("normalizedkind", "kind").alias("kind"), "validto")
    r = ranked.where(F.col("score") >= least).join(m, "id").join(decorate(g, ranked), ["q", "id"])
    w = Window.partitionBy("q").orderBy("rank")
    line = F.concat(
        F.row_number().over(w).cast("string"), F.lit(". ["), F.coalesce("kind", F.lit("?")), F.lit("]"),
        F.when(F.size("entities") > 0, F.concat(F.lit(" ("), F.array_join("entities", ", "), F.lit(")"))).otherwise(""),
        F.lit(" "), F.col("content"),
        F.when(scoring.superseded(F.col("validto"), now), F.concat(F.lit(" [outdated since "), F.date_format("validto", "yyyy-MM-dd"), F.lit("]"))).otherwise(""),
        F.lit(" ("), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%)"),
    )
    per = r.withColumn("line", line).groupBy("q").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda t: t["line"]).alias("lines"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("relations")))).alias("rels"),
    )
    rels = F.when(F.size("rels") > 0, F.concat(F.lit("\n\nEntity relationships:\n- "), F.array_join("rels", "\n- "))).otherwise("")
    return per.select(
        "q",
        F.concat(F.lit("<graph-memories>\nRelevant memories from your knowledge graph:\n"), F.array_join("lines", "\n"), rels, F.lit("\n</graph-memories>")).alias("context"),
    )
