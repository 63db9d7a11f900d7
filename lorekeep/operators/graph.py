"""Reads over the memory graph: every scan, join, count and walk, as plain DataFrames.

``Graph`` holds one DataFrame per node and edge table.  All reads are batch operations over whole tables; where the
graph store would ask one id at a time, a join answers for all.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.runtime import cut


@dataclass
class Graph:
    memory: DataFrame
    entity: DataFrame
    session: DataFrame
    mentions: DataFrame
    relates_to: DataFrame
    canonical: DataFrame
    supersedes: DataFrame
    linked_to: DataFrame
    merged_into: DataFrame
    distinct_from: DataFrame
    in_category: DataFrame
    category: DataFrame
    asked: DataFrame | None = None  # entity pairs put to the provider; delivered tables have none

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}


def unordered(df: DataFrame, a: str = "src_id", b: str = "dst_id") -> DataFrame:
    """(lo, hi): distinct unordered pairs."""
    return df.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def is_active(status: Column | str = "status") -> Column:
    return F.col(status).isin("raw", "reviewed") if isinstance(status, str) else status.isin("raw", "reviewed")


def not_merged(g: Graph) -> DataFrame:
    return g.entity.join(g.merged_into.select(F.col("src_id").alias("id")), "id", "left_anti")


def not_canonical(g: Graph, rows: DataFrame) -> DataFrame:
    return rows.join(g.canonical.select(F.col("src_id").alias("id")), "id", "left_anti")


def raw_batch(g: Graph, limit: int = schema.BATCH) -> DataFrame:
    """The oldest raw memories with their mentions and session: the limit is taken before the joins."""
    b = g.memory.where("status = 'raw'").orderBy("timestamp", "content", "id").limit(limit)
    b = b.select("id", "content", "timestamp", "sessionid")
    e = g.mentions.join(g.entity.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    seen = (
        b.select("id").join(e, F.col("id") == F.col("memory_id"))
        .groupBy("id").agg(F.array_sort(F.collect_set(F.struct("name", "role"))).alias("entities"))
    )
    s = g.session.select(F.col("id").alias("sessionid"), "channel")
    return b.join(seen, "id", "left").join(s, "sessionid", "left").withColumn(
        "entities", F.coalesce("entities", F.array().cast("array<struct<name:string,role:string>>"))
    )


def active_embeddings(g: Graph) -> DataFrame:
    """Active, embedded memories that are no duplicates of others."""
    return not_canonical(g, g.memory.where(is_active() & F.col("embedding").isNotNull()))


def category_members(g: Graph) -> DataFrame:
    """(name, memory_id, timestamp, content): members of each category; an empty category has one row without a member.

    One row per membership: a category may hold a large share of all memories, so no list is gathered.
    """
    m = g.in_category.join(g.memory.select(F.col("id").alias("memory_id"), "timestamp", "content"), "memory_id")
    return g.category.select("name").join(m.select(F.col("category").alias("name"), "memory_id", "timestamp", "content"), "name", "left")


def category_sizes(g: Graph) -> DataFrame:
    """(name, n_members, first_id): size and earliest member of each category."""
    return category_members(g).groupBy("name").agg(F.count("memory_id").alias("n_members"), F.min_by("memory_id", F.struct("timestamp", "content", "memory_id")).alias("first_id"))


def shared_entities(g: Graph) -> DataFrame:
    """(entity_id, n, first_id): entities that several active memories mention, with the earliest of these."""
    m = g.memory.where(is_active()).select(F.col("id").alias("memory_id"), "timestamp")
    per = g.mentions.select("memory_id", "entity_id").distinct().join(m, "memory_id").groupBy("entity_id")
    return per.agg(F.count(F.lit(1)).alias("n"), F.min_by("memory_id", F.struct("timestamp", "memory_id")).alias("first_id")).where("n > 1")


def shared_entity_groups(g: Graph, most: int | None = None) -> DataFrame:
    """(entity_id, n, memory_id): active memories of each entity with more than one (and at most ``most``), one row each."""
    e = shared_entities(g).where(F.lit(True) if most is None else F.col("n") <= most).select("entity_id", "n")
    live = g.memory.where(is_active()).select(F.col("id").alias("memory_id"))
    return g.mentions.select("memory_id", "entity_id").distinct().join(live, "memory_id", "left_semi").join(e, "entity_id").select("entity_id", "n", "memory_id")


def first_samples(rows: DataFrame, keys: list[str], content: str, n: int = 3) -> DataFrame:
    """(keys, samples): the first ``n`` contents of each key by content; a ranked cut, not a gathered list."""
    w = Window.partitionBy(*keys).orderBy(content, "memory_id")
    return (
        rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", content))), lambda t: t[content]).alias("samples"))
    )


def resolution_entities(g: Graph, samples: int = 3) -> DataFrame:
    """Unmerged entities with type, aliases, number of mentions and first texts."""
    m = g.mentions.select("memory_id", "entity_id").join(
        g.memory.select(F.col("id").alias("memory_id"), "content"), "memory_id"
    )
    n = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions"))
    t = first_samples(m, ["entity_id"], "content", samples)
    e = not_merged(g).select(
        F.col("id").alias("entity_id"), "name", F.coalesce("normalizedtype", "type").alias("type"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )
    return e.join(n, "entity_id", "left").join(t, "entity_id", "left").fillna({"mentions": 0})


def co_mentioned_pairs(mentions: DataFrame) -> DataFrame:
    """(lo, hi): entities that some memory mentions together, whatever its status."""
    m = mentions.select("memory_id", "entity_id").distinct()
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.memory_id") == F.col("b.memory_id")) & (F.col("a.entity_id") < F.col("b.entity_id"))).select(
        F.col("a.entity_id").alias("lo"), F.col("b.entity_id").alias("hi")
    ).distinct()


def entity_co_mentions(g: Graph, kind: str = "Person", samples: int = 3) -> DataFrame:
    """Pairs of entities of one raw type in active memories, with their number and first texts, most frequent first."""
    e = not_merged(g).where(F.col("type") == kind).select(F.col("id").alias("entity_id"), "name")
    m = g.mentions.select("memory_id", "entity_id").distinct().join(e, "entity_id")
    m = m.join(g.memory.where(is_active()).select(F.col("id").alias("memory_id"), "content"), "memory_id")
    a, b = m.alias("a"), m.drop("content").alias("b")
    p = a.join(b, (F.col("a.memory_id") == F.col("b.memory_id")) & (F.struct("a.name", "a.entity_id") < F.struct("b.name", "b.entity_id")))
    p = p.select(
        F.col("a.entity_id").alias("id_a"), F.col("a.name").alias("name_a"), F.col("b.entity_id").alias("id_b"),
        F.col("b.name").alias("name_b"), F.col("a.memory_id").alias("memory_id"), "content",
    )
    keys = ["id_a", "id_b"]
    n = p.groupBy(*keys, "name_a", "name_b").agg(F.count(F.lit(1)).alias("co_count"))
    return n.join(first_samples(p, keys, "content", samples), keys).orderBy(F.desc("co_count"), "name_a", "name_b", *keys)


def unlinked(pairs: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs without an edge in either direction."""
    e = unordered(edges)
    return pairs.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)).join(e, ["lo", "hi"], "left_anti").drop("lo", "hi")


def current_memories(g: Graph) -> DataFrame:
    """Active, embedded, still valid memories that are no duplicates, with the ids of their entities."""
    m = not_canonical(g, g.memory.where(is_active() & F.col("validto").isNull() & F.col("embedding").isNotNull()))
    e = g.mentions.groupBy(F.col("memory_id").alias("id")).agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return m.join(e, "id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def conflict_links(g: Graph) -> DataFrame:
    """(lo, hi): pairs already linked as superseding or contradicting."""
    c = g.relates_to.where("type = 'contradicts'").select("src_id", "dst_id")
    return unordered(g.supersedes.select("src_id", "dst_id").unionByName(c))


def surviving(g: Graph, ids: DataFrame) -> DataFrame:
    """Ids of a batch whose memories are not archived."""
    return ids.join(g.memory.where("status <> 'archived'").select("id"), "id", "left_semi")


def graph_stats(g: Graph) -> DataFrame:
    """One row of counts; every count is its own aggregation of one row, so the cross join is of single rows."""
    m = g.memory.agg(
        F.count(F.lit(1)).alias("memories"), F.count_if(F.col("status") == "raw").alias("raw"),
        F.count_if(F.col("status") == "archived").alias("archived"),
    )
    for name, df in (("entities", g.entity), ("sessions", g.session), ("categories", g.category), ("relations", g.relates_to), ("links", g.linked_to)):
        m = m.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))
    return m


#: Entities of a memory up to which its sets of entities are counted.
SUBSETS = 10


def candidate_pair_count(mentions: DataFrame, most: int = SUBSETS) -> DataFrame:
    """Distinct unordered pairs of memories that share an entity, one row; null ends count for nothing.

    No pair is made, however many memories an entity has: pairs that share at least one entity are the sum over all sets T of
    entities of (-1)^(|T|+1) n(n-1)/2, n the memories that mention all of T.  Only memories of more than ``most``
    entities are paired one by one.
    """
    own = mentions.where("memory_id is not null and entity_id is not null").groupBy("memory_id").agg(F.array_sort(F.collect_set("entity_id")).alias("e"))
    # one row per set of entities that some memory has
    few = own.where(F.size("e") <= most).groupBy("e").agg(F.count(F.lit(1)).alias("k"))
    masks = few.select("k", "e", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("e")) - 1).cast("int"))).alias("mask"))
    chosen = F.filter("e", lambda _, i: F.getbit(F.col("mask"), i) == 1)
    sets = masks.groupBy(chosen.alias("t")).agg(F.sum("k").alias("n"))
    sign = F.when(F.size("t") % 2 == 1, 1).otherwise(-1)
    narrow = sets.agg(F.coalesce(F.sum(sign * (F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))
    wide = own.where(F.size("e") > most).select(F.col("memory_id").alias("x"), F.explode("e").alias("entity"))
    every = own.select(F.col("memory_id").alias("y"), F.explode("e").alias("entity"))
    met = wide.join(every, "entity").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return narrow.unionByName(met.agg(F.count(F.lit(1)).alias("pairs"))).agg(F.sum("pairs").cast("long").alias("pairs"))


def fingerprint(tables: dict[str, DataFrame], leave_out: tuple[str, ...] = ("embedding", "embeddingtext")) -> DataFrame:
    """(table, row, n): the graph as a multiset of rows, without derived vectors."""
    out = None
    for name, df in sorted(tables.items()):
        cols = [c for c in sorted(df.columns) if c not in leave_out]
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*cols)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table", "row").agg(F.count(F.lit(1)).alias("n"))


def roots(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, root): where the successor edges of each start end.

    Of several successors the smallest is followed.  A walk that runs into a cycle ends at the last node
    before it would repeat itself; ``max_hops`` bounds the walk.
    """
    step = edges.groupBy(F.col("src_id").alias("s")).agg(F.min("dst_id").alias("d")).where("s <> d")
    walk = starts.select("id", F.col("id").alias("root"), F.array("id").alias("path"), F.lit(True).alias("open"))
    hops = 0
    while max_hops is None or hops < max_hops:
        nxt = walk.join(step, F.col("root") == F.col("s"), "left")
        goes = F.col("open") & F.col("d").isNotNull() & ~F.array_contains("path", F.col("d"))
        walk = cut(
            nxt.select(
                "id", F.when(goes, F.col("d")).otherwise(F.col("root")).alias("root"),
                F.when(goes, F.array_append("path", F.col("d"))).otherwise(F.col("path")).alias("path"),
                F.coalesce(goes, F.lit(False)).alias("open"),
            )
        )
        hops += 1
        if walk.where("open").isEmpty():
            break
    return walk.select("id", "root")


def run_list(runs: DataFrame, actions: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs with the number of their actions."""
    n = actions.groupBy(F.col("runid").alias("id")).agg(F.count(F.lit(1)).alias("actions"))
    return runs.join(n, "id", "left").fillna({"actions": 0}).orderBy(F.desc("startedat"), "id").limit(limit)


def later_runs(runs: DataFrame, run_id: str) -> DataFrame:
    """Runs begun after this one that were not rolled back, in order."""
    this = runs.where(F.col("id") == run_id).select(F.col("startedat").alias("at"))
    return runs.join(F.broadcast(this), F.col("startedat") > F.col("at")).where("status <> 'rolled_back'").orderBy("startedat").select("id", "startedat")


def demo_graph(spark) -> dict[str, DataFrame]:
    """A small graph for demonstrations: two sessions, five entities, four memories, two categories and their edges."""
    from datetime import datetime

    t1, t2 = datetime(2026, 3, 1, 9), datetime(2026, 3, 4, 18)
    mk = lambda name, rows: spark.createDataFrame(
        [tuple(r.get(f.name) for f in schema.TABLES[name].fields) for r in rows], schema.TABLES[name]
    )
    say = [("m1", "s1", "Iris moved the survey project to the Lisbon office", "decision", t1), ("m2", "s1", "Iris prefers tea over coffee in meetings", "preference", t1),
           ("m3", "s2", "The survey project uses DuckDB for its checks", "fact", t2), ("m4", "s2", "Iris wants to finish the survey before May", "goal", t2)]
    return {
        "session": mk("session", [{"id": "s1", "key": "demo:1", "date": t1, "summary": "office move", "messagecount": 4, "channel": "cli"}, {"id": "s2", "key": "demo:2", "date": t2, "summary": "tools", "messagecount": 6, "channel": "cli"}]),
        "entity": mk("entity", [{"id": f"e{i}", "name": n, "type": t, "aliases": [], "firstseen": t1} for i, (n, t) in enumerate([("Iris", "Person"), ("Survey", "Project"), ("Lisbon", "Place"), ("DuckDB", "Tool"), ("Tea", "Concept")])]),
        "memory": mk("memory", [{"id": i, "sessionid": s, "content": c, "kind": k, "timestamp": t, "validfrom": t, "confidence": 0.8, "salience": 0.7, "status": "reviewed"} for i, s, c, k, t in say]),
        "category": mk("category", [{"name": "work", "description": "projects and plans"}, {"name": "habits", "description": "tastes"}]),
        "mentions": mk("mentions", [{"memory_id": m, "entity_id": e, "role": r} for m, e, r in [("m1", "e0", "subject"), ("m1", "e1", "object"), ("m1", "e2", "context"), ("m2", "e0", "subject"), ("m2", "e4", "object"), ("m3", "e1", "subject"), ("m3", "e3", "object"), ("m4", "e0", "subject"), ("m4", "e1", "object")]]),
        "in_category": mk("in_category", [{"memory_id": m, "category": c, "score": 0.9, "assignedby": "demo"} for m, c in [("m1", "work"), ("m2", "habits"), ("m3", "work"), ("m4", "work")]]),
        "relates_to": mk("relates_to", [{"src_id": "m4", "dst_id": "m1", "type": "follows", "weight": 0.7}]),
        "linked_to": mk("linked_to", [{"src_id": "e0", "dst_id": "e1", "relation": "member_of", "detail": "leads it", "sentiment": "positive", "strength": 0.9}]),
    }


