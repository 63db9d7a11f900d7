"""Consolidation: duplicates, classes, categories, conflicts, entity resolution, relations, links, confidence.

Each step is a relational candidate search over whole tables and, where order matters, a small deterministic fold over the
candidate pairs of one batch.  A batch is at most ``schema.BATCH`` memories, which bounds every fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.functions import text, vectors
from lorekeep.operators import graph as gr
from lorekeep.operators.graph import Graph
from lorekeep.runtime import cut

# --- duplicates -----------------------------------------------------------------------------------


def duplicate_pairs(batch: DataFrame, rows: DataFrame, least: float = schema.EXACT, below: float = 1.01) -> DataFrame:
    """(id_a, id_b, cosine): pairs of a batch row and any row with ``least`` <= cosine < ``below``; each unordered pair once.

    ``id_a`` is the batch side; of two batch rows the larger id.
    """
    both = rows.select("id", "embedding").join(batch.select("id", F.lit(True).alias("b")), "id", "left").withColumn("in_batch", F.coalesce("b", F.lit(False)))
    return vectors.similar_to(batch, both, least, below=below, once="in_batch").select(F.col("q").alias("id_a"), F.col("id").alias("id_b"), "cosine")


def fold_duplicates(pairs: DataFrame, times: DataFrame, by_component: bool = False) -> DataFrame:
    """(dupe, survivor, cosine): duplicates to archive, taking the most similar pairs first.

    The newer memory goes into the older one, of equal times the larger id.  A memory that is archived already takes part
    no more, on either side.  The input is the candidate pairs of one batch, or of any number with ``by_component``: pairs of
    different connected components do not touch each other, so each component is folded by itself, with the same result.
    """
    t = times.select("id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"))
    ta, tb = t.select(F.col("id").alias("id_a"), F.col("t").alias("ta")), t.select(F.col("id").alias("id_b"), F.col("t").alias("tb"))
    p = pairs.join(ta, "id_a", "left").join(tb, "id_b", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for a, b, c, x, y in pdf.assign(r=pdf.cosine.round(9)).sort_values(["r", "id_a", "id_b"], ascending=[False, True, True])[["id_a", "id_b", "cosine", "ta", "tb"]].itertuples(index=False):
            if a in gone or b in gone:
                continue
            if pd.isna(x) or pd.isna(y) or x == y:
                dupe, keep = max(a, b), min(a, b)
            else:
                dupe, keep = (a, b) if x > y else (b, a)
            gone.add(dupe)
            out.append((dupe, keep, c))
        return pd.DataFrame(out, columns=["dupe", "survivor", "cosine"])

    if by_component:
        root = min_label_groups(pairs, "id_a", "id_b").select(F.col("id").alias("id_a"), "root")
        return p.join(root, "id_a").groupBy("root").applyInPandas(fold, "dupe string, survivor string, cosine double")
    return p.groupBy().applyInPandas(fold, "dupe string, survivor string, cosine double") if not p.isEmpty() else p.select(
        F.col("id_a").alias("dupe"), F.col("id_b").alias("survivor"), "cosine"
    )


def semantic_verdicts(pairs: DataFrame, provider, archived: DataFrame) -> DataFrame:
    """Verdicts on pairs below the exact level whose batch side is not archived yet."""
    return provider.ask(pairs.join(archived.select(F.col("dupe").alias("id_a")), "id_a", "left_anti"))


def repeated_texts(rows: DataFrame, ident: str, content: str) -> DataFrame:
    """(key, n, first_id): normalised texts that occur more than once."""
    return (
        rows.where(F.col(content).isNotNull()).groupBy(F.sha2(text.normal_content(F.col(content)), 256).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first_id")).where("n > 1")
    )


# --- classes and categories -----------------------------------------------------------------------


def classify(memories: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, normalizedkind), (id, normalizedtype)); null where the rules do not decide."""
    return (
        memories.select("id", text.kind_of(F.col("kind")).alias("normalizedkind")),
        entities.select("id", text.type_of(F.col("type")).alias("normalizedtype")),
    )


def assign_categories(batch: DataFrame, centres: DataFrame, least: float = schema.CATEGORY_ASSIGN, best: bool = False) -> DataFrame:
    """(id, category, score): the first category by name whose centroid is near enough; with ``best`` the nearest.

    ``centres`` (category, centroid) is broadcast: one vector per category.
    """
    c = centres.select(F.col("category"), F.col("centroid"))
    sims = vectors.similar_to(c.select(F.col("category").alias("id"), F.col("centroid").alias("embedding")), batch, least)
    order = [F.desc("cosine"), F.col("q")] if best else [F.col("q")]
    w = Window.partitionBy("id").orderBy(*order)
    return sims.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", F.col("q").alias("category"), F.col("cosine").alias("score"))


def find_clusters(ids: list, sim, least: float = schema.CATEGORY_COSINE, quorum: int = schema.CATEGORY_QUORUM) -> list[list]:
    """Greedy complete-linkage clusters: seeds, and candidates for each seed, by mean similarity to all; members are near to all others."""
    import numpy as np

    order = np.lexsort((np.arange(len(ids)), -np.round(sim.mean(1), 9)))
    free, out = np.ones(len(ids), bool), []
    for s in order:
        if not free[s]:
            continue
        own = [int(s)]
        for j in order:
            if j != s and free[j] and (sim[j, own] >= least).all():
                own.append(int(j))
        if len(own) >= quorum:
            free[own] = False
            out.append(sorted(ids[i] for i in own))
    return out


def vector_clusters(ids: list, x, least: float = schema.CATEGORY_COSINE, quorum: int = schema.CATEGORY_QUORUM) -> list[list]:
    """``find_clusters`` of unit vectors, without the matrix of all similarities: one seed's row at a time."""
    import numpy as np

    order = np.lexsort((np.arange(len(ids)), -np.round(x @ x.mean(0), 9))) if len(ids) else []
    turn = np.argsort(order)
    free, out = np.ones(len(ids), bool), []
    for s in order:
        if not free[s]:
            continue
        sim = x @ x[s]
        rest = np.flatnonzero(free & (sim >= least))
        rest = rest[rest != s]
        rest = rest[np.argsort(turn[rest])]
        own = [int(s)]
        while len(rest):
            own.append(int(rest[0]))
            rest = rest[1:]
            rest = rest[x[rest] @ x[own[-1]] >= least]
        if len(own) >= quorum:
            free[own] = False
            out.append(sorted(ids[i] for i in own))
    return out


def category_clusters(batch: DataFrame, least: float = schema.CATEGORY_COSINE, quorum: int = schema.CATEGORY_QUORUM, key: str | None = None) -> DataFrame:
    """(cluster, id): clusters among the embedded rows of a batch (or of each ``key``): a greedy
    fold in one task, which holds the vectors and no matrix of their similarities."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = vectors._unit(pdf["embedding"])
        found = vector_clusters(list(pdf["id"]), x, least, quorum)
        return pd.DataFrame([(c[0], i) for c in found for i in c], columns=["cluster", "id"])

    kind = dict(batch.dtypes)["id"]
    b = batch.where(F.col("embedding").isNotNull()).select("id", "embedding", *([key] if key else []))
    return b.groupBy(*([key] if key else [])).applyInPandas(fold, f"cluster {kind}, id {kind}")


# --- conflicts ------------------------------------------------------------------------------------


def conflict_candidates(
    batch: DataFrame, current: DataFrame, linked: DataFrame, least: float = schema.CONFLICT_COSINE,
    neighbours: int = schema.CONFLICT_NEIGHBOURS, most: int | None = schema.CONFLICT_PAIRS,
) -> DataFrame:
    """(lo, hi, cosine): pairs worth a verdict, most similar first.

    ``batch`` (id); ``current`` (id, status, embedding, entity_ids).  A neighbour is eligible if it shares an entity and is not
    raw outside the batch; each batch memory takes its nearest eligible ones, known pairs included, and known pairs are then
    left out.
    """
    rows = current.join(batch.select("id"), "id", "left_semi")
    side = current.select("id", "status", "entity_ids").join(batch.select("id", F.lit(True).alias("in_batch")), "id", "left")
    p = vectors.similar_to(rows, current, least)
    p = p.join(side, "id").join(side.select(F.col("id").alias("q"), F.col("entity_ids").alias("qe")), "q")
    p = p.where(F.arrays_overlap("entity_ids", "qe") & ((F.col("status") != "raw") | F.col("in_batch").isNotNull()))
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    p = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= neighbours)
    p = p.groupBy(F.least("q", "id").alias("lo"), F.greatest("q", "id").alias("hi")).agg(F.max("cosine").alias("cosine"))
    p = p.join(linked, ["lo", "hi"], "left_anti").orderBy(F.desc("cosine"), "lo", "hi")
    return p.limit(most) if most else p


def order_by_time(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """(newer, older) of each pair (lo, hi, verdict); of equal times as the verdict A or B says, else none."""
    m = memories.select("id", F.coalesce("validfrom", "timestamp").alias("t"))
    p = pairs.join(m.select(F.col("id").alias("lo"), F.col("t").alias("ta")), "lo").join(m.select(F.col("id").alias("hi"), F.col("t").alias("tb")), "hi")
    first = (F.col("ta") > F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("verdict") == "A"))
    second = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("verdict") == "B"))
    return p.where(first | second).select(F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("newer"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("older"))


def supersede(memories: DataFrame, ordered: DataFrame) -> DataFrame:
    """(id, validto): the new end of validity of each older memory: the earliest of its own and its successors' starts."""
    m = memories.select(F.col("id").alias("newer"), F.coalesce("validfrom", "timestamp").alias("t"))
    ends = ordered.join(m, "newer").groupBy(F.col("older").alias("id")).agg(F.min("t").alias("t"))
    return memories.select("id", "validto").join(ends, "id").select("id", F.least("validto", "t").alias("validto"))


# --- entity resolution ----------------------------------------------------------------------------


def name_strings(entities: DataFrame, norm=text.normal_name) -> DataFrame:
    """(entity_id, string, own): normal forms of each entity's name and aliases."""
    e = entities.select("entity_id", F.col("name").alias("s"), F.lit(True).alias("own")).unionByName(
        entities.select("entity_id", F.explode("aliases").alias("s"), F.lit(False).alias("own"))
    )
    e = e.where("s is not null").withColumn("string", norm(F.col("s"))).where("string <> ''")
    return e.groupBy("entity_id", "string").agg(F.max("own").alias("own"))


def name_candidates(entities: DataFrame, norm=text.normal_name) -> DataFrame:
    """(lo, hi, is_match): entities that share a name or alias; a match has the same name, or each other's as alias, and
    types that agree.  An equi-join on the strings, not a comparison of all pairs."""
    s = name_strings(entities, norm)
    a, b = s.alias("a"), s.alias("b")
    p = a.join(b, (F.col("a.string") == F.col("b.string")) & (F.col("a.entity_id") < F.col("b.entity_id")))
    p = p.groupBy(F.col("a.entity_id").alias("lo"), F.col("b.entity_id").alias("hi")).agg(
        F.max(F.col("a.own") & F.col("b.own")).alias("same"), F.max(F.col("a.own")).alias("a_in_b"), F.max(F.col("b.own")).alias("b_in_a")
    )
    t = entities.select("entity_id", "type")
    p = p.join(t.select(F.col("entity_id").alias("lo"), F.col("type").alias("ta")), "lo").join(t.select(F.col("entity_id").alias("hi"), F.col("type").alias("tb")), "hi")
    agree = F.col("ta").isNull() | F.col("tb").isNull() | (F.col("ta") == F.col("tb"))
    return p.select("lo", "hi", ((F.col("same") | (F.col("a_in_b") & F.col("b_in_a"))) & agree).alias("is_match"))


def descriptor(entities: DataFrame) -> DataFrame:
    """(entity_id, text): what an entity's embedding encodes."""
    also = F.when(F.size("aliases") > 0, F.concat(F.lit(". Also called: "), F.array_join("aliases", ", "))).otherwise("")
    return entities.select("entity_id", F.concat("name", F.lit(" ("), F.coalesce("type", F.lit("unknown type")), F.lit(")"), also).alias("text"))


def embedding_tier(entities: DataFrame, forbidden: DataFrame, merge: float = schema.ENTITY_MERGE, candidate: float = schema.ENTITY_CANDIDATE) -> DataFrame:
    """(lo, hi, cosine, certain): entity pairs by descriptor embedding (entity_id, type, embedding), types agreeing, never
    co-mentioned (``forbidden``: lo, hi)."""
    e = entities.select(F.col("entity_id").alias("id"), "embedding")
    p = vectors.similar_to(e, e, candidate).where("q < id").select(F.col("q").alias("lo"), F.col("id").alias("hi"), "cosine")
    t = entities.select("entity_id", "type")
    p = p.join(t.select(F.col("entity_id").alias("lo"), F.col("type").alias("ta")), "lo").join(t.select(F.col("entity_id").alias("hi"), F.col("type").alias("tb")), "hi")
    p = p.where("ta is null or tb is null or ta = tb").join(forbidden, ["lo", "hi"], "left_anti")
    return p.select("lo", "hi", "cosine", (F.col("cosine") >= merge).alias("certain"))


def min_label_groups(pairs: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    """(id, root): smallest id reachable over the pairs, by repeated minimum over neighbours and pointer jumping."""
    e = cut(pairs.select(F.col(a).alias("s"), F.col(b).alias("d")).unionByName(pairs.select(F.col(b).alias("s"), F.col(a).alias("d"))).distinct())
    lab = cut(e.groupBy(F.col("s").alias("id")).agg(F.least(F.min("d"), F.first("s")).alias("root")))
    while True:
        near = e.join(lab.withColumnRenamed("id", "d"), "d").groupBy(F.col("s").alias("id")).agg(F.min("root").alias("r2"))
        step = lab.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "r2").alias("root"))
        up = step.select(F.col("id").alias("root"), F.col("root").alias("r3"))
        nxt = cut(step.join(up, "root", "left").select("id", "old", F.least("root", F.coalesce("r3", "root")).alias("root")))
        done = nxt.where("old <> root").isEmpty()
        lab = nxt.select("id", "root")
        if done:
            return lab


def consistent_links(links: DataFrame, different: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (lo, hi) whose component does not newly join a pair judged different.

    ``groups`` (lo, hi) are links already made.  A component that would join such a pair loses all its new links, so the
    outcome does not depend on their order; pairs that were together before do not block.
    """
    before, after = min_label_groups(groups), min_label_groups(groups.select("lo", "hi").unionByName(links.select("lo", "hi")))

    def together(lab: DataFrame) -> DataFrame:
        a, b = lab.select(F.col("id").alias("lo"), F.col("root").alias("ra")), lab.select(F.col("id").alias("hi"), F.col("root").alias("rb"))
        return different.select("lo", "hi").join(a, "lo").join(b, "hi").where("ra = rb").select("lo", "hi", F.col("ra").alias("root"))

    blocked = together(after).join(together(before).select("lo", "hi"), ["lo", "hi"], "left_anti").select("root").distinct()
    own = links.join(after.select(F.col("id").alias("lo"), "root"), "lo")
    return own.join(blocked, "root", "left_anti").select("lo", "hi")


def merge_targets(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(src_id, dst_id): members of each group (id, root) and its most mentioned member, of equal ones the first by name."""
    e = groups.join(entities.select(F.col("entity_id").alias("id"), "name", "mentions"), "id")
    best = e.groupBy("root").agg(F.min_by("id", F.struct(-F.col("mentions"), F.col("name"), F.col("id"))).alias("dst_id"))
    return e.join(best, "root").where("id <> dst_id").select(F.col("id").alias("src_id"), "dst_id")


def merge_entities(g: Graph, merges: DataFrame, run: str | None = None) -> dict[str, DataFrame]:
    """New entity, mentions, linked_to and merged_into tables after merging each ``src_id`` into its ``dst_id``.

    The target gains the source's name and aliases that it lacks, in order; edges move to the target, an edge that is there
    already stays as it is, and links to itself vanish.  Moved edges carry the run.
    """
    to = merges.select(F.col("src_id").alias("from"), "dst_id")
    src = to.join(g.entity.select(F.col("id").alias("from"), "name", "aliases"), "from")
    gain = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))
    gained = src.groupBy(F.col("dst_id").alias("id")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", gain.alias("g")))), lambda t: t["g"])).alias("gain")
    )
    e = g.entity.join(gained, "id", "left").join(to.select(F.col("from").alias("id"), F.lit(True).alias("gone")), "id", "left")
    own = F.coalesce("aliases", F.array().cast("array<string>"))
    more = F.array_distinct(F.filter("gain", lambda x: x.isNotNull() & ~F.array_contains(own, x) & (x != F.col("name"))))
    entity = e.withColumn("aliases", F.when(F.col("gain").isNotNull(), F.concat(own, more)).otherwise(F.col("aliases"))).withColumn(
        "active", F.when(F.col("gone").isNotNull(), F.lit(False)).otherwise(F.col("active"))
    ).select(*g.entity.columns)

    def moved(df: DataFrame, ends: list[str], keys: list[str]) -> DataFrame:
        out = df.withColumn("__moved", F.lit(0))
        for c in ends:
            out = out.join(to.select(F.col("from").alias(c), F.col("dst_id").alias("__to")), c, "left")
            out = out.withColumn("__moved", F.when(F.col("__to").isNotNull(), 1).otherwise(F.col("__moved")))
            out = out.withColumn(c, F.coalesce("__to", c)).drop("__to")
        w = Window.partitionBy(*keys).orderBy("__moved", *[c for c in df.columns if c not in keys])
        out = out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
        return out.withColumn("editorrun", F.when(F.col("__moved") == 1, F.lit(run)).otherwise(F.col("editorrun"))).select(*df.columns)

    links = moved(g.linked_to, ["src_id", "dst_id"], ["src_id", "dst_id"]).where("src_id <> dst_id")
    merged = g.merged_into.select("src_id", "dst_id", "editorrun").unionByName(merges.select("src_id", "dst_id", F.lit(run).alias("editorrun"))).dropDuplicates(["src_id", "dst_id"])
    return {"entity": entity, "mentions": moved(g.mentions, ["entity_id"], ["memory_id", "entity_id"]), "linked_to": links, "merged_into": merged}


# --- relations, links, confidence -----------------------------------------------------------------


def relation_candidates(g: Graph, batch: DataFrame, hub: int = schema.HUB, most: int | None = schema.RELATION_PAIRS) -> DataFrame:
    """(lo, hi): pairs of active memories that share a non-hub entity, one of them in the batch, the other not raw outside it,
    without a relation yet.  Hubs are dropped before pairing, so an entity adds at most ``hub``**2 / 2 pairs."""
    live = g.memory.where(gr.is_active()).select(F.col("id").alias("memory_id"), "status", "timestamp")
    live = live.join(batch.select(F.col("id").alias("memory_id"), F.lit(True).alias("in_batch")), "memory_id", "left")
    m = g.mentions.select("memory_id", "entity_id").distinct().join(live, "memory_id")
    size = m.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("in_batch").alias("any")).where((F.col("n") > 1) & (F.col("n") <= hub) & F.col("any"))
    m = m.join(size.select("entity_id"), "entity_id").where("in_batch is not null or status <> 'raw'")
    a, b = m.alias("a"), m.alias("b")
    p = a.join(b, (F.col("a.entity_id") == F.col("b.entity_id")) & (F.col("a.memory_id") < F.col("b.memory_id")))
    p = p.where("a.in_batch is not null or b.in_batch is not null").select(F.col("a.memory_id").alias("lo"), F.col("b.memory_id").alias("hi")).distinct()
    p = p.join(gr.unordered(g.relates_to), ["lo", "hi"], "left_anti").orderBy("lo", "hi")
    return p.limit(most) if most else p


def link_candidates(g: Graph, kind: str = "Person") -> DataFrame:
    """Co-mentioned pairs of one type without a link in either direction."""
    return gr.unlinked(gr.entity_co_mentions(g, kind), g.linked_to, "id_a", "id_b")


def directed_links(answered: DataFrame) -> DataFrame:
    """(src_id, dst_id, ...) of verdicts with a direction a_to_b, b_to_a or mutual (two edges); relation none has none."""
    ab, ba = F.struct(F.col("id_a").alias("s"), F.col("id_b").alias("d")), F.struct(F.col("id_b").alias("s"), F.col("id_a").alias("d"))
    d = F.when(F.col("direction") == "b_to_a", F.array(ba)).when(F.coalesce("direction", F.lit("mutual")) == "mutual", F.array(ab, ba)).otherwise(F.array(ab))
    return answered.where("relation <> 'none'").withColumn("e", F.explode(d)).select(F.col("e.s").alias("src_id"), F.col("e.d").alias("dst_id"), "relation")


def boosts(batch: DataFrame, boost: float = schema.BOOST) -> DataFrame:
    """(id, confidence): memories of the batch whose opening occurs in more than one of its sessions, raised once."""
    key = F.trim(F.lower(F.substring("content", 1, 80)))
    b = batch.where("sessionid is not null").withColumn("key", key)
    many = b.groupBy("key").agg(F.min("sessionid").alias("s0"), F.max("sessionid").alias("s1")).where("s0 <> s1").select("key")
    up = b.join(many, "key", "left_semi").where("not coalesce(sessionboosted, false)")
    return up.select("id", F.when(F.col("confidence").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + boost)).alias("confidence"))


def decays(memories: DataFrame, day, decay: float = schema.DECAY, floor: float = schema.FLOOR) -> DataFrame:
    """(id, confidence, confidencedecayedon): reviewed memories lose confidence once a day, down to the floor."""
    d = F.lit(day).cast("date")
    due = (F.col("status") == "reviewed") & (F.col("confidence") > floor) & ~F.isnan("confidence") & (F.col("confidencedecayedon").isNull() | (F.col("confidencedecayedon") < d))
    return memories.where(due).select("id", F.greatest(F.col("confidence") - decay, F.lit(floor)).alias("confidence"), d.alias("confidencedecayedon"))


def chunked(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Adds ``chunk``: numbers of at most ``size`` rows each in the given order.

    Ranks come from a range-partitioned sort and the partitions' counts, so no single task sees all rows.
    """
    s = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy("__p").orderBy(*order)
    n = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    base = n.withColumn("__base", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).fillna({"__base": 0})
    r = s.withColumn("__rn", F.row_number().over(w)).join(F.broadcast(base.select("__p", "__base")), "__p")
    return r.withColumn("chunk", F.floor((F.col("__base") + F.col("__rn") - 1) / size)).drop("__p", "__rn", "__base")


def verdicts_by_pair(replies: DataFrame) -> DataFrame:
    """(request, pair, verdict) of JSON replies (request, n, reply): a list, or an object with one list inside, of objects
    with a pair number; pairs of the request (1 to n) without an answer have a null verdict."""
    item = "array<struct<pair:int,verdict:string>>"
    bare = F.from_json(text.first_json(F.col("reply")), item)
    wrapped = F.from_json(text.first_json(F.col("reply")), f"map<string,{item}>")
    items = F.coalesce(F.when(text.first_json(F.col("reply")).startswith("["), bare), F.map_values(wrapped)[0])
    got = replies.select("request", F.explode(items).alias("i")).select("request", "i.pair", "i.verdict").dropDuplicates(["request", "pair"])
    want = replies.select("request", F.explode(F.sequence(F.lit(1), "n")).alias("pair"))
    return want.join(got, ["request", "pair"], "left")


