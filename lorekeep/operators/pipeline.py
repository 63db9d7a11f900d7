"""The consolidation run: ordered steps over one batch, journaled, committed once, undoable.

Every step takes the graph as the steps before left it and returns changed tables; the run compares the graph before and after,
writes the journal and commits tables, journal and run record together.  Step results are checkpointed, so a plan never spans
more than one step.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.functions import text, vectors
from lorekeep.operators import editor as ed
from lorekeep.operators import graph as gr
from lorekeep.operators import journal
from lorekeep.operators.graph import Graph
from lorekeep.runtime import cut
from lorekeep.sources.state import GraphState


@dataclass
class Providers:
    """Verdict providers by step; a step whose provider is missing does what the rules alone can do."""

    dedup: object | None = None
    conflicts: object | None = None
    entities: object | None = None
    embeddings: Callable[[Column], Column] | None = None  # of entity descriptors
    relations: object | None = None
    links: object | None = None


@dataclass
class Thresholds:
    exact: float = schema.EXACT
    semantic: float = schema.SEMANTIC
    conflict: float = schema.CONFLICT_COSINE
    category: float = schema.CATEGORY_COSINE
    assign: float = schema.CATEGORY_ASSIGN
    dims: int = 64


@dataclass
class Run:
    id: str
    at: datetime
    model: str | None = None
    effort: str | None = None
    batch: int = schema.BATCH
    steps: tuple[str, ...] = schema.STEPS
    mark_reviewed: bool | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)
    providers: Providers = field(default_factory=Providers)

    @property
    def marks(self) -> bool:
        """Only a run of all steps marks its batch as reviewed, unless told otherwise."""
        return set(self.steps) == set(schema.STEPS) if self.mark_reviewed is None else self.mark_reviewed

    def most(self, pairs: int) -> int:
        """A cap of ``pairs`` per ``schema.BATCH`` memories, for this run's batch: larger batches ask no less than small ones."""
        return pairs * max(1, -(-self.batch // schema.BATCH))


def _set(df: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` replaced where ``new`` (id, columns) has a row."""
    n = new.select("id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    j = df.join(n, "id", "left")
    return j.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _status(g: Graph, ids: DataFrame, status: str) -> DataFrame:
    return _set(g.memory, ids.select("id", F.lit(status).alias("status")), "status")


def _edges(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old edges and those new ones that are not there yet."""
    cols = [(F.col(c) if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c])).alias(c) for c in old.columns]
    return old.unionByName(new.select(*cols).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def dedup(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    t = run.thresholds
    rows = cut(gr.active_embeddings(g).where(vectors.usable(F.col("embedding"), t.dims)).select("id", "embedding", "timestamp"))
    b = rows.join(batch, "id", "left_semi")
    gone = cut(ed.fold_duplicates(ed.duplicate_pairs(b, rows, t.exact), rows))
    related = None
    if run.providers.dedup is not None:
        p = ed.duplicate_pairs(b, rows, t.semantic, t.exact)
        v = cut(ed.semantic_verdicts(p, run.providers.dedup, gone))
        dup = v.where("verdict = 'duplicate'").join(gone.select(F.col("dupe").alias("id_b")), "id_b", "left_anti")
        gone = gone.unionByName(cut(ed.fold_duplicates(dup.select("id_a", "id_b", "cosine"), rows)))
        related = v.where("verdict = 'related'").select(F.col("id_a").alias("src_id"), F.col("id_b").alias("dst_id"), F.lit("supports").alias("type"), F.lit(0.6).alias("weight"), F.lit(run.id).alias("editorrun"))
    edge = gone.select(F.col("dupe").alias("src_id"), F.col("survivor").alias("dst_id"), F.lit(run.id).alias("editorrun"))
    rel = edge.select("dst_id", F.col("src_id"), "editorrun").select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"), F.lit("editor:supersedes").alias("type"), F.lit(1.0).alias("weight"), "editorrun")
    if related is not None:
        rel = rel.unionByName(related)
    return {
        "memory": _status(g, gone.select(F.col("dupe").alias("id")), "archived"),
        "canonical": _edges(g.canonical, edge, ["src_id", "dst_id"]),
        "relates_to": _edges(g.relates_to, rel, ["src_id", "dst_id", "type"]),
    }


def classify(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    m = g.memory.join(batch, "id", "left_semi").where("normalizedkind is null")
    kinds = m.select("id", F.coalesce(text.kind_of(F.col("kind")), F.lit("fact")).alias("normalizedkind"))
    types = gr.not_merged(g).where("normalizedtype is null").select("id", text.type_of(F.col("type")).alias("normalizedtype")).where("normalizedtype is not null")
    return {"memory": _set(g.memory, kinds, "normalizedkind"), "entity": _set(g.entity, types, "normalizedtype")}


def categories(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    t = run.thresholds
    b = cut(g.memory.join(batch, "id", "left_semi").where(vectors.usable(F.col("embedding"), t.dims)).select("id", "embedding"))
    m = g.in_category.join(g.memory.where(vectors.usable(F.col("embedding"), t.dims)).select(F.col("id").alias("memory_id"), "embedding"), "memory_id")
    a = cut(ed.assign_categories(b, vectors.centroids(m, "category", "embedding"), t.assign))
    rest = b.join(a.select("id"), "id", "left_anti")
    c = cut(ed.category_clusters(rest, t.category))
    named = c.select("id", F.concat(F.lit("cluster of "), F.col("cluster")).alias("category"), F.lit(0.85).alias("score"))
    all_ = a.unionByName(named).select(F.col("id").alias("memory_id"), "category", "score", F.lit("editor").alias("assignedby"), F.lit(run.at).alias("timestamp"), F.lit(run.id).alias("editorrun"))
    new = named.select(F.col("category").alias("name"), F.lit("").alias("description"), F.lit(run.id).alias("editorrun")).distinct()
    return {"in_category": _edges(g.in_category, all_, ["memory_id", "category"]), "category": _edges(g.category, new, ["name"])}


def contradictions(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    g = replace(g, memory=g.memory.withColumn("validfrom", F.coalesce("validfrom", "timestamp")))
    if run.providers.conflicts is None:
        return {"memory": g.memory}
    cur = cut(gr.current_memories(g).where(vectors.usable(F.col("embedding"), run.thresholds.dims)).select("id", "status", "embedding", "entity_ids"))
    p = cut(run.providers.conflicts.ask(ed.conflict_candidates(batch, cur, gr.conflict_links(g), run.thresholds.conflict, most=run.most(schema.CONFLICT_PAIRS)).withColumnsRenamed({"lo": "id_a", "hi": "id_b"})))
    order = cut(ed.order_by_time(p.where("verdict in ('A', 'B')").select(F.col("id_a").alias("lo"), F.col("id_b").alias("hi"), "verdict"), g.memory))
    edge = order.select(F.col("newer").alias("src_id"), F.col("older").alias("dst_id"), F.lit("superseded").alias("reason"), F.lit(run.at).alias("createdat"), F.lit(run.id).alias("editorrun"))
    con = p.where("verdict = 'contradicts'").select(F.col("id_a").alias("src_id"), F.col("id_b").alias("dst_id"), F.lit("contradicts").alias("type"), F.lit(0.5).alias("weight"), F.lit(run.id).alias("editorrun"))
    return {
        "memory": _set(g.memory, ed.supersede(g.memory, order), "validto"), "supersedes": _edges(g.supersedes, edge, ["src_id", "dst_id"]),
        "relates_to": _edges(g.relates_to, con, ["src_id", "dst_id", "type"]),
    }


def _described(g: Graph, e: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, embedding, embeddingtext) of the entities whose descriptor is not the one that their embedding encodes."""
    d = ed.descriptor(e).where("text is not null").withColumnRenamed("entity_id", "id").join(g.entity.select("id", "embedding", "embeddingtext"), "id")
    stale = d.where(F.col("embedding").isNull() | ~F.col("embeddingtext").eqNullSafe(F.col("text")))
    return cut(stale.select("id", embed(F.col("text")).cast("array<float>").alias("embedding"), F.col("text").alias("embeddingtext")))


def entity_resolution(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    """Merges by name, by embedding, and by verdict on what these leave open.

    Pairs that the provider has been asked least often come first, then the most similar, so a pair that stays unsure does not
    keep others from their turn.
    """
    e = cut(gr.resolution_entities(g))
    names = cut(ed.name_candidates(e))
    co = cut(gr.co_mentioned_pairs(g.mentions))
    sure = names.where("is_match").select("lo", "hi")
    open_ = names.where("not is_match").join(co, ["lo", "hi"], "left_anti").select("lo", "hi", F.lit(1.0).alias("cosine"))
    if run.providers.embeddings is not None:
        g = replace(g, entity=cut(_set(g.entity, _described(g, e, run.providers.embeddings), "embedding", "embeddingtext")))
        v = e.select("entity_id", "type").join(g.entity.select(F.col("id").alias("entity_id"), "embedding"), "entity_id")
        v = cut(v.where(vectors.usable(F.col("embedding"), run.thresholds.dims)))
        tier = cut(ed.embedding_tier(v, co))
        sure = sure.unionByName(tier.where("certain").select("lo", "hi"))
        side = lambda end: v.select(F.col("entity_id").alias(end), F.col("embedding").alias(f"v_{end}"))
        near = F.coalesce(vectors.cosine(F.col("v_lo"), F.col("v_hi")), F.lit(0.0))
        open_ = open_.join(side("lo"), "lo", "left").join(side("hi"), "hi", "left").select("lo", "hi", near.alias("cosine"))
        open_ = open_.unionByName(tier.where("not certain").select("lo", "hi", "cosine")).groupBy("lo", "hi").agg(F.max("cosine").alias("cosine"))
    sure = cut(sure.distinct())
    changed = {"distinct_from": g.distinct_from}
    if run.providers.entities is not None:
        asked = g.asked if g.asked is not None else e.sparkSession.createDataFrame([], schema.TABLES["asked"])
        group = cut(ed.min_label_groups(sure))
        of = lambda end: group.select(F.col("id").alias(end), F.col("root").alias(f"r_{end}"))
        times = asked.groupBy(F.least("src_id", "dst_id").alias("lo"), F.greatest("src_id", "dst_id").alias("hi")).agg(F.count(F.lit(1)).alias("times"))
        ask = open_.join(gr.unordered(g.distinct_from), ["lo", "hi"], "left_anti").join(of("lo"), "lo", "left").join(of("hi"), "hi", "left")
        ask = ask.where("r_lo is null or r_hi is null or r_lo <> r_hi").join(times, ["lo", "hi"], "left")
        ask = ask.orderBy(F.coalesce("times", F.lit(0)), F.desc("cosine"), "lo", "hi").limit(run.most(schema.ENTITY_PAIRS))
        v = cut(run.providers.entities.ask(ask.select(F.col("lo").alias("id_a"), F.col("hi").alias("id_b"))))
        ends = [F.col("id_a").alias("src_id"), F.col("id_b").alias("dst_id")]
        stamp = [F.lit(run.at).alias("createdat"), F.lit(run.id).alias("editorrun")]
        changed["asked"] = _edges(asked, v.select(*ends, *stamp), schema.KEYS["asked"])
        apart = v.where("verdict = 'different'").select(*ends, F.lit("judged").alias("reason"), *stamp)
        changed["distinct_from"] = distinct = _edges(g.distinct_from, apart, ["src_id", "dst_id"])
        links = v.where("verdict = 'same'").select(F.col("id_a").alias("lo"), F.col("id_b").alias("hi"))
        sure = sure.unionByName(ed.consistent_links(links, co.unionByName(gr.unordered(distinct)), sure))
    targets = cut(ed.merge_targets(ed.min_label_groups(sure), e))
    return ed.merge_entities(g, targets, run.id) | changed


def relationships(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    if run.providers.relations is None:
        return {}
    p = ed.relation_candidates(g, batch, most=run.most(schema.RELATION_PAIRS)).select(F.col("lo").alias("id_a"), F.col("hi").alias("id_b"))
    v = run.providers.relations.ask(p).where("verdict in ('caused_by', 'follows', 'supports', 'elaborates', 'contradicts')")
    e = v.select(F.col("id_a").alias("src_id"), F.col("id_b").alias("dst_id"), F.col("verdict").alias("type"), F.lit(0.5).alias("weight"), F.lit(run.id).alias("editorrun"))
    return {"relates_to": _edges(g.relates_to, e, ["src_id", "dst_id", "type"])}


def entity_links(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    if run.providers.links is None:
        return {}
    v = run.providers.links.ask(ed.link_candidates(g).select("id_a", "id_b"))
    d = ed.directed_links(v.select("id_a", "id_b", F.when(F.col("verdict").isin("a_to_b", "b_to_a", "mutual"), "knows").otherwise("none").alias("relation"), F.col("verdict").alias("direction")))
    e = d.select("src_id", "dst_id", "relation", F.lit("").alias("detail"), F.lit("neutral").alias("sentiment"), F.lit(0.5).alias("strength"), F.lit(True).alias("active"), F.lit(run.id).alias("editorrun"))
    return {"linked_to": _edges(g.linked_to, e, ["src_id", "dst_id"])}


def confidence(g: Graph, batch: DataFrame, run: Run) -> dict[str, DataFrame]:
    up = ed.boosts(g.memory.join(batch, "id", "left_semi")).withColumn("sessionboosted", F.lit(True))
    m = cut(_set(g.memory, up, "confidence", "sessionboosted"))
    return {"memory": _set(m, ed.decays(m, run.at.date()), "confidence", "confidencedecayedon")}


_STEPS = {f.__name__: f for f in (dedup, classify, categories, contradictions, entity_resolution, relationships, entity_links, confidence)}


def run_once(state: GraphState, run: Run) -> dict:
    """One run over the oldest raw memories; returns counts per changed table.  Nothing raw means nothing is done."""
    spark = state.spark
    before = state.graph()
    batch = cut(before.memory.where("status = 'raw'").orderBy("timestamp", "content", "id").limit(run.batch).select("id"))
    if batch.isEmpty():
        return {"batch": 0}
    g, old = before, before.tables()
    touched: set[str] = set()
    for name in schema.STEPS:
        if name not in run.steps:
            continue
        own = gr.surviving(g, batch)
        changed = {k: cut(v) for k, v in _STEPS[name](g, own, run).items()}
        touched |= set(changed)
        g = replace(g, **changed)
    if run.marks:
        still = g.memory.where("status = 'raw'").join(batch, "id", "left_semi").select("id")
        g = replace(g, memory=cut(_status(g, still, "reviewed")))
        touched.add("memory")
    new = g.tables()
    log = None
    for k in sorted(touched & {"memory", "entity"}):
        part = journal.changes_between(run.id, 1, k, old[k], new[k])
        log = part if log is None else log.unionByName(part)
    for k in sorted(touched & {"mentions", "linked_to"}):
        part = journal.removed_edges(run.id, 2, k, old[k], new[k])
        log = part if log is None else log.unionByName(part)
    counts = {"batch": batch.count()} | {k: new[k].count() - old[k].count() for k in sorted(touched)}
    action = None
    if log is not None:
        log = cut(log)
        counts["changes"] = log.count()
        action = log.select(
            F.concat_ws("/", "run_id", "seq", "table", "id", F.coalesce("prop", F.lit("-"))).alias("id"), F.col("op").alias("type"), F.array("id").alias("targets"),
            F.lit("").alias("reason"), F.lit(run.at).alias("timestamp"), F.col("run_id").alias("runid"), "seq",
            F.to_json(F.struct("op", "table", "id", "prop", "prev")).alias("undo"), F.lit(False).alias("rolledback"),
        )
    record = spark.createDataFrame([(run.id, run.at, "completed", run.model, run.effort, run.batch, run.at, json.dumps(counts), None)], schema.TABLES["editor_run"])
    commit = {k: new[k] for k in touched} | {"editor_run": state.read("editor_run").unionByName(record)}
    if action is not None:
        commit["edit_action"] = state.read("edit_action").unionByName(action)
    state.commit(commit)
    return counts


def raw_count(state: GraphState) -> int:
    return state.read("memory").where("status = 'raw'").count()


def run_all(state: GraphState, make_run, most: int | None = None) -> list[dict]:
    """Runs until nothing raw is left; ``make_run(i)`` gives the i-th run.

    A run that leaves as many raw memories as before is the last one: the next would take the same batch again.
    """
    out, raw = [], raw_count(state)
    while most is None or len(out) < most:
        out.append(run_once(state, make_run(len(out))))
        before, raw = raw, raw_count(state)
        if not out[-1]["batch"] or raw == before:
            break
    return out


def roll_back(state: GraphState, run_id: str, at: datetime, force: bool = False) -> None:
    """Undo a run: changed properties, removed edges and what it created; refuses as ``journal.refuse`` says."""
    runs = state.read("editor_run")
    why = journal.refuse(runs, run_id, force)
    if why:
        raise ValueError(f"{run_id}: {why}")
    actions = state.read("edit_action")
    mine = actions.where(F.col("runid") == run_id)
    log = cut(mine.select(F.from_json("undo", "op string, table string, id string, prop string, prev string").alias("u"), F.col("runid").alias("run_id"), "seq").select("run_id", "seq", "u.*"))
    tables = {k: cut(v) for k, v in journal.rolled_back(state.graph().tables(), log, run_id).items()}
    this = F.col("id") == run_id
    runs = runs.withColumn("status", F.when(this, "rolled_back").otherwise(F.col("status"))).withColumn("rolledbackat", F.when(this, F.lit(at)).otherwise(F.col("rolledbackat")))
    actions = actions.withColumn("rolledback", F.when(F.col("runid") == run_id, True).otherwise(F.col("rolledback")))
    state.commit(tables | {"editor_run": runs, "edit_action": actions})


def due(raw: int, hour: int, ran_today: bool, threshold: int = 40, nightly: int = 2) -> bool:
    """Whether the scheduler starts a run: enough raw memories, or the nightly hour has come."""
    return raw >= threshold or (hour >= nightly and not ran_today and raw > 0)
