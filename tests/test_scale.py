"""What the findings of round 2 name: work that follows the result, not the hubs, and no stage without effect."""

import numpy as np

from lorekeep.functions import vectors
from lorekeep.llm import catalogue, survivor
from lorekeep.operators import editor
from lorekeep.operators import retrieval as rt
from lorekeep.operators.graph import Graph
from lorekeep.runtime import table


def join_rows(df) -> int:
    """Most rows that any join of the plan gives."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName() and (m := p.metrics().get("numOutputRows")).isDefined():
            most = max(most, m.get().value())
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan"}.get(p.nodeName())
        kids = p.children()
        todo += [getattr(p, inner)()] if inner else [kids.apply(i) for i in range(kids.size())]
    return most


def linked_graph(spark, links: int) -> Graph:
    """A hub with so many links; ``same`` and ``twin`` share a name, ``off`` is not active, ``anon`` has no name."""
    names = [("hub", "Hub", True), ("same", "Ann", None), ("twin", "Ann", True), ("ben", "Ben", True), ("cem", "Cem", True), ("dan", "Dan", True), ("eve", "Eve", True), ("off", "Ben", False), ("anon", None, True)]
    names += [(f"x{i}", f"X{i}", True) for i in range(links)]
    ends = [("hub", x) for x in ["twin", "ben", "cem", "dan", "eve", "off", *(f"x{i}" for i in range(links))]] + [("ben", "twin"), ("anon", "ben"), ("off", "ben")]
    seen = [("m1", e) for e in ("hub", "same", "off")] + [("m2", e) for e in ("hub", "ben", "anon")] + [("m3", e) for e in ("cem", "dan", "eve")]
    frame = spark.createDataFrame
    none = dict.fromkeys("memory session relates_to canonical supersedes merged_into distinct_from in_category category".split())
    return Graph(
        entity=frame(names, "id string, name string, active boolean"), mentions=frame([*seen, *seen], "memory_id string, entity_id string"),
        linked_to=frame([(a, b, "knows") for a, b in [*ends, *ends]], "src_id string, dst_id string, relation string"), **none,
    )


def test_decorate_follows_the_results(spark):
    """Links of a hub to what no result of the query mentions are not made; names, not ids, decide what is mentioned."""
    g = linked_graph(spark, 1000)
    ranked = spark.createDataFrame([(f"q{i}", f"m{j}") for i in range(60) for j in (1, 2)] + [("r", f"m{j}") for j in (1, 2, 3, 4)], "q string, id string")
    out = rt.decorate(g, ranked)
    got = {(r.q, r.id): (r.entities, r.relations) for r in out.collect()}
    hub = ["Hub is knows of Ann", "Hub is knows of Ben"]
    assert len(got) == 124
    assert all(got[f"q{i}", "m1"] == (["Ann", "Hub"], hub) and got[f"q{i}", "m2"] == (["Ben", "Hub"], ["Ben is knows of Ann", *hub]) for i in range(60))
    assert got["r", "m1"] == (["Ann", "Hub"], [*hub, "Hub is knows of Cem"]) and got["r", "m3"] == (["Cem", "Dan", "Eve"], []) and got["r", "m4"] == ([], [])
    assert join_rows(out) < 10_000  # 120 results x 1,000 links of the hub before


def test_context_text_ranks_once(spark):
    g = linked_graph(spark, 3)
    g.memory = spark.createDataFrame([(f"m{i}", f"text {i}", "fact", None, None) for i in (1, 2, 3)], "id string, content string, kind string, normalizedkind string, validto timestamp")
    ranked, made = spark.createDataFrame([("q", "m1", 0.9, 1), ("q", "m2", 0.5, 2), ("q", "m3", 0.05, 3), ("p", "m3", 0.05, 1)], "q string, id string, score double, rank int"), spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    out = rt.context_text(g, ranked.mapInPandas(count, ranked.schema), "2026-01-01").collect()
    lines = "1. [fact] (Ann, Hub) text 1 (90%)\n2. [fact] (Ben, Hub) text 2 (50%)"
    rels = "\n- ".join(["Ben is knows of Ann", "Hub is knows of Ann", "Hub is knows of Ben", "Hub is knows of Cem"])
    assert [(r.q, r.context) for r in out] == [("q", f"<graph-memories>\nRelevant memories from your knowledge graph:\n{lines}\n\nEntity relationships:\n- {rels}\n</graph-memories>")]
    assert made.value == 4  # once, though it is used four times


def test_pairs_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """As many parts as there are queries: the same pairs, the only files are those of the two sides."""
    x = np.random.default_rng(7).standard_normal((40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:02}", [float(c) for c in v]) for i, v in enumerate(x)], "id string, embedding array<float>")
    g = np.float32(x).astype(float)
    g = g @ g.T
    old = lambda i: i % 3 == 0
    want = {(f"v{i:02}", f"v{j:02}") for i in range(40) for j in range(40) if old(i) and i != j and 0.2 <= g[i, j] < 0.9 and not (old(j) and i < j)}
    cuts, real = [], vectors.similar_to
    monkeypatch.setattr(vectors, "cut", lambda d: cuts.append(d.columns) or d)
    monkeypatch.setattr(vectors, "similar_to", lambda *a, **k: real(*a, **k, values=9))
    p = editor.duplicate_pairs(df.where("cast(substring(id, 2) as int) % 3 = 0"), df, 0.2, 0.9)
    got = [(r.id_a, r.id_b) for r in p.collect()]
    assert set(got) == want and len(got) == len(want)
    assert len(cuts) == 2 and not any("cosine" in c for c in cuts)
    assert "Join" not in p._jdf.queryExecution().analyzed().toString().partition("MapInArrow")[0]


def test_model_runs_where_it_decides(spark, monkeypatch):
    """p1_found is the stated rank, without a model that could not change it; p1_alias_truth changes with the model."""
    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(tuple, df.collect()))
    m, e = survivor.memory_survivors(table(spark, d, "memories")), survivor.entity_survivors(table(spark, d, "entities"), rounds=3)
    want = rows(m.best.unionByName(e.best).select("group_key", "field", "id").distinct())
    kept, judge = rows(catalogue.p1_alias_truth(spark, d)), survivor.judge
    monkeypatch.setattr(survivor, "judge", lambda *a: [df.withColumn("p", df.p * 0) if "p" in df.columns else df for df in judge(*a)])
    assert kept and not rows(catalogue.p1_alias_truth(spark, d))
    monkeypatch.setattr(survivor, "judge", None)
    assert want and rows(catalogue.p1_found(spark, d)) == want
