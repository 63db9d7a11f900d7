"""Whole jobs: no bound on runs, rows or vectors cuts a result."""

from dataclasses import replace
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from lorekeep import __main__ as cli
from lorekeep import schema
from lorekeep.functions import vectors
from lorekeep.operators import editor as ed
from lorekeep.operators import pipeline as pl
from lorekeep.operators.graph import Graph
from lorekeep.plans import consolidate
from lorekeep.providers import HashVerdicts
from lorekeep.runtime import cut

AT = datetime(2026, 5, 1, 12)


def test_run_all_has_no_bound(monkeypatch):
    left = [25]

    def one(state, run):
        n = min(1, left[0])
        left[0] -= n
        return {"batch": n}

    monkeypatch.setattr(pl, "run_once", one)
    monkeypatch.setattr(pl, "raw_count", lambda state: left[0], raising=False)
    done = pl.run_all(None, lambda i: i)
    assert left == [0] and len(done) == 26 and done[-1] == {"batch": 0}
    monkeypatch.setattr(pl, "run_once", lambda state, run: {"batch": 3})
    left[0] = 3
    assert pl.run_all(None, lambda i: i) == [{"batch": 3}]  # no progress: stops
    assert cli.parser().parse_args(["x", "--all", "--batch", "9"]).batch == 9
    run = pl.Run("r", AT, batch=schema.BATCH_ALL)
    assert run.most(200) == 200 * schema.BATCH_ALL // schema.BATCH and pl.Run("r", AT, batch=8).most(200) == 200


def test_similar_to_takes_any_number_of_queries(spark):
    x = np.random.default_rng(5).standard_normal((60, 8))
    df = spark.createDataFrame([(f"v{i:02}", [float(c) for c in v]) for i, v in enumerate(x)], "id string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T
    want = {(f"v{i:02}", f"v{j:02}") for i in range(60) for j in range(60) if i != j and 0.3 <= g[i, j] < 0.9}
    whole = {(r.q, r.id) for r in vectors.similar_to(df, df, 0.3, below=0.9).collect()}
    parts = vectors.similar_to(df, df, 0.3, below=0.9, values=100).collect()
    assert want and whole == want and {(r.q, r.id) for r in parts} == want and len(parts) == len(want)


def test_embedding_tier_refuses_no_size(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_VALUES", 5)
    e = spark.createDataFrame([("a", "T", [1.0, 0.0]), ("b", "T", [1.0, 0.01]), ("c", "T", [0.0, 1.0])], "entity_id string, type string, embedding array<double>")
    none = spark.createDataFrame([], "lo string, hi string")
    assert [(r.lo, r.hi, r.certain) for r in ed.embedding_tier(e, none).collect()] == [("a", "b", True)]


def test_whole_table_queries_take_all_raw(spark):
    d = "/root/testdata/sf0.01"
    assert consolidate._batch(spark, d).count() == schema.BATCH
    raw = {r.id for r in consolidate._batch(spark, d, None).select("id").collect()}
    assert len(raw) > schema.BATCH
    q = consolidate.QUERIES
    few = {(r.lo, r.hi) for r in q["relationship_candidates"](spark, d).collect()}
    many = {(r.lo, r.hi) for r in q["relationship_candidates_all"](spark, d).collect()}
    assert few < many
    assert len({i for p in many for i in p} & raw) > schema.BATCH


def test_folds_by_component_and_without_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"m{i:02}" for i in range(90)]
    for least in (0.3, 0.6):
        assert ed.vector_clusters(ids, x, least, 3) == ed.find_clusters(ids, x @ x.T, least, 3)
    pairs = [(ids[i], ids[j], float(x[i] @ x[j])) for i in range(90) for j in range(i) if x[i] @ x[j] > 0.9]
    p = spark.createDataFrame(pairs, "id_a string, id_b string, cosine double")
    t = spark.createDataFrame([(i, datetime(2026, 1, 1 + int(rng.integers(9)))) for i in ids], "id string, timestamp timestamp")
    one, by = ({tuple(r) for r in ed.fold_duplicates(p, t, b).collect()} for b in (False, True))
    assert one and one == by


def test_entity_step_uses_embeddings_and_takes_turns(spark, monkeypatch):
    monkeypatch.setattr(schema, "ENTITY_PAIRS", 1)
    rows = lambda name, data: spark.createDataFrame([tuple(r.get(f.name) for f in schema.TABLES[name].fields) for r in data], schema.TABLES[name])
    ent = rows("entity", [{"id": i, "name": n, "type": "Tool", "aliases": []} for i, n in zip("abcde", ["Alpha", "Beta", "Gamma", "Delta", "Eps"], strict=True)])
    g = Graph(**{n: rows(n, []) for n in Graph.__dataclass_fields__} | {"entity": ent})
    cos = lambda c: F.array(F.lit(c), F.lit((1 - c * c) ** 0.5), F.lit(0.0))
    flat, other = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))

    def embed(t):  # Alpha and Beta equal, Gamma 0.9 and Delta 0.82 from them; Eps far
        return F.when(t.startswith("Alpha") | t.startswith("Beta"), flat).when(t.startswith("Gamma"), cos(0.9)).when(t.startswith("Delta"), F.array(F.lit(0.82), F.lit(-0.5724), F.lit(0.0))).otherwise(other)

    run = lambda i: pl.Run(f"r{i}", AT, thresholds=pl.Thresholds(dims=3), providers=pl.Providers(entities=HashVerdicts(["unsure"]), embeddings=embed))
    batch, seen = spark.createDataFrame([], "id string"), []
    for i in range(2):
        new = {k: cut(v) for k, v in pl.entity_resolution(g, batch, run(i)).items()}
        g = replace(g, **new)
        seen.append([(r.src_id, r.dst_id) for r in g.asked.where(F.col("editorrun") == f"r{i}").collect()])
    assert {(r.src_id, r.dst_id) for r in g.merged_into.collect()} == {("b", "a")}
    assert seen[0] == [("a", "c")] and seen[1][0] != seen[0][0] and len(seen[1]) == 1
    assert g.entity.where("embeddingtext is not null").count() == 5
