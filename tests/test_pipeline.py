"""Runs over a small graph: journal, fixpoint, rollback, capture stream."""

import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep import __main__ as cli
from lorekeep import schema
from lorekeep.operators import graph as gr
from lorekeep.operators import pipeline as pl
from lorekeep.providers import HashVerdicts
from lorekeep.sources.state import GraphState
from lorekeep.streaming import capture

AT = datetime(2026, 5, 1, 12)


def table(spark, name, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.TABLES[name].fields) for r in rows], schema.TABLES[name])


def seeded(spark, path):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 64))
    mem, men = [], []
    for i in range(18):
        v = base[i % 6] + (0.02 if i < 12 else 0.9) * rng.standard_normal(64)
        mem.append({
            "id": f"m{i:02}", "sessionid": f"s{i % 3}", "content": f"the project number {i % 6} is going on well", "kind": ["plan", "mood", "odd", "Fact"][i % 4],
            "timestamp": datetime(2026, 1, 1 + i), "confidence": 0.5, "salience": 0.6, "status": "raw" if i % 3 else "reviewed", "embedding": [float(x) for x in v],
        })
        men += [{"memory_id": f"m{i:02}", "entity_id": f"e{j}", "role": "subject"} for j in {i % 4, (i + 1) % 5}]
    ent = [{"id": f"e{j}", "name": n, "type": t, "aliases": a} for j, (n, t, a) in enumerate([("Ada Moss", "Person", ["A. Moss"]), ("moss, ada", "Person", []), ("Rivet", "Project", []), ("Bo Lind", "Person", []), ("Rivet", "Tool", [])])]
    s = GraphState(spark, str(path))
    s.init_schema()
    s.init_schema()
    s.mark_scratch()
    s.commit({"memory": table(spark, "memory", mem), "mentions": table(spark, "mentions", men), "entity": table(spark, "entity", ent)})
    return s


PROVIDERS = dict(
    dedup=HashVerdicts(["duplicate", "related", "distinct"]), conflicts=HashVerdicts(["A", "B", "contradicts", "none"]), entities=HashVerdicts(["same", "different", "unsure"]),
    relations=HashVerdicts(["supports", "follows", "none"]), links=HashVerdicts(["a_to_b", "b_to_a", "mutual", "none"]),
)


def run(i=0, **more):
    return pl.Run(f"r{i}", AT.replace(minute=i), batch=8, thresholds=pl.Thresholds(conflict=0.2, semantic=0.7), providers=pl.Providers(**PROVIDERS), **more)


def prints(state):
    t = {k: v.drop("embedding") for k, v in state.graph().tables().items()}
    return {(r.table, r.row): r.n for r in gr.fingerprint(t).collect()}


def test_run_fixpoint_and_rollback(spark, tmp_path):
    s = seeded(spark, tmp_path / "g")
    start = prints(s)
    first = pl.run_once(s, run(0))
    assert first["batch"] == 8 and first["changes"] > 0
    assert s.read("canonical").count() > 0
    assert s.read("entity").where("not active").count() == 1  # Ada Moss, in either spelling
    mid = prints(s)
    pl.run_once(s, run(1, steps=("classify", "confidence")))
    with pytest.raises(ValueError, match="later"):
        pl.roll_back(s, "r0", AT)
    pl.roll_back(s, "r1", AT)
    assert prints(s) == mid
    with pytest.raises(ValueError, match="already"):
        pl.roll_back(s, "r1", AT)
    with pytest.raises(ValueError, match="unknown"):
        pl.roll_back(s, "zz", AT)
    pl.roll_back(s, "r0", AT)
    assert prints(s) == start
    big = lambda i: pl.Run(f"b{i}", AT.replace(hour=13, minute=i), thresholds=pl.Thresholds(conflict=0.2, semantic=0.7), providers=pl.Providers(**PROVIDERS))
    done = pl.run_all(s, big)
    assert done[-1] == {"batch": 0} and len(done) == 2
    for name in ("canonical", "relates_to", "mentions", "linked_to"):
        assert schema.duplicate_keys(s.read(name), *schema.KEYS[name]).isEmpty()
    assert s.read("memory").where("status = 'raw'").isEmpty()


def test_single_step_leaves_raw(spark, tmp_path):
    s = seeded(spark, tmp_path / "g")
    n = s.read("memory").where("status = 'raw'").count()
    pl.run_once(s, run(0, steps=("classify",)))
    assert s.read("memory").where("status = 'raw'").count() == n
    assert s.read("memory").where("normalizedkind is not null").count() == 8


def test_guards(spark, tmp_path):
    s = seeded(spark, tmp_path / "g")
    s.wipe()
    assert s.read("memory").isEmpty()
    t = GraphState(spark, str(tmp_path / "h"))
    t.commit({"category": spark.createDataFrame([("a", "b", None)], schema.TABLES["category"])})
    with pytest.raises(RuntimeError):
        t.wipe()
    with pytest.raises(SystemExit):
        cli.main([str(tmp_path / "h"), "--all", "--step", "dedup"], spark)
    assert pl.due(40, 0, True) and pl.due(1, 3, False) and not pl.due(1, 3, True) and not pl.due(0, 3, False)


def test_cli(spark, tmp_path, capsys):
    s = seeded(spark, tmp_path / "g")
    assert cli.main([s.path, "--stats"], spark) == 0 and "memories" in capsys.readouterr().out
    assert cli.main([s.path, "--search", "m01", "--limit", "3"], spark) == 0 and "project number" in capsys.readouterr().out
    assert cli.main([s.path, "--step", "classify"], spark) == 0
    assert cli.main([s.path, "--runs"], spark) == 0 and "completed" in capsys.readouterr().out
    assert cli.main([s.path, "--rollback", "none"], spark) == 1


def test_capture_is_idempotent(spark, tmp_path):
    s = GraphState(spark, str(tmp_path / "g"))
    s.init_schema()
    v = [1.0] + [0.0] * 63
    w = [0.0, 1.0] + [0.0] * 62
    rows = [("s1", 1, "Iris moved to the Lisbon office.", "fact", 0.9, 0.9, AT, v), ("s1", 2, "iris moved to  the Lisbon office!", "fact", 0.9, 0.9, AT, v),
            ("s1", 3, "The office of Iris is in Lisbon now", "fact", 0.9, 0.9, AT, v), ("s2", 1, "The office of Iris is in Lisbon now", "fact", 1.9, 0.9, AT, w), ("s2", 2, "ok", "fact", 0.9, 0.9, AT, w)]
    facts = spark.createDataFrame(rows, "sessionid string, pos int, content string, kind string, confidence double, salience double, observed timestamp, embedding array<double>")
    facts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    q = capture.capture_stream(stream, s, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert {(r.sessionid, r.status, r.confidence) for r in s.read("memory").collect()} == {("s1", "raw", 0.9), ("s2", "raw", 1.0)}
    assert "written" not in capture.capture_batch(s, facts)
    assert s.read("memory").count() == 2


def test_windows_and_gate(spark, tmp_path):
    e = spark.createDataFrame([(datetime(2026, 1, 1, 0, m), "u", "click", 1.0) for m in (1, 5, 50)] + [(datetime(2026, 1, 1, 5), "u", "click", 2.0)], "ts timestamp, user_id string, event_type string, value double")
    assert {(r.start.hour, r.n) for r in capture.windowed_counts(e).collect()} == {(0, 3), (5, 1)}
    assert sorted(r.n for r in capture.sessions(e).collect()) == [1, 1, 2]
    f = spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "b", [1.0, 0.01]), ("s", "c", [0.0, 1.0]), ("t", "a", [1.0, 0.0])], "sessionid string, fact_id string, embedding array<double>")
    f.coalesce(1).write.parquet(str(tmp_path / "f"))
    got = []
    q = capture.similarity_gate(spark.readStream.schema(f.schema).parquet(str(tmp_path / "f"))).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c2")).start()
    until = time.time() + 90  # the timeout keeps the query awake, so it never counts as idle
    while len(got) < 4 and q.isActive and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert {(r.sessionid, r.fact_id): r.novel for r in got} == {("s", "a"): True, ("s", "b"): False, ("s", "c"): True, ("t", "a"): True}


def test_demo_graph(spark):
    d = gr.demo_graph(spark)
    assert d["memory"].count() == 4 and d["entity"].where("name = 'Iris'").count() == 1
    assert d["memory"].select(F.min("status")).first()[0] == "reviewed"
