"""The versioned pointer and appendable tables of the graph on disk."""

import threading

import pytest

from lorekeep import schema
from lorekeep.sources import state as state_module
from lorekeep.sources.state import GraphState
from lorekeep.sources.versions import Conflict, Versions


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "p"))
    assert v.read() == (0, {})
    assert v.write(0, {"a": 1}) == 1 and v.write(1, {"a": 2}) == 2 and v.read() == (2, {"a": 2})
    with pytest.raises(Conflict):
        v.write(1, {"a": 3})
    assert v.read() == (2, {"a": 2})
    # a reader in a loop never sees nothing
    seen, stop = [], threading.Event()

    def loop():
        r = Versions(spark, str(tmp_path / "p"))
        while not stop.is_set():
            seen.append(r.read())

    t = threading.Thread(target=loop)
    t.start()
    for n in range(2, 12):
        v.write(n, {"a": n})
    stop.set()
    t.join()
    numbers = [n for n, _ in seen]
    assert numbers == sorted(numbers) and min(numbers) >= 2 and all(d for _, d in seen)
    assert len(v.listed()) == Versions.KEPT


def test_append(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_module, "PARTS", 2)
    s = GraphState(spark, str(tmp_path / "g"))
    row = lambda i: spark.createDataFrame([(i, "n", None)], schema.TABLES["category"])
    for i in range(4):
        s.commit({}, append={"category": row(f"c{i}")})
    assert sorted(r[0] for r in s.read("category").collect()) == ["c0", "c1", "c2", "c3"]
    assert len(s._pointer()["tables"]["category"]) <= 2
    s.commit({"category": row("only")})
    assert [r[0] for r in s.read("category").collect()] == ["only"] and s.read("memory").isEmpty()
