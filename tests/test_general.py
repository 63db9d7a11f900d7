"""Attribute history and skewed keys against brute force, with nulls, ties, repeats, hot keys and clashing columns."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.operators import history, skew

BASE = datetime(2026, 1, 1)
SCHEMA = "update_id long, entity_id string, attribute string, content string, validfrom timestamp, validto timestamp, timestamp timestamp, status string, pid int, ver string, ent string"


def norm(x):
    return " ".join(x.lower().split()).rstrip(".! ").strip()


def brute(rows):
    best = {}
    for r in rows:
        uid, e, a, c, vf, vt, ts, stt = r[:8]
        s = vf or ts
        if (stt or "").strip().lower() == "suppressed" or c is None or not c.strip() or s is None:
            continue
        vt = vt if vt and vt > s else None
        k = (e, a, s)
        order = (ts or datetime.min, uid)
        if k not in best or order > best[k][0]:
            best[k] = (order, norm(c), vt)
    keys = defaultdict(list)
    for (e, a, s), (_, v, vt) in best.items():
        keys[e, a].append((s, v, vt))
    out = set()
    for (e, a), x in keys.items():
        x.sort()
        vers = []
        for s, v, vt in x:
            if vers and vers[-1][1] == v and (vers[-1][2] is None or vers[-1][2] >= s):
                vers[-1][2] = vt
            else:
                vers.append([s, v, vt])
        for i, (s, _, vt) in enumerate(vers):
            nxt = vers[i + 1][0] if i + 1 < len(vers) else None
            ends = [z for z in (vt, nxt) if z]
            out.add((e, a, s, min(ends) if ends else None))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return {(r.entity_id, r.attribute, r.valid_from, r.valid_to) for r in history.attribute_history(df).collect()}


def make(rng, n, keys, step=1):
    rows = []
    for i in range(n):
        s = BASE + timedelta(minutes=rng.randrange(n * step))
        rows.append((i, rng.choice(keys), rng.choice(["a", None]), rng.choice(["Red", " red. ", "RED!", "Blue", "blue", "", None, "Green  sea"]), s if rng.random() < 0.9 else None,
                     s + timedelta(minutes=rng.randrange(-5, 40)) if rng.random() < 0.4 else None, BASE + timedelta(minutes=rng.randrange(n)) if rng.random() < 0.95 else None, rng.choice(["raw", None, " Suppressed", "reviewed"])))
    return rows + rows[: n // 10]


def test_history_small(spark):
    rows = make(random.Random(1), 400, ["e1", "e2", None, "e3"])
    assert found(spark, rows) == brute(rows)


def test_history_hot_key_spans_partitions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 16)
    rows = make(random.Random(2), 1500, ["hot"] * 9 + ["e2"], step=3)
    assert found(spark, rows) == brute(rows)
    one = [(i, "h", "a", "same", BASE + timedelta(minutes=i), None, BASE, "raw") for i in range(900)]
    assert found(spark, one) == {("h", "a", BASE, None)}


def test_history_empty(spark):
    assert found(spark, []) == set()


@settings(max_examples=200, deadline=None)
@given(st.integers(min_value=0, max_value=(1 << 70) - 1))
def test_runs_of_bits(bits):
    got = list(history.runs_of(bits))
    text = bin(bits)[2:][::-1]
    want, i = [], 0
    while i < len(text):
        if text[i] == "1":
            j = i
            while j + 1 < len(text) and text[j + 1] == "1":
                j += 1
            want.append((i, j))
            i = j
        i += 1
    assert got == (want if bits else [])


def test_distinct_per_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice(["r", None]), rng.choice([None, *map(str, range(300))]), 1, "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, r string, v string, cell int, n string")
    want = defaultdict(set)
    for k, r, v, *_ in rows:
        if v is not None:
            want[k, r].add(v)
    assert {(x.k, x.r): x.m for x in skew.distinct_per_key(df, ["k", "r"], "v", "m").collect()} == {k: len(v) for k, v in want.items()}
    assert skew.distinct_per_key(df.where("false"), ["k"], "v").isEmpty()


@pytest.mark.parametrize("bits", [16, 32])
def test_exact_quantiles(spark, bits):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, 0, -5, 7, rng.randrange(-(1 << 62), 1 << 62)]), "x") for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v long, prefix string")
    vals = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            vals[k].append(v)
    want = {(k, p): (len(x), sorted(x)[max(1, -(-int(p * 100) * len(x) // 100)) - 1]) for k, x in vals.items() for p in (0.0, 0.5, 0.9, 1.0)}
    got = {(r.k, r.prob): (r.n, r.value) for r in skew.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.9, 1.0], bits).collect()}
    assert got == want
    assert skew.exact_quantiles(df.where("false"), ["k"], "v", [0.5], bits).isEmpty()
    with pytest.raises(ValueError):
        skew.exact_quantiles(df, ["k"], "v", [0.5], 10)
