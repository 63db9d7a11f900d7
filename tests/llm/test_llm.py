"""Training-data operators against brute force, with nulls, ties, repeats, hot groups, long texts and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import components, leakage, mixing, names, neighbourhood, subjects, survivor, vectors
from lorekeep.llm.hnsw import Graph

T0 = datetime(2025, 1, 1)


# --- survivors ---


def test_survivors(spark):
    rng, nan = random.Random(1), float("nan")
    rows = []
    for i in range(600):
        g = rng.choice(["hot"] * 3 + [f"g{k}" for k in range(60)] + [None])
        rows.append((f"m{i:03}", g, rng.choice(["u1", "u2", None]), rng.choice([None, nan, -1.0, 2.0, 0.5, 0.9, rng.random()]), rng.choice([None, datetime(1999, 1, 1), datetime(2050, 1, 1), T0, T0 + timedelta(hours=rng.randrange(50))]), "x", "y"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id string, writekey string, sourceauthor string, confidence double, timestamp timestamp, g string, v string")
    groups = defaultdict(dict)
    for i, g, _, c, t, *_ in rows:
        if g:
            groups[g][i] = (c if c is not None and 0 <= c <= 1 else None, t if t and T0.replace(year=2024) <= t < datetime(2027, 1, 1) else None)
    want = set()
    far = datetime.max
    for g, m in groups.items():
        if len(m) < 2:
            continue
        c = [(-x[0], x[1] is None, (far - x[1]) if x[1] else timedelta(0), i) for i, x in m.items() if x[0] is not None]
        t = [((far - x[1]), x[0] is None, -(x[0] or 0), i) for i, x in m.items() if x[1]]
        want |= {(g, "confidence", min(c)[-1])} if c else set()
        want |= {(g, "timestamp", min(t)[-1])} if t else set()
    fused = survivor.memory_survivors(df)
    assert {(r.group_key, r.field, r.id) for r in fused.best.collect()} == want
    assert all(0 < r.sensitivity < 1 and 0 < r.specificity < 1 for r in fused.sources.collect())
    assert survivor.memory_survivors(df.where("false")).best.isEmpty()


def test_alias_truth(spark):
    rows = [(f"e{g}{i}", f"k{g}", "good" if i < 3 else "bad", ["Right", " right ", "Also"] if i < 3 else [f"junk{g}", "", None], None) for g in range(40) for i in range(4)]
    df = spark.createDataFrame(rows, "id string, key string, type string, aliases array<string>, firstseen timestamp")
    fused = survivor.entity_survivors(df)
    kept = defaultdict(set)
    for r in fused.values.collect():
        kept[r.group_key].add(r.value)
    assert all(v == {"right", "also"} for v in kept.values()) and len(kept) == 40
    q = {r.source: r for r in fused.sources.collect()}
    assert q["good"].sensitivity > q["bad"].sensitivity
    assert {r.id for r in fused.best.collect()} == {f"e{g}0" for g in range(40)}


def test_judged_values_lose(spark):
    """Where the model may decide, the value of an unreliable author loses although it ranks first."""
    rows = [(f"m{g}{a}", f"g{g}", a, 0.9 if a == "liar" else 0.5, T0) for g in range(30) for a in ("ann", "ben", "cem", "liar")]
    df = spark.createDataFrame(rows, "id string, writekey string, sourceauthor string, confidence double, timestamp timestamp")
    best = lambda least: {r.id for r in survivor.memory_survivors(df, least, None).best.where("field = 'confidence'").collect()}
    assert best(0.0) == {f"m{g}liar" for g in range(30)} and best(0.5) == {f"m{g}ann" for g in range(30)}


# --- components ---


def union_find(pairs):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = f(a), f(b)
        p[max(a, b)] = min(a, b)
    return {x: f(x) for x in list(p)}


def test_components(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("s", f"t{i}") for i in range(300)]
    rnd = [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    rows = chain + star + rnd + [("self", "self"), (None, "a"), ("b", None)] + chain[:5] + [(b, a) for a, b in star[:9]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "left_id string, right_id string, u int, node string")
    want = union_find((a, b) for a, b in rows if a and b and a != b)
    assert {r.id: r.group_id for r in components.connected_components(df).collect()} == want
    assert components.connected_components(df.where("false")).isEmpty()


def test_latest_verdicts(spark):
    rows = [(1, "a", "b", " Same ", T0), (2, "b", "a", "different", T0 + timedelta(1)), (3, "c", "d", "no", None), (4, "d", "c", "DUPLICATE", None), (5, "e", "f", None, T0), (6, "f", "g", "same", T0)]
    df = spark.createDataFrame(rows, "pair_id long, left_id string, right_id string, verdict string, createdat timestamp")
    assert {(r.id, r.group_id) for r in components.match_groups(df).collect()} == {("c", "c"), ("d", "c"), ("f", "f"), ("g", "f")}


# --- sorted neighbourhood ---


def words(x):
    return frozenset(re.findall("[a-z0-9]+", (x or "").lower()))


def test_memory_repeats(spark):
    rng = random.Random(3)
    common, rare = [f"w{i}" for i in range(40)], [f"q{i}" for i in range(4000)]
    texts = []
    for i in range(500):
        kind = rng.random()
        if kind < 0.45 and texts:
            t = rng.choice(texts[:40] if rng.random() < 0.5 else texts).split(" ")
            for _ in range(rng.randrange(6)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(common + rare)
            texts.append(" ".join(t))
        elif kind < 0.5:
            texts.append(" ".join(rng.choices(common, k=rng.choice([1, 2, 3, 5, 8]))))
        elif kind < 0.55:
            texts.append(" ".join(rng.sample(rare, rng.choice([45, 60, 90])) + common[:10]))
        else:
            texts.append(" ".join(rng.sample(common, 14) + rng.sample(rare, 4)))
    rows = [(f"m{i:03}", x, rng.choice(["raw", " RAW", "reviewed", "archived", None]), rng.choice([None, T0, T0 + timedelta(1)]), "c", 1) for i, x in enumerate(texts + [None, "", "...", texts[0].upper() + "!"])]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "id string, content string, status string, timestamp timestamp, cls string, words int")
    m = {r[0]: (words(r[1]), (r[2] or "").strip().lower(), r[3]) for r in rows}
    ids, want = sorted(m), set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (x, s, d), (y, u, e) = m[a], m[b]
            if not x or not y or len(x & y) < 0.6 * len(x | y) or {s, u} - {"raw", "reviewed"} or "raw" not in (s, u):
                continue
            if "reviewed" in (s, u) or (d and e and d != e):
                want.add((a, b))
    got = [(r.id_a, r.id_b) for r in neighbourhood.memory_repeats(df).collect()]
    assert set(got) == want and len(want) > 50 and len(got) == len(set(got))
    assert neighbourhood.memory_repeats(df.where("false")).isEmpty()


@pytest.mark.parametrize("least", [0, 10_000])
def test_keys_miss_no_pair(least):
    """Whatever words are called frequent, similar sets share a key that the positions allow."""
    rng = random.Random(least)
    vocab = [f"v{i}" for i in range(60)]
    freq = {w: 100 - i for i, w in enumerate(vocab) if least == 0 or i % 2}
    sizes = list(range(1, 61))
    for _ in range(4000):
        n = rng.choice([1, 2, 3, 4, 5, 9, 20, 30, 50])
        x = set(rng.sample(vocab, n))
        y = set(x)
        for _ in range(rng.randrange(1 + n // 2)):
            y.discard(rng.choice(vocab))
            y.add(rng.choice(vocab))
        for w in rng.sample(vocab, rng.choice([0, 1, 2])):
            y ^= {w}
        if x != y and x and y and len(x & y) >= 0.6 * len(x | y):
            kx, ky = ({(k[0], k[4]): k for k in neighbourhood.keys_of(sorted(z), freq, sizes)} for z in (x, y))
            o = -(-3 * (len(x) + len(y)) // 8)

            def holds(a, b):
                (_, n, c, p, kind), (_, m, d, q, _) = a, b
                if kind in (0, 2):
                    return p <= n - o + 1 and q <= m - o + 1 and (kind == 0 or max(n, m) > neighbourhood.LARGE)
                return o < 3 if kind == 3 else o <= min(c, d) and p <= c - o + 3 and q <= d - o + 3

            assert any(holds(kx[k], ky[k]) for k in kx.keys() & ky.keys()), (x, y)


def test_sorted_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbourhood, "FAN", 2)
    say = lambda n, t: spark.createDataFrame([(f"{n}{i}", x) for i, x in enumerate(t)], "id string, content string")
    runs = neighbourhood.SortedRuns(spark, str(tmp_path / "runs"))
    a = "ada moved the survey project into the new lisbon office in march"
    assert runs.ingest(say("a", [a, "something else entirely was said here", None, ""])).isEmpty()
    got = {(r.id, r.match_id) for r in runs.ingest(say("b", [a.upper() + "!", a + " again", "unrelated words of no interest"])).collect()}
    assert got == {("b0", "a0"), ("b1", "a0")}
    before = runs.manifest()
    assert runs.ingest(say("x", [None])).isEmpty() and runs.manifest() == before
    got = {(r.id, r.match_id) for r in runs.ingest(say("c", ["ada moved the survey project into the new lisbon office in may"])).collect()}
    assert got == {("c0", "a0"), ("c0", "b0"), ("c0", "b1")}
    assert len(runs.manifest()[1]["runs"]) <= 2
    assert {r.match_id for r in runs.ingest(say("d", [a])).collect()} == {"a0", "b0", "b1", "c0"}
    # a text of a size that no earlier one has
    assert {r.match_id for r in runs.ingest(say("e", [a + " with all her old books"])).collect()} == {"a0", "b0", "b1", "d0"}


def test_batches_read_their_ranges(spark, tmp_path, monkeypatch):
    """A batch reads the key ranges it touches, however long the history is."""
    monkeypatch.setattr(neighbourhood, "RANGE_ROWS", 100)
    rng = random.Random(5)
    words_ = [f"q{i}" for i in range(50_000)]

    def read(n):
        runs = neighbourhood.SortedRuns(spark, str(tmp_path / f"h{n}"))
        texts = [" ".join(rng.sample(words_, 12)) for _ in range(n)]
        runs.ingest(spark.createDataFrame([(f"h{i}", x) for i, x in enumerate(texts)], "id string, content string"), wanted=None)
        got = runs.ingest(spark.createDataFrame([("new", texts[7] + " more")], "id string, content string")).collect()
        assert [(r.id, r.match_id) for r in got] == [("new", "h7")]
        size = lambda paths: sum(f.stat().st_size for p in paths for f in __import__("pathlib").Path(p).rglob("*.parquet"))
        return sum(size(x) for x in runs.last_read.values())

    small, large = read(200), read(1600)
    assert large < 2 * small


# --- vectors ---


def top_pairs(x, ids, k=5, least=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(float(s[i, j]), 12), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= least}
    return out


def test_similar_pairs(spark, monkeypatch):
    # several levels of splitting, shards split by hash, and shards asked in several chunks
    for name, value in (("SHARD", 60), ("SPLIT", 90), ("FANOUT", 4), ("ASKERS", 64)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((700, 64))
    x = np.concatenate([base, base[:300] + 0.25 * rng.standard_normal((300, 64)), base[:150] + 0.2 * rng.standard_normal((150, 64)), np.repeat(base[5:6], 40, 0)]).astype(np.float32)
    ids = [f"v{i:04}" for i in rng.permutation(len(x))]
    rows = [(i, [float(z) for z in v], 1, "s") for i, v in zip(ids, x, strict=True)]
    rows += rows[:30] + [("null", None, 1, "s"), ("zero", [0.0] * 64, 1, "s"), ("short", [1.0] * 32, 1, "s"), ("nan", [float("nan")] * 64, 1, "s"), (None, [1.0] * 64, 1, "s")]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, shard int, own string")
    got = {(r.id_a, r.id_b) for r in vectors.similar_pairs(df).collect()}
    want = top_pairs(x.astype(np.float64), ids)
    assert len(want) > 400 and len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.01 * len(want)
    assert vectors.similar_pairs(df.where("false")).isEmpty()
    assert vectors.similar_pairs(df.where("id = 'null'")).isEmpty()


def test_graph_search_recall():
    """At the values used in production, for rows of the graph and for others."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[1500:] = x[:1500] + 0.4 * rng.standard_normal((1500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::20] + 0.05 * rng.standard_normal((150, 64)).astype(np.float32)
    g = Graph(x)
    ids, _ = g.search(q, 5, ef=vectors.EF)
    true = np.argsort(-(q @ x.T), axis=1)[:, 0]
    assert np.mean([t in i for i, t in zip(ids, true, strict=True)]) >= 0.99
    ids, _ = g.search(x, 6, ef=vectors.EF, own=np.arange(3000))
    s = x @ x.T
    np.fill_diagonal(s, -1)
    near = np.argsort(-s, axis=1)[:, 0]
    ok = s.max(1) >= 0.85
    assert ok.sum() > 1000 and np.mean([t in i for i, t in zip(ids[ok], near[ok], strict=True)]) >= 0.99
    assert Graph(x[:1]).search(q[:2], 3)[0].tolist() == [[0, -1, -1]] * 2
    assert Graph(x[:0]).search(q[:1], 2)[0].tolist() == [[-1, -1]]


def test_rows_come_from_the_graph(spark):
    """Without the search of the graph there is no pair."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 64))
    x = np.concatenate([x, x + 0.1 * rng.standard_normal(x.shape)])
    rows = spark.createDataFrame([(f"v{i}", [float(z) for z in v]) for i, v in enumerate(x)], "id string, v array<float>")
    assert vectors.neighbours(rows, 64).count() >= 390


    class Blind(Graph):
        def search(self, q, k, *_):
            return np.full((len(q), k), -1), np.full((len(q), k), -np.inf)

    assert vectors.neighbours(rows, 64, index=Blind).isEmpty()


def test_routing_tree():
    rng = np.random.default_rng(9)
    u = rng.standard_normal((500, 16)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    tree = [(u[:4], [0, -2, 2, 3]), (u[10:14], [4, 5, 6, 7])]
    row, shard, own = vectors.route(u, tree, 0.1)
    home = (u @ u[:4].T).argmax(1)
    below = 4 + (u @ u[10:14].T).argmax(1)
    assert (shard[own] == np.where(home == 1, below, home)).all() and (row[own] == np.arange(500)).all()
    assert len(set(zip(row, shard, strict=True))) == len(row) and (~own).sum() > 50
    g = u @ u[:4].T
    want = {(i, s) for i, s in zip(*np.nonzero(g >= g.max(1)[:, None] - 0.1), strict=True) if s != home[i] and s != 1}
    assert {(r, s) for r, s, o in zip(row, shard, own, strict=True) if not o and s < 4} == want


# --- names ---


def test_name_forms():
    m = lambda a, b: names.match(names.tokens_of(a), names.tokens_of(b))
    for a, b in [("Ada Lovelock", "Lovelock, Ada"), ("Ádá  lovelock", "ADA LOVELOCK"), ("Dr. Ada Lovelock", "Ada K. Lovelock"), ("Ben Tarrowmont", "benjamin tarowmont"), ("adalovelock", "Ada Lovelock"),
                 ("Tarrow Mfg. Univ.", "Tarrow Manufacturing & University"), ("RedTracker", "red_tracker"), ("Mt. Tarrowby", "Tarrowby (Mount)"), ("Tarrow Dept. Labs", "Tarrow Department Laboratories GmbH")]:
        assert m(a, b) == names.STRONG, (a, b)
    assert m("A. Lovelock", "Ada Lovelock") == names.WEAK
    for a, b in [("Anna Lovelock", "Hanna Lovelock"), ("Lovelock", "Ada Lovelock"), ("Tarrow Archive", "Tarrow Journal"), ("Ada Lovelock", "Bea Lovelock"), ("Ada Lovelock", "Ada Tarrow"), ("Tarrow Manufacturing", "Tarrow Manufacturing University")]:
        assert m(a, b) == 0, (a, b)
    assert names.is_acronym("The D.M.I.") and not names.is_acronym("Dmi")
    assert names.edits("abcd", "abdc", 2) == 1 and names.edits("abcd", "wxyz", 2) == 3


def test_name_groups(spark):
    rows = [("1", "Ada Lovelock", "Person", ["Ada", "Lovelock"]), ("2", "Lovelock, Ada", None, None), ("3", "Ada Lovelok", "user", []), ("4", "A. Lovelock", "Person", [""]), ("5", "Ada Lovelock", "Project", None),
            ("6", "Bo Tarrowmont", "person", ["Tarrowmont"]), ("7", "Bea Tarrowmont", "person", ["Tarrowmont"]), ("8", "B Tarrowmont", "person", None), ("9", "TRI", "org", ["Tarrow Research Institute"]),
            ("10", "Tarrow Research Institute", "company", None), ("11", "TRI", "org", ["Tolkin Rail Industry"]), ("12", None, None, None), ("13", "  ", "person", [None, ""]), ("14", "Calendar", "tool", None), ("15", "calendar", None, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + rows[:3]], "id string, name string, type string, aliases array<string>, form string, group_id string")
    got = {(r.id_a, r.id_b) for r in names.variant_pairs(df).collect()}
    # the untyped form "Ada Lovelock" of entity 2 is seen with two types, so it joins neither
    assert {("1", "3"), ("1", "4"), ("3", "4"), ("10", "9"), ("14", "15")} <= got
    assert not any({"6", "7"} & set(p) or {"8", "11", "12", "13", "5"} & set(p) for p in got)
    assert names.variant_pairs(df.where("false")).isEmpty()


def test_name_candidates_complete(spark):
    """Whatever keys are hot, no pair of forms that match is missed."""
    rng = random.Random(9)
    given, family = ["john", "bob", "robert", "christina", "margaret", "hettanfirbeck", "philip", "kata"], ["smith", "jones", "lovelock", "manufacturing", "tarrowmontsby", "mfg", "j", "k"]
    forms = set()
    for _ in range(260):
        f = [rng.choice(given), *rng.sample(family, rng.choice([1, 1, 2]))]
        rng.shuffle(f)
        if rng.random() < 0.6:
            i = rng.randrange(len(f))
            w = list(f[i])
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                if rng.random() < 0.5 and len(w) > 2:
                    del w[at]
                else:
                    w[at : at + 1] = [rng.choice("abckp"), w[at]][rng.randrange(2) :]
            f[i] = "".join(w)
        forms.add("".join(f) if rng.random() < 0.1 else f[0] if rng.random() < 0.05 else " ".join(f))
    forms = sorted(forms)
    want = {(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if names.match(a.split(), b.split())}
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    assert len(want) > 200
    for most in (8, 100_000):
        got = {(r.a, r.b) for r in names.candidates(df, most).collect()}
        assert want <= got, sorted(want - got)[:5]


def test_names_do_not_depend_on_size(spark):
    """Nine rows give the same six links alone and among thousands of bearers of the same names."""
    nine = [("1", "John Smith"), ("2", "J. Smith"), ("3", "John Smith"), ("4", "Robert Jones"), ("5", "Bob Jones"), ("6", "Chris Smith"), ("7", "Christina Smith"), ("8", "Margaret Jones"), ("9", "Maragret Jonse")]
    given = [x + y for x in ("Al", "Bren", "Cor", "Dor", "El", "Fen", "Gor", "Hal", "Ir", "Kel") for y in ("bartus", "cilla", "dovanna", "fredo", "gunde", "hardus", "lindor", "mirella", "nestor", "pollo")]
    many = [(f"s{i}", f"{g} {'Smith' if i % 2 else 'Jones'}") for i, g in enumerate(given)]
    rng, letters = random.Random(4), "abdefghilmnoprstuv"
    word = lambda: "".join(rng.choices(letters, k=9)).capitalize()
    for i in range(1600):
        many += [(f"a{i}", f"{word()} Smith"), (f"b{i}", f"Robert {word()}"), (f"c{i}", f"{word()} Jones"), (f"d{i}", f"Margaret {word()}"), (f"e{i}", f"Chris {word()}"), (f"f{i}", f"Christina {word()}")]
    frame = lambda rows: spark.createDataFrame([(*r, "Person", None) for r in rows], "id string, name string, type string, aliases array<string>")
    links = lambda df: {(r.id_a, r.id_b) for r in names.variant_pairs(df).where("id_a < 'A' and id_b < 'A'").collect()}
    alone = links(frame(nine))
    assert alone == {("1", "2"), ("1", "3"), ("2", "3"), ("4", "5"), ("6", "7"), ("8", "9")}
    assert links(frame(nine + many)) == alone


# --- leakage ---


def test_leaks(spark):
    rng = random.Random(7)
    w = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(w, k=rng.choice([5, 8, 20])))) for i in range(40)] + [(98, None), (99, "")]
    items.append((97, items[3][1].upper()))
    docs = []
    for d in range(300):
        x = rng.choices([*w, "zz", "İx"], k=rng.randrange(60))
        if rng.random() < 0.6:
            t = rng.choice(items[:40])[1].split()
            x[5:5] = t[: rng.randrange(1, len(t) + 1)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(x)))
    docs += [(900, None), (901, ""), (902, "zz " * 200_000 + items[2][1] + " and more" * 9)]
    n = 8
    grams = lambda t: {tuple(v[i : i + n]) for v in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(v) - n + 1)}
    gi = {i: grams(t) for i, t in items}
    want = {(d, i) for d, t in docs for g in [grams(t)] for i in gi if g & gi[i]}
    dd, ii = spark.createDataFrame([(*r, 1) for r in docs] + [(None, items[2][1], 1)], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(dd, ii).collect()} == want and len(want) > 50
    clean = leakage.without_leaks(dd, ii, drop_share=2.0)
    assert clean.count() == len(docs)
    assert leakage.leaked_items(clean.select("doc_id", F.col("text")), ii).isEmpty()
    kept = {r.doc_id: tuple(r) for r in clean.collect()}
    assert all("İ" in kept[d][3] for d, t in docs if t and "İ" in t and not kept[d][1])
    # test material beyond the broadcast set is joined, with the same result
    assert {(r.doc_id, r.item_id) for r in leakage.leaked_items(dd, ii, most=10).collect()} == want
    assert {r.doc_id: tuple(r) for r in leakage.without_leaks(dd, ii, drop_share=2.0, most=10).collect()} == kept
    assert leakage.leaked_items(dd.where("false"), ii).isEmpty() and leakage.leaked_items(dd, ii.where("false")).isEmpty()
    assert leakage.without_leaks(dd, ii, drop_share=0.0).count() < len(docs)


# --- mixing ---


def test_split_quotas():
    q = np.array([1000, 10, 0, 333])
    s = mixing.split_quotas(q, 7)
    assert (s.sum(0) == q).all() and s.sum(1).max() - s.sum(1).min() <= 2 and (s >= 0).all()
    assert (mixing.split_quotas(q, 7) == s).all()
    assert mixing.split_quotas(np.array([0, 0]), 3).sum() == 0
    many = np.array([mixing.split_quotas(np.array([60, 20]), 4, seed)[0, 0] for seed in range(200)])
    assert abs(many.mean() - 15) < 0.6 and many.std() > 0.5


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["big"] * 8 + ["small", " Small ", None, "other"]), " ".join(rng.choices(["tea", "survey", "office"], k=rng.randrange(5, 40)))) for i in range(2000)] + [(5000, "big", None), (5001, "big", "")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, source string, text string, block string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(d, t, shard_tokens=4000)
    rows, rep = mix.collect(), {r.source: r for r in report.collect()}
    copies = Counter((r.doc_id, r.copy) for r in rows)
    assert max(copies.values()) == 1 and max(r.copy for r in rows if r.source == "big") == 0 and max(r.copy for r in rows if r.source == "small") <= 2
    size = Counter()
    for r in rows:
        size[r.source] += r.n_tokens
    assert {s: rep[s].tokens for s in rep} == {"big": size["big"], "small": size["small"], "absent": 0}
    total = rep["big"].available + rep["small"].available
    assert abs(rep["big"].tokens - 0.6 * total) < 0.01 * total and abs(rep["small"].tokens - 0.3 * total) < 0.01 * total
    assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.pos for r in rows if r.shard == s) == list(range(1, n + 1))
    assert len({r.shard for r in rows}) > 3
    again, _ = mixing.mix_sources(d, t, shard_tokens=4000)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}
    none, rep0 = mixing.mix_sources(d.where("false"), t)
    assert none.isEmpty() and {r.tokens for r in rep0.collect()} == {0}


# --- subjects ---


def test_subjects(spark):
    music = "The orchestra rehearsed the arpeggio. A fermata follows the chord."
    docs = [(1, music), (2, "Interest was low. The river bank was calm. We met Ada by the Tarrow Guitar."), (3, music + " It rained. It snowed. We went home. We slept well. Nothing more."), (4, None), (5, ""),
            (6, "[user]: The server cache broke.\n\n[assistant]: Deploy the webhook and the server.\n- The oven and the dough."), (7, "word " * 100_000), (8, "Der Teig kommt in den Ofen. Das Mehl fehlt."), (None, music)]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, subject string, n int")
    got = {(r.doc_id, r.subject) for r in subjects.document_subjects(d).collect()}
    assert got == {(1, "music"), (3, "music"), (6, "software"), (6, "cooking"), (8, "cooking")}
    labels = spark.createDataFrame([(1, " Music "), (3, "none"), (3, None)], "doc_id long, subject string")
    limit = subjects.calibrate(subjects.subject_shares(d), labels)
    assert 0.2 <= limit["music"] <= 0.3 and limit["law"] == 0.25
    assert subjects.document_subjects(d.where("false"), labels.where("false")).isEmpty()
    assert list(subjects.sentences("> One two. Three four!\nseq=1 step=a reason: Five six? x")) == ["One two.", "Three four!", "Five six?"]
