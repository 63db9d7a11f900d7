"""Pair counts without pairs, name normal forms and cluster order."""

import random

import numpy as np

from lorekeep.functions import text
from lorekeep.operators import editor, graph


def test_pair_count(spark):
    rng = random.Random(3)
    rows = [(f"m{i}", f"e{rng.choice([0, 0, 0, 1, 1, 2, 3, 4, 5, 6])}") for i in range(80) for _ in range(rng.randrange(1, 9))]
    rows += [("hub", f"e{i}") for i in range(14)] + [("m1", None), (None, "e0")]
    sets = {}
    for m, e in rows:
        if m and e:
            sets.setdefault(m, set()).add(e)
    ids = sorted(sets)
    want = sum(bool(sets[a] & sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
    df = spark.createDataFrame(rows, "memory_id string, entity_id string")
    for most in (2, 4, 10):
        assert graph.candidate_pair_count(df, most).first()[0] == want
    assert graph.candidate_pair_count(df.where("false")).first()[0] == 0


def test_normal_names(spark):
    names = ["Müller, ＡDA", "STRASSE straße", "a_b  c-d", None, "", "½ x²"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.normal_name("n")).collect()]
    assert got == ["ada müller", "strasse strasse", "a_b c d", "", "", "1 2 x2"]


def test_cluster_order():
    """Candidates come in the order of the seeds: the one most like all others first."""
    sim = np.full((6, 6), 0.1)
    np.fill_diagonal(sim, 1)
    for i, j, v in [(0, 1, 0.9), (0, 2, 0.86), (2, 3, 0.9), (0, 3, 0.86), (1, 4, 0.7), (2, 4, 0.6), (2, 5, 0.6)]:
        sim[i, j] = sim[j, i] = v
    # 0 is nearest to 1, but 2 and 3 come first by their mean; 1 is far from both
    assert editor.find_clusters(list("abcdef"), sim, 0.85, 2)[0] == ["a", "c", "d"]
