"""Evaluation metrics as DataFrame operators; every ratio has four places and says what it counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.functions import scoring, text


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to (tp, predicted, gold); nothing predicted has precision 1, nothing to find recall 1."""
    p = F.when(F.col("predicted") == 0, 1.0).otherwise(F.col("tp") / F.col("predicted"))
    r = F.when(F.col("gold") == 0, 1.0).otherwise(F.col("tp") / F.col("gold"))
    return counts.select("*", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), scoring.f1(p, r).alias("f1"))


def _pairs(labels: DataFrame, *by: str) -> DataFrame:
    n = F.col("count").cast("long")
    return labels.groupBy(*by).count().agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("x"))


def pairwise_clustering(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of tp, predicted, gold, precision, recall, f1 over pairs of items; (item, label) each.

    Counted from group sizes, no pair is made.  Items without prediction are groups of one; predictions of other items do
    not count.
    """
    j = gold.select("item", F.col("label").alias("g")).join(predicted.select("item", F.col("label").alias("p")), "item", "left")
    known, j = j.where("p is not null"), j
    both, pred, all_ = _pairs(known, "g", "p"), _pairs(known, "p"), _pairs(j, "g")
    c = both.select(F.col("x").alias("tp")).crossJoin(pred.select(F.col("x").alias("predicted"))).crossJoin(all_.select(F.col("x").alias("gold")))
    return prf(c)


def placements(chains: DataFrame) -> DataFrame:
    """(chain, cluster, pos): position of each cluster; ``older`` ones stand at the start, ``newer`` ones at the end."""
    last = (F.size("sequence") - 1).cast("int")
    s = chains.select(F.col("id").alias("chain"), F.posexplode("sequence").alias("pos", "cluster"))
    o = chains.select(F.col("id").alias("chain"), F.lit(0).alias("pos"), F.explode("older").alias("cluster"))
    n = chains.select(F.col("id").alias("chain"), last.alias("pos"), F.explode("newer").alias("cluster"))
    return s.unionByName(o).unionByName(n).select("chain", "cluster", "pos")


def outdated_clusters(chains: DataFrame) -> DataFrame:
    return chains.select(F.explode(F.slice("sequence", F.lit(1), F.greatest(F.lit(0), F.size("sequence") - 1))).alias("cluster")).distinct()


def conflict_metrics(chains: DataFrame, edges: DataFrame, ignore: DataFrame) -> DataFrame:
    """One row of edge metrics; ``edges`` (edge_id, source, target, kind), ``ignore`` (a, b).

    An edge is right if both ends stand at different positions of one chain; of several such chains the first by id counts.
    """
    ig = ignore.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = edges.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(ig, ["lo", "hi"], "left_anti")
    p = placements(chains)
    a, b = p.select("chain", F.col("cluster").alias("source"), F.col("pos").alias("pa")), p.select(F.col("chain").alias("chain2"), F.col("cluster").alias("target"), F.col("pos").alias("pb"))
    m = e.join(a, "source").join(b, "target").where("chain = chain2 and pa <> pb")
    first = m.groupBy("edge_id").agg(F.min_by(F.struct("source", "target", "kind", "pa", "pb"), F.struct("chain", "pa", "pb")).alias("x")).select("edge_id", "x.*")
    placed = e.select("edge_id").join(first, "edge_id", "left")
    old = first.select(F.when(F.col("pa") < F.col("pb"), F.col("source")).otherwise(F.col("target")).alias("cluster")).distinct()
    out = outdated_clusters(chains)
    c = placed.agg(
        F.count(F.lit(1)).alias("predicted_edges"), F.count("pa").alias("correct_edges"),
        F.count_if(F.col("kind") == "supersedes").alias("directed"), F.count_if((F.col("kind") == "supersedes") & (F.col("pa") > F.col("pb"))).alias("directed_ok"),
    )
    c = c.crossJoin(out.agg(F.count(F.lit(1)).alias("outdated"))).crossJoin(out.join(old, "cluster", "left_semi").agg(F.count(F.lit(1)).alias("detected")))
    p_, r_ = F.when(F.col("predicted_edges") == 0, 1.0).otherwise(F.col("correct_edges") / F.col("predicted_edges")), F.when(F.col("outdated") == 0, 1.0).otherwise(F.col("detected") / F.col("outdated"))
    return c.select(
        "predicted_edges", "correct_edges", "outdated", "detected", F.round(p_, 4).alias("precision"), F.round(r_, 4).alias("recall"),
        scoring.f1(p_, r_).alias("f1"), F.round(F.col("directed_ok") / F.nullif("directed", F.lit(0)), 4).alias("direction_accuracy"),
    )


def supersession_state(chains: DataFrame, state: DataFrame) -> DataFrame:
    """Shares of outdated clusters fully superseded and of current ones wrongly so, and superseded ones in no chain;
    ``state`` (cluster, active, superseded)."""
    out = outdated_clusters(chains).join(state, "cluster", "left")
    cur = chains.where("size(sequence) > 0").select(F.element_at("sequence", -1).alias("cluster")).join(state, "cluster", "left")
    else_ = state.where("superseded > 0").join(placements(chains).select("cluster"), "cluster", "left_anti")
    full = F.coalesce((F.col("active") > 0) & (F.col("active") == F.col("superseded")), F.lit(False)).cast("int")
    return (
        out.agg(F.round(F.avg(full), 4).alias("outdated_superseded"))
        .crossJoin(cur.agg(F.round(F.avg((F.coalesce("superseded", F.lit(0)) > 0).cast("int")), 4).alias("current_wrongly_superseded")))
        .crossJoin(else_.agg(F.count(F.lit(1)).alias("superseded_outside_chains")))
    )


def retrieval_rows(questions: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """(id, type, recall, rr, has_stale, stale_first) per question; ``ranked`` (id, rank, cluster), ranks from 1."""
    g = questions.select("id", F.posexplode("answer").alias("grp", "ok")).select("id", "grp", F.explode_outer("ok").alias("cluster"))
    hit = g.join(ranked, ["id", "cluster"], "left")
    per = hit.groupBy("id", "grp").agg(F.max(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias("in_k"), F.min("rank").alias("best"))
    q = per.groupBy("id").agg(F.avg("in_k").alias("recall"), F.min("best").alias("best"))
    s = questions.select("id", F.explode("stale").alias("cluster")).join(ranked, ["id", "cluster"]).groupBy("id").agg(F.min("rank").alias("stale_rank"))
    j = questions.select("id", "type", (F.size("stale") > 0).alias("has_stale")).join(q, "id", "left").join(s, "id", "left")
    first = F.coalesce(F.col("stale_rank") <= F.coalesce("best", F.lit(2147483647)), F.lit(False))
    # a cluster that is both an answer and stale counts as stale, as it is met first either way
    return j.select("id", "type", F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"), "has_stale", (F.col("has_stale") & first).alias("stale_first"))


def retrieval_metrics(questions: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """(type, n, recall, mrr, stale_first_rate) overall (type null) and per type."""
    r = retrieval_rows(questions, ranked, k)
    stale = F.round(F.sum((F.col("stale_first")).cast("int")) / F.nullif(F.count_if("has_stale"), F.lit(0)), 4)
    return r.groupingSets([[], ["type"]], "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"), stale.alias("stale_first_rate"))


def token_f1(answers: DataFrame, predicted: str = "predicted", gold: str = "gold", ident: str = "id") -> DataFrame:
    """(id, f1) of the words two texts share, as multisets."""
    a = answers.select(ident, text.answer_tokens(F.col(predicted)).alias("p"), text.answer_tokens(F.col(gold)).alias("g"))
    cnt = lambda c: F.aggregate(F.array_distinct(F.col(c)), F.lit(0), lambda s, x: s + F.least(F.size(F.filter("p", lambda y: y == x)), F.size(F.filter("g", lambda y: y == x))))
    common = cnt("p")
    f1 = F.when((F.size("p") > 0) & (F.size("g") > 0) & (common > 0), 2 * common / (F.size("p") + F.size("g"))).otherwise(0.0)
    return a.select(ident, F.coalesce(f1, F.lit(0.0)).alias("f1"))


def threshold_gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(path, value, low, high, ok) for each limit (path, low, high); a metric that is missing or null fails."""
    v = F.col("value")
    ok = v.isNotNull() & (F.col("low").isNull() | (v >= F.col("low"))) & (F.col("high").isNull() | (v <= F.col("high")))
    return limits.join(metrics.select("path", "value"), "path", "left").select("path", "value", "low", "high", ok.alias("ok"))


def step_costs(usage: DataFrame) -> DataFrame:
    """(step, calls, tokens_in, tokens_out, cost_usd) per step and in all (step null); an unpriced call makes the cost null.

    ``usage`` (step, model, tokens_in, tokens_out), one row per call; steps without model calls have no row.
    """
    u = usage.withColumn("cost", text.cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out")))
    cost = F.when(F.count("cost") < F.count(F.lit(1)), F.lit(None)).otherwise(F.round(F.sum("cost"), 6))
    return u.groupingSets([[], ["step"]], "step").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), cost.alias("cost_usd"))


def conversation_scores(answers: DataFrame) -> DataFrame:
    """(grp, name, n, accuracy, f1, evidence_recall): overall, by category and by conversation."""
    agg = [F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("f1"), F.round(F.avg("evidence"), 4).alias("evidence_recall")]
    a = answers.withColumn("category", F.col("category").cast("string"))
    over = a.agg(*agg).select(F.lit("overall").alias("grp"), F.lit("all").alias("name"), "n", "accuracy", "f1", "evidence_recall")
    cat = a.groupBy("category").agg(*agg).select(F.lit("category").alias("grp"), F.col("category").alias("name"), "n", "accuracy", "f1", "evidence_recall")
    con = a.groupBy("sample_id").agg(*agg).select(F.lit("conversation").alias("grp"), F.col("sample_id").alias("name"), "n", "accuracy", "f1", "evidence_recall")
    return over.unionByName(cat).unionByName(con)


def evidence_recall(questions: DataFrame, found: DataFrame) -> DataFrame:
    """(id, evidence): share of a question's evidence sessions (``D3:7`` is session 3) among its retrieved ones (id, sessions)."""
    s = F.array_distinct(F.transform("evidence", lambda e: F.regexp_extract(e, r"^D(\d+)", 1).try_cast("int")))
    q = questions.select("id", F.filter(s, lambda x: x.isNotNull()).alias("want")).where("size(want) > 0")
    return q.join(found, "id", "left").select("id", (F.size(F.array_intersect("want", F.coalesce("sessions", F.array().cast("array<int>")))) / F.size("want")).alias("evidence"))


def sample_failures(answers: DataFrame, per_category: int = 3) -> DataFrame:
    """The first wrong answers of each category, by id."""
    w = Window.partitionBy("category").orderBy("id")
    return answers.where("not correct").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_category).drop("rn")


STEP_ORDER = {s: i for i, s in enumerate(schema.STEPS)}
