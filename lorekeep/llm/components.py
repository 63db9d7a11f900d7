"""Consolidating pairwise matches into groups.

Method: deterministic Boruvka hooking.  In every round each component selects its smallest outgoing
edge (edges ordered by their smaller, then larger end), hooks to the other end, trees collapse by
pointer doubling, and the edges are relabelled and deduplicated until none remain.  Every component
with an edge merges in every round, so rounds are logarithmic in the number of components.

Scale: all steps are map-side combined aggregations and equi-joins that AQE may split when one
component is hot; nothing but row counts reaches the driver.  Each round is checkpointed in the shared
folder, so plans stay short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.runtime import clean, cut


def _collapse(parent: DataFrame) -> DataFrame:
    """(node, root) from (node, parent) by pointer doubling; roots point to themselves."""
    while True:
        a, b = parent.alias("a"), parent.alias("b")
        parent = cut(
            a.join(b, F.col("a.parent") == F.col("b.node")).select(
                F.col("a.node").alias("node"),
                F.col("b.parent").alias("parent"),
                (F.col("a.parent") != F.col("b.parent")).alias("moved"),
            )
        )
        if parent.where("moved").isEmpty():
            return parent.select("node", F.col("parent").alias("root"))
        parent = parent.drop("moved")


def _hooks(edges: DataFrame) -> DataFrame:
    """(node, parent): every component's other end of its smallest edge; of two that choose each other the smaller is root."""
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = both.groupBy(F.col("u").alias("node")).agg(F.min(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("e"))
    # an edge chosen from both ends is the tree's only cycle
    w = Window.partitionBy("e")  # at most two rows: the two ends of one edge
    chosen = best.withColumn("n", F.count(F.lit(1)).over(w))
    other = F.when(F.col("e.lo") == F.col("node"), F.col("e.hi")).otherwise(F.col("e.lo"))
    return chosen.select(
        "node",
        F.when((F.col("n") == 2) & (F.col("node") == F.col("e.lo")), F.col("node")).otherwise(other).alias("parent"),
    )


def connected_components(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(id, group_id) for every id on a pair of two different non-null ids; group_id is the group's smallest id.

    Self pairs and pairs with a null end link nothing and give no row; repeats and either order count once.
    No pair gives no row.  Other columns are ignored.
    """
    edges = (
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
        .distinct()
    )
    edges = cut(edges)
    if edges.isEmpty():
        kind = dict(pairs.dtypes)[left]
        return edges.select(F.col("u").cast(kind).alias("id"), F.col("u").cast(kind).alias("group_id"))
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        root = _collapse(_hooks(edges))
        # name each merged component after its smallest member, so the last name is the answer
        names = root.groupBy("root").agg(F.min("node").alias("name"))
        step = cut(root.join(names, "root").select("node", "name"))
        steps.append(step)
        a, b = step.alias("a"), step.alias("b")
        edges = cut(
            edges.join(a, F.col("u") == F.col("a.node"))
            .join(b, F.col("v") == F.col("b.node"))
            .where("a.name <> b.name")
            .select(F.least("a.name", "b.name").alias("u"), F.greatest("a.name", "b.name").alias("v"))
            .distinct()
        )
    # compose the rounds from the last, smallest one backwards
    final = steps.pop()
    while steps:
        s, f = steps.pop().alias("s"), final.alias("f")
        final = s.join(f, F.col("s.name") == F.col("f.node"), "left").select(
            F.col("s.node").alias("node"), F.coalesce("f.name", "s.name").alias("name")
        )
    return final.select(F.col("node").alias("id"), F.col("name").alias("group_id"))


def latest_verdicts(
    pairs: DataFrame,
    left: str = "left_id",
    right: str = "right_id",
    verdict: str = "verdict",
    at: str = "createdat",
    tie: str = "pair_id",
) -> DataFrame:
    """(u, v, verdict): the latest verdict, cleaned, of each unordered pair of two different non-null ids.

    Later ``at`` wins (null is earliest), then the larger ``tie``.
    """
    return (
        pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .groupBy(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"))
        .agg(F.max_by(F.struct(clean(F.col(verdict)).alias("x")), F.struct(at, tie)).alias("r"))
        .select("u", "v", F.col("r.x").alias("verdict"))
    )


def match_groups(pairs: DataFrame, same: tuple[str, ...] = ("duplicate", "same")) -> DataFrame:
    """Groups of the ids whose latest verdict says they are the same; see ``connected_components``."""
    linked = latest_verdicts(pairs).where(F.col("verdict").isin(*same))
    return connected_components(linked, "u", "v")
