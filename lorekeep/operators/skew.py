"""Per-key results where a few keys hold most of the rows.

Two operators, both free of any per-key gather:

* ``distinct_per_key``: exact distinct counts.  The value space is split by hash into histogram
  cells; every cell is deduplicated and counted on its own, and the mergeable cell counts are summed.
* ``exact_quantiles``: exact per-key quantiles by distributed selection.  A 64-bit histogram of the
  values is refined digit by digit: each pass counts the values of the cell that holds the wanted
  rank, 2**``bits`` sub-cells at a time, until the cell is one value.  Tasks send counts only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.runtime import cut


def key_histogram(df: DataFrame, keys: Sequence[str], value: str, cells: int = 64) -> DataFrame:
    """(keys, cell, n): distinct non-null values of each key in each hash cell.

    The shuffle is on (keys, value), so a hot key is spread over all tasks; the count per cell then
    merges at most ``cells`` numbers per key and task.
    """
    one = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")).distinct()
    return one.groupBy(*keys, F.pmod(F.xxhash64("__v"), F.lit(cells)).cast("int").alias("cell")).agg(
        F.count(F.lit(1)).alias("n")
    )


def distinct_per_key(df: DataFrame, keys: Sequence[str], value: str, out: str = "n", cells: int = 64) -> DataFrame:
    """(keys, out): number of distinct non-null ``value`` per key; null keys form a key of their own."""
    return key_histogram(df, keys, value, cells).groupBy(*keys).agg(F.sum("n").alias(out))


_BIAS = -(1 << 63)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], bits: int = 16
) -> DataFrame:
    """(keys, prob, n, value): exact quantile of a long or timestamp column per key, lower rank on ties.

    The rank of probability ``p`` among ``n`` values is ``ceil(p * n)``, at least 1.  Nulls do not count,
    repeated rows do; a key without values has no row.  ``64 / bits`` passes over the data, each a map-side
    combined count: a task sends at most 2**bits numbers per key and probability, never its values.
    """
    if 64 % bits:
        raise ValueError("bits must divide 64")
    kind = dict(df.dtypes)[value]
    number = F.unix_micros(F.col(value).cast("timestamp")) if kind.startswith("timestamp") else F.col(value).cast("long")
    # order-preserving unsigned view: flip the sign bit
    x = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], number.bitwiseXOR(F.lit(_BIAS)).alias("__x"))
    x = x.where("__x is not null")
    ks = [f"__k{i}" for i in range(len(keys))]
    width, shift, state = 64 // bits, 64 - bits, None
    mask = F.lit((1 << bits) - 1).cast("long")
    for step in range(width):
        digit = F.shiftrightunsigned("__x", shift).bitwiseAND(mask)
        if step == 0:
            counts = x.groupBy(*ks, digit.alias("d")).agg(F.count(F.lit(1)).alias("c"))
            totals = counts.groupBy(*ks).agg(F.sum("c").alias("n"))
            want = totals.select(*ks, "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
            state = want.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n")))).withColumn(
                "prefix", F.lit(0).cast("long")
            )
            counts = counts.withColumn("prefix", F.lit(0).cast("long"))
        else:
            cells = state.select(*ks, "prefix").distinct()
            prefix = F.shiftrightunsigned("__x", shift + bits)
            live = x.withColumn("prefix", prefix).join(
                cells, [x[k].eqNullSafe(cells[k]) for k in ks] + [prefix == cells["prefix"]], "left_semi"
            )
            counts = live.groupBy(*ks, "prefix", digit.alias("d")).agg(F.count(F.lit(1)).alias("c"))
        # running sums over the cells of one key: at most 2**bits rows, whatever the key's size
        listed = counts.groupBy(*ks, "prefix").agg(F.array_sort(F.collect_list(F.struct("d", "c"))).alias("h"))
        s, h = state.alias("s"), listed.alias("h")
        joined = s.join(
            h,
            [F.col(f"s.{k}").eqNullSafe(F.col(f"h.{k}")) for k in ks] + [F.col("s.prefix") == F.col("h.prefix")],
        ).select(*[F.col(f"s.{k}").alias(k) for k in ks], "n", "prob", "rank", F.col("s.prefix").alias("prefix"), "h")
        walk = F.aggregate(
            "h",
            F.struct(F.col("rank").alias("left"), F.lit(-1).cast("long").alias("at")),
            lambda a, e: F.when(a["at"] >= 0, a)
            .when(a["left"] <= e["c"], F.struct(a["left"].alias("left"), e["d"].alias("at")))
            .otherwise(F.struct((a["left"] - e["c"]).alias("left"), a["at"].alias("at"))),
        )
        state = cut(
            joined.withColumn("w", walk).select(
                *ks, "n", "prob", F.col("w.left").alias("rank"),
                F.shiftleft("prefix", bits).bitwiseOR(F.col("w.at")).alias("prefix"),
            )
        )
        shift -= bits
    back = F.col("prefix").bitwiseXOR(F.lit(_BIAS))
    out = F.timestamp_micros(back) if kind.startswith("timestamp") else back
    return state.select(*[F.col(k).alias(keys[i]) for i, k in enumerate(ks)], "prob", "n", out.alias("value"))
