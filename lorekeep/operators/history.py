"""Full history of changing entity attributes from updates and snapshots.

Method: presence bitmaps.  Within one (entity, attribute) the accepted rows are put
in order of start; row ``i`` owns bit ``2i`` (present at that snapshot) and bit
``2i + 1`` (the value still holds when the next snapshot begins).  Every distinct
value of the attribute has one bitmap over these positions; a maximal run of
consecutive bits is one version, and a gap (an end date before the next snapshot)
is simply an unset odd bit.

Scale: rows are range-partitioned by (entity, attribute, start), so a key that holds
a third of all rows is spread over many partitions.  Bitmaps are local to one
partition; the runs that touch a partition's border are stitched by a second, tiny
step over at most two rows per key and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.runtime import clean, cut, partitions

_VERSIONS = (
    "ent string, att string, first_us long, vhash string, value string, end_us long, next_us long, "
    "pid int, is_first boolean, is_last boolean, edge boolean"
)


def normalise_value(col):
    """Lower-cased, white space collapsed, trimmed, closing ``.`` and ``!`` dropped."""
    flat = F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(flat, r"[.!\s]+$", ""))


def runs_of(bits: int) -> Iterator[tuple[int, int]]:
    """(first, last) of every maximal run of set bits, lowest first."""
    starts, ends = bits & ~(bits << 1), bits & ~(bits >> 1)
    while starts:
        lo, hi = starts & -starts, ends & -ends
        yield lo.bit_length() - 1, hi.bit_length() - 1
        starts ^= lo
        ends ^= hi


def _versions_of_key(starts: list[int], hashes: list[str], ends: list[int | None]) -> list[tuple[int, int]]:
    """(first row, last row) of each version, from one bitmap per value, in order of start."""
    maps: dict[str, int] = {}
    n = len(starts)
    for i in range(n):
        bits = 1 << 2 * i
        if i + 1 < n and (ends[i] is None or ends[i] >= starts[i + 1]):
            bits |= 1 << 2 * i + 1
        maps[hashes[i]] = maps.get(hashes[i], 0) | bits
    out = []
    for bits in maps.values():
        for lo, hi in runs_of(bits):
            first, last = lo // 2, hi // 2
            # a set odd bit at the end of a run whose next row has another value adds nothing
            out.append((first, last))
    return sorted(out)


_NEVER = (1 << 63) - 1
#: Rows of one key turned into bitmaps at a time; longer keys are taken in such blocks and stitched alike.
BLOCK = 4096


def _local_versions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Versions of the keys of one partition, which is sorted by (ent, att, start_us).

    ``edge`` marks the first and the last version of the partition's first and last key: only these can go on in
    another partition, so at most four rows of a partition carry it.
    """
    columns = ["ent", "att", "first_us", "vhash", "value", "end_us", "next_us", "pid", "is_first", "is_last"]
    key: tuple | None = None
    held: list[tuple] = []
    carry: list | None = None  # the key's latest version, open for more rows
    carry_first = n_keys = 0
    out: list[list] = []

    def flush() -> None:
        nonlocal carry, carry_first
        starts, hashes, ends = [r[0] for r in held], [r[1] for r in held], [r[3] for r in held]
        for first, last in _versions_of_key(starts, hashes, ends):
            if carry is not None:
                if carry[1] == hashes[first] and (carry[3] is None or carry[3] >= starts[first]):
                    carry[3] = ends[last]
                    continue
                out.append([*key, *carry[:4], starts[first], held[0][4], carry_first, False, n_keys])
                carry_first = False
            else:
                carry_first = True
            carry = [starts[first], hashes[first], held[first][2], ends[last]]
        held.clear()

    def close() -> None:
        nonlocal carry
        pid = held[0][4]
        flush()
        out.append([*key, *carry[:4], None, pid, carry_first, True, n_keys])
        carry = None

    def frame(rows: list[list], last_key: int | None) -> pd.DataFrame:
        pdf = pd.DataFrame([r[:10] for r in rows], columns=columns)
        pdf["edge"] = [(r[8] or r[9]) and r[10] in (0, last_key) for r in rows]
        return pdf.astype({"first_us": "int64", "end_us": "Int64", "next_us": "Int64", "is_first": bool, "is_last": bool, "edge": bool})

    for pdf in batches:
        for ent, att, start, h, value, end, pid in zip(
            pdf.ent.astype(object).where(pdf.ent.notna(), None), pdf.att.astype(object).where(pdf.att.notna(), None),
            pdf.start_us, pdf.vhash, pdf.value, pdf.end_us, pdf.pid, strict=True,
        ):
            if key is not None and (ent, att) != key:
                close()
                n_keys += 1
            elif len(held) >= BLOCK:
                flush()
            key = (ent, att)
            held.append((int(start), h, value, None if end == _NEVER else int(end), pid))
        # rows of the latest key stay back: whether it is the last one is known only later
        ready = [r for r in out if r[10] != n_keys - 1]
        if len(ready) > 50_000:
            out = [r for r in out if r[10] == n_keys - 1]
            yield frame(ready, None)
    if held:
        close()
    if out:
        yield frame(out, n_keys)


def attribute_history(
    updates: DataFrame,
    entity: str = "entity_id",
    attribute: str = "attribute",
    content: str = "content",
    valid_from: str = "validfrom",
    valid_to: str = "validto",
    recorded: str = "timestamp",
    status: str | None = "status",
    tie: str = "update_id",
) -> DataFrame:
    """One row per version: (entity, attribute, value, valid_from, valid_to); open versions have a null end.

    * Rows whose cleaned status is ``suppressed`` and rows with null or blank content count for nothing.
    * A row starts at ``valid_from``, else at ``recorded``; rows without either cannot be placed and are left out.
    * An end not after the start counts as absent.
    * Of the rows of one key with the same start the latest recorded counts, then the larger ``tie``.
    * Repeated rows, late rows and rows out of order therefore change nothing.  Null entities or attributes form
      a key of their own.  An empty table gives an empty result; other columns are ignored.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = updates.select(
        F.col(entity).cast("string").alias("ent"),
        F.col(attribute).cast("string").alias("att"),
        F.col(content).alias("value"),
        F.coalesce(us(valid_from), us(recorded)).alias("start_us"),
        us(valid_to).alias("end_us"),
        us(recorded).alias("rec_us"),
        F.col(tie).alias("tie"),
        (clean(F.col(status)) if status else F.lit("")).alias("st"),
    ).where("coalesce(st, '') <> 'suppressed' and start_us is not null").where(F.col("value").rlike(r"\S"))
    rows = rows.withColumn("end_us", F.when(F.col("end_us") > F.col("start_us"), F.col("end_us")))
    # one row per start; max_by combines on the map side, so a hot start costs one row per task
    latest = (
        rows.groupBy("ent", "att", "start_us")
        .agg(F.max_by(F.struct("value", "end_us"), F.struct("rec_us", "tie")).alias("r"))
        .select("ent", "att", "start_us", "r.value", "r.end_us")
        .withColumn("vhash", F.sha2(normalise_value(F.col("value")), 256))
    )
    n = partitions(updates.sparkSession)
    placed = cut(
        latest.withColumn("end_us", F.coalesce("end_us", F.lit(_NEVER)))  # a long with nulls would pass through floats
        .repartitionByRange(n, "ent", "att", "start_us")
        .sortWithinPartitions("ent", "att", "start_us")
        .withColumn("pid", F.spark_partition_id())
    )
    found = cut(placed.mapInPandas(_local_versions, _VERSIONS))
    done = found.where("not edge").select("ent", "att", "value", "first_us", "end_us", "next_us")
    return _named(done.unionByName(_stitched(found.where("edge"))))


def _stitched(edges: DataFrame) -> DataFrame:
    """Versions that touch a partition's border, joined across partitions.

    The input has at most four rows per partition, so the windows below are small whatever the key's size.
    """
    w = Window.partitionBy("ent", "att").orderBy("pid", "first_us")
    e = (
        edges.withColumn("pv_hash", F.lag("vhash").over(w))
        .withColumn("pv_end", F.lag("end_us").over(w))
        .withColumn("pv_pid", F.lag("pid").over(w))
        .withColumn("after_us", F.coalesce("next_us", F.lead("first_us").over(w)))
    )
    goes_on = (
        F.col("is_first")
        & (F.col("pv_pid") < F.col("pid"))
        & (F.col("pv_hash") == F.col("vhash"))
        & (F.col("pv_end").isNull() | (F.col("pv_end") >= F.col("first_us")))
    )
    e = e.withColumn("ver", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    return (
        e.groupBy("ent", "att", "ver")
        .agg(
            F.min_by("value", "first_us").alias("value"),
            F.min("first_us").alias("first_us"),
            F.max_by(F.struct("end_us", "after_us"), "first_us").alias("z"),
        )
        .select("ent", "att", "value", "first_us", F.col("z.end_us").alias("end_us"), F.col("z.after_us").alias("next_us"))
    )


def _named(v: DataFrame) -> DataFrame:
    return v.select(
        F.col("ent").alias("entity_id"),
        F.col("att").alias("attribute"),
        "value",
        F.timestamp_micros("first_us").alias("valid_from"),
        F.timestamp_micros(F.least("end_us", "next_us")).alias("valid_to"),
    )
