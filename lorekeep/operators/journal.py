"""Run journal and rollback, relational: one row per changed property, oldest value wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schema

#: (run_id, seq, op, table, id, prop, prev): op ``set`` restores a property, ``relink`` an edge kept as JSON in prev.
CHANGES = "run_id string, seq int, op string, table string, id string, prop string, prev string"
_SETTABLE, _LINKABLE = ("memory", "entity"), ("mentions", "linked_to")


def changes_between(run_id: str, seq: int, name: str, before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Changed properties of rows that are in both versions of a node table, with their previous values as JSON."""
    props = [f.name for f in schema.TABLES[name].fields if f.name not in (key, "embedding", "editorrun")]
    b = before.select(key, *[F.to_json(F.struct(F.col(p).alias("v"))).alias(f"b_{p}") for p in props])
    a = after.select(key, *[F.to_json(F.struct(F.col(p).alias("v"))).alias(f"a_{p}") for p in props])
    stacked = b.join(a, key).select(F.col(key).alias("id"), F.explode(F.array(*[F.struct(F.lit(p).alias("prop"), F.col(f"b_{p}").alias("prev"), F.col(f"a_{p}").alias("new")) for p in props])).alias("c"))
    diff = stacked.where("c.prev <> c.new")
    return diff.select(F.lit(run_id).alias("run_id"), F.lit(seq).alias("seq"), F.lit("set").alias("op"), F.lit(name).alias("table"), "id", F.col("c.prop").alias("prop"), F.col("c.prev").alias("prev"))


def removed_edges(run_id: str, seq: int, name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges of the earlier version that the later one lacks, as relink operations."""
    keys = schema.KEYS[name]
    gone = before.join(after.select(*keys), keys, "left_anti")
    return gone.select(F.lit(run_id).alias("run_id"), F.lit(seq).alias("seq"), F.lit("relink").alias("op"), F.lit(name).alias("table"), F.concat_ws("|", *keys).alias("id"), F.lit(None).cast("string").alias("prop"), F.to_json(F.struct(*before.columns)).alias("prev"))


def legal_changes(changes: DataFrame) -> DataFrame:
    """Changes whose operation, table and property may be undone; anything else in a journal is ignored."""
    node = (F.col("op") == "set") & F.col("table").isin(*_SETTABLE)
    ok = F.lit(False)
    for t in _SETTABLE:
        ok = ok | ((F.col("table") == t) & F.col("prop").isin(*[f.name for f in schema.TABLES[t].fields]))
    return changes.where((node & ok) | ((F.col("op") == "relink") & F.col("table").isin(*_LINKABLE)))


def oldest_values(changes: DataFrame, run_id: str) -> DataFrame:
    """(table, id, prop, prev): what newest-first replay leaves: the oldest recorded value of each property."""
    c = legal_changes(changes).where((F.col("run_id") == run_id) & (F.col("op") == "set"))
    return c.groupBy("table", "id", "prop").agg(F.min_by("prev", "seq").alias("prev"))


def refuse(runs: DataFrame, run_id: str, force: bool = False) -> str | None:
    """Why a run may not be rolled back: unknown, rolled back already, or followed by others (unless forced)."""
    this = runs.where(F.col("id") == run_id).select("status", "startedat").first()
    if this is None:
        return "unknown run"
    if this.status == "rolled_back":
        return "already rolled back"
    if not force and not runs.where((F.col("startedat") > F.lit(this.startedat)) & (F.col("status") != "rolled_back")).isEmpty():
        return "later runs exist"
    return None


def rolled_back(tables: dict[str, DataFrame], changes: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """The graph's tables as before the run, but for what others changed since and this run did not touch."""
    out = {}
    olds = oldest_values(changes, run_id)
    for name, df in tables.items():
        new = df
        if name in _SETTABLE:
            own = olds.where(F.col("table") == name).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("prop", "prev"))).alias("__old"))
            new = new.join(own, "id", "left")
            cols = []
            for f in df.schema.fields:
                if f.name in ("id", "embedding", "editorrun"):
                    cols.append(F.col(f.name))
                    continue
                old = F.from_json(F.col("__old")[f.name], f"v {f.dataType.simpleString()}")["v"]
                cols.append(F.when(F.col("__old")[f.name].isNotNull(), old).otherwise(F.col(f.name)).alias(f.name))
            new = new.select(*cols)
        if "editorrun" in df.columns:
            new = new.where(F.coalesce(F.col("editorrun") != run_id, F.lit(True)))
        if name in _LINKABLE:
            back = legal_changes(changes).where((F.col("run_id") == run_id) & (F.col("op") == "relink") & (F.col("table") == name))
            back = back.select(F.from_json("prev", df.schema).alias("e")).select("e.*")
            keys = schema.KEYS[name]
            new = new.unionByName(back.dropDuplicates(keys).join(new.select(*keys), keys, "left_anti").select(*df.columns))
        out[name] = new
    return out
