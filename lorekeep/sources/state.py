"""The memory graph on disk: versioned Parquet files, one folder per table, behind a versioned pointer.

A table is a list of parts.  A commit writes new parts beside the old ones and then a new pointer version (see
``versions``), so readers see the graph before or after it and the path being read is never overwritten.  ``append`` adds rows as a
part of their own without reading the table; a table of more than ``PARTS`` parts is rewritten as one.  A commit that another
writer forestalled fails (one writer wins).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schema
from lorekeep.operators.graph import Graph
from lorekeep.sources.versions import Conflict, Versions

SENTINEL = "_SCRATCH"
#: Parts of a table from which an append rewrites it as one.
PARTS = 32


class GraphState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._versions = Versions(spark, self.path)
        self._fs, self._at = self._versions.fs, self._versions.at

    def _pointer(self) -> dict:
        n, document = self._versions.read()
        return {"version": n, "tables": document.get("tables", {})}

    def init_schema(self) -> None:
        """Create the folder; doing so again changes nothing."""
        self._fs.mkdirs(self._at(""))

    def read(self, name: str) -> DataFrame:
        parts = self._pointer()["tables"].get(name)
        if not parts:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return self.spark.read.schema(schema.TABLES[name]).parquet(*[f"{self.path}/{at}" for at in parts])

    def graph(self) -> Graph:
        return Graph(**{n: self.read(n) for n in Graph.__dataclass_fields__})

    def commit(self, tables: dict[str, DataFrame], append: dict[str, DataFrame] | None = None) -> int:
        """Make the given tables current, replaced or, under ``append``, extended by rows that are new; returns the version."""
        before = self._pointer()
        current = dict(before["tables"])
        for name, df in [*tables.items(), *(append or {}).items()]:
            want = schema.TABLES[name]
            cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields]
            rows = df.select(*cols)
            parts = [] if name in tables else list(current.get(name, []))
            if len(parts) >= PARTS:
                rows, parts = self.spark.read.schema(want).parquet(*[f"{self.path}/{p}" for p in parts]).unionByName(rows), []
            at = f"{name}/v={before['version'] + 1}-{uuid4().hex[:8]}"
            rows.write.parquet(f"{self.path}/{at}")
            current[name] = [*parts, at]
        try:
            return self._versions.write(before["version"], {"tables": current})
        except Conflict as e:
            raise RuntimeError("another writer committed meanwhile") from e

    def violations(self) -> dict[str, int]:
        """Duplicate values per unique column, where there are any."""
        found = {}
        for name, columns in schema.UNIQUE.items():
            for c in columns:
                n = schema.duplicate_keys(self.read(name), c).count()
                if n:
                    found[f"{name}.{c}"] = n
        return found

    def mark_scratch(self) -> None:
        self._fs.mkdirs(self._at(""))
        self._fs.create(self._at(SENTINEL), True).close()

    def wipe(self) -> None:
        """Empty the graph; refused for a non-empty one that is not marked as scratch."""
        if self._pointer()["tables"] and not self._fs.exists(self._at(SENTINEL)):
            raise RuntimeError(f"{self.path} holds a graph and no {SENTINEL} file")
        self._fs.delete(self._at(""), True)
        self.mark_scratch()
