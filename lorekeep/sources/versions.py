"""Small versioned documents in a shared folder.

Every version is a file of its own that is renamed into place, which fails if another writer has taken the number; the
highest one is current.  A reader therefore sees the old version or the new one, never none and never half of one.
"""

from __future__ import annotations

import json
import re
from uuid import uuid4

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Versions:
    #: Versions that stay for readers that have just listed them.
    KEPT = 4

    def __init__(self, spark: SparkSession, path: str, name: str = "pointer"):
        self.path, self.name = path.rstrip("/"), name
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self._conf)

    def at(self, name: str):
        """The Hadoop path of a file or folder below this one."""
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def listed(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        if not self.fs.exists(self.at("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(""))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{self.name}-(\d{{12}})\.json", n)))

    def read(self) -> tuple[int, dict]:
        """(number, document) of the current version; (0, {}) if there is none."""
        found = self.listed()
        if not found:
            return 0, {}
        stream = self.fs.open(self.at(f"{self.name}-{found[-1]:012}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return found[-1], json.loads(text)

    def write(self, after: int, document: dict) -> int:
        """Make ``document`` version ``after + 1``; raises ``Conflict`` if there is one."""
        fs = self._jvm.org.apache.hadoop.fs
        tmp, final = self.at(f".{self.name}-{uuid4().hex}"), self.at(f"{self.name}-{after + 1:012}.json")
        out = self.fs.create(tmp, False)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        strict = self._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            if after + 1 <= max(self.listed(), default=0):
                raise Conflict(f"version {after + 1} of {self.path}/{self.name} exists")
            fs.FileContext.getFileContext(final.toUri(), self._conf).rename(tmp, final, strict)
        except Exception as e:
            self.fs.delete(tmp, False)
            if isinstance(e, Conflict) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.path}/{self.name} exists") from e
            raise
        for old in self.listed()[: -self.KEPT]:
            self.fs.delete(self.at(f"{self.name}-{old:012}.json"), False)
        return after + 1
