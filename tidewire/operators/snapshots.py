"""Tables that change as one: a folder of written parts, and version files that say which parts make up each table.

A change writes its parts first and its version file last, by a rename, so a reader sees a whole version or the one before, and
a job that is lost halfway leaves parts that no version names. Folding writes a table's parts as one; a vacuum removes old
versions with the parts that only they name. One writer at a time: a commit on a version that is no longer the last is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class StaleVersion(Exception):
    """Another writer has committed meanwhile."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = self._path("")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        where = self._path("_versions")
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> dict:
        """version, tables (name -> parts), marks; an empty state of version 0 where nothing was committed."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "marks": {}}
        file = self._path(f"_versions/{known[-1] if version is None else version:012d}.json")
        stream = self.fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, schema: str | T.StructType, version: int | None = None) -> DataFrame:
        """The table as of a version (the last one by default); without parts an empty one."""
        parts = self.state(version)["tables"].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in parts])

    def write_part(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, marks: dict | None = None, base: dict | None = None) -> int:
        """Write the parts, then make them visible together; ``marks`` are kept beside the tables. ``base`` is the state that the
        change was worked out from (the last one by default)."""
        base = base or self.state()
        tables = {k: list(v) for k, v in base["tables"].items()}
        for name, rows in (append or {}).items():
            tables[name] = [*tables.get(name, []), self.write_part(name, rows)]
        for name, rows in (replace or {}).items():
            tables[name] = [self.write_part(name, rows)]
        return self._publish({"version": base["version"] + 1, "tables": tables, "marks": base["marks"] | (marks or {})})

    def _publish(self, state: dict) -> int:
        target, draft = self._path(f"_versions/{state['version']:012d}.json"), self._path(f"_versions/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise StaleVersion(f"version {state['version']} is there already")
        return state["version"]

    def fold(self, name: str, files: int = 1) -> int:
        """The table's parts as one of so many files."""
        base = self.state()
        parts = [f"{self.folder}/{p}" for p in base["tables"][name]]
        return self.commit(replace={name: self.spark.read.parquet(*parts).repartition(files)}, base=base)

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last versions, and the parts that none of these names; how many parts went. Not while a writer is at work."""
        known = self.versions()
        kept = known[-keep:]
        named = {p for v in kept for parts in self.state(v)["tables"].values() for p in parts}
        for v in known[:-keep]:
            self.fs.delete(self._path(f"_versions/{v:012d}.json"), False)
        gone = 0
        for table in self.fs.listStatus(self._path("")):
            name = table.getPath().getName()
            if table.isDirectory() and name != "_versions":
                for part in self.fs.listStatus(table.getPath()):
                    if f"{name}/{part.getPath().getName()}" not in named:
                        gone += self.fs.delete(part.getPath(), True)
        return gone
