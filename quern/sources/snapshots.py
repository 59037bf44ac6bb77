"""Snapshots of a set of tables: folders that never change, and pointers that name those of a version.

A table is written whole into a folder of its own before the pointer of the next version is made by one rename, so readers
see the old or the new state and never a part. Two writers never share a folder; of two that make the same
version one fails. Tables not given keep their folder, nothing is copied. Old snapshots stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import create_once, filesystem, read_text


class SnapshotConflict(RuntimeError):
    """Another writer saved the version first."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The present version; -1 if nothing was saved."""
        fs, folder = filesystem(self.spark, f"{self.path}/current")
        if not fs.exists(folder):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=-1)

    def _tables(self, version: int) -> dict[str, str]:
        return json.loads(read_text(self.spark, f"{self.path}/current/{version}")) if version >= 0 else {}

    def write(self, name: str, df: DataFrame) -> str:
        """Write a table that no version names yet; its folder, relative to the store."""
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def save(self, tables: dict[str, DataFrame | str]) -> int:
        """Make the next version of tables and of folders that :meth:`write` gave; others keep what they have."""
        now = self.version()
        folders = {name: t if isinstance(t, str) else self.write(name, t) for name, t in tables.items()}
        if not create_once(self.spark, f"{self.path}/current/{now + 1}", json.dumps(self._tables(now) | folders)):
            raise SnapshotConflict(f"version {now + 1} of {self.path}")
        return now + 1

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of the present (or given) version; None if there is none."""
        folder = self._tables(self.version() if version is None else version).get(name)
        return self.read(folder) if folder else None
