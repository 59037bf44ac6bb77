"""Immutable table versions, the record changes between two of them, and runs that process only those.

A table is a folder of Parquet files that never change, deletion vectors (Parquet files of
``file, pos``) and one manifest a version that lists both. The changes between two versions
come from the manifests: rows of added files were added, rows of removed files and
newly deleted positions were removed; files that both versions hold unchanged are not read.

A run (:func:`process_changes`) reads the source version that its output's last commit names,
computes the changes up to the source's present version, and commits its result together
with that version in one manifest. The commit is one rename that fails if the version exists:
a run that breaks off before it leaves files no manifest names, so its changes are neither
lost nor done twice; of two runs at once one commits and the other starts again.

Defined cases: an empty table has a version without files; equal rows are told apart by
position, so repeated rows stay repeated; null keys never match and count as new rows;
extra columns travel along, names starting with ``_q_`` are reserved.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import create_once, filesystem, materialize, read_text

_DV = T.StructType([T.StructField("_q_file", T.StringType()), T.StructField("_q_pos", T.LongType())])


class VersionConflict(RuntimeError):
    """Another writer committed the version first."""


class VersionedTable:
    """A versioned table below ``path``; ``version()`` is -1 before the first commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- manifests -------------------------------------------------------------------------
    def version(self) -> int:
        fs, folder = filesystem(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=-1)

    def manifest(self, version: int) -> dict:
        if version < 0:
            return {"version": -1, "files": {}, "schema": None, "processed": {}}
        return json.loads(read_text(self.spark, f"{self.path}/manifests/v{version:020d}.json"))

    def _commit(self, base: int, files: dict, schema: str, processed: dict) -> int:
        body = json.dumps({"version": base + 1, "files": files, "schema": schema, "processed": processed})
        if not create_once(self.spark, f"{self.path}/manifests/v{base + 1:020d}.json", body):
            raise VersionConflict(f"version {base + 1} of {self.path}")
        return base + 1

    def _write(self, df: DataFrame, kind: str) -> dict[str, str]:
        """New immutable files: name -> path relative to the table."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        fs, jpath = filesystem(self.spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(jpath)]
        return {n: f"{folder}/{n}" for n in names if n.endswith(".parquet")}

    # -- reading ---------------------------------------------------------------------------
    def _rows(self, m: dict, names) -> DataFrame:
        """The rows of some files, deleted ones included, with ``_q_file`` and ``_q_pos``."""
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        if not names:
            return self.spark.createDataFrame([], T.StructType(schema.fields + _DV.fields))
        df = self.spark.read.schema(schema).parquet(*[f"{self.path}/{m['files'][n]['path']}" for n in sorted(names)])
        return df.select("*", F.col("_metadata.file_name").alias("_q_file"), F.col("_metadata.row_index").alias("_q_pos"))

    def _deleted(self, m: dict, names) -> DataFrame | None:
        """The deleted positions of some files; None if there are none."""
        by_vector = defaultdict(list)
        for n in names:
            if vector := m["files"][n].get("dv"):
                by_vector[vector].append(n)
        parts = [
            self.spark.read.schema(_DV).parquet(f"{self.path}/{vector}").join(
                self.spark.createDataFrame([(f,) for f in files], "_q_file string"), "_q_file", "left_semi")
            for vector, files in sorted(by_vector.items())
        ]
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, m: dict, names) -> DataFrame:
        rows, deleted = self._rows(m, names), self._deleted(m, names)
        return rows if deleted is None else rows.join(deleted, ["_q_file", "_q_pos"], "left_anti")

    def snapshot(self, version: int | None = None) -> DataFrame:
        m = self.manifest(self.version() if version is None else version)
        if m["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._live(m, list(m["files"])).drop("_q_file", "_q_pos")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """The rows added and removed after version ``since`` up to ``until``, marked in ``_q_change``."""
        old, new = self.manifest(since), self.manifest(self.version() if until is None else until)
        if new["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        old = old | {"schema": old["schema"] or new["schema"]}
        added, removed = new["files"].keys() - old["files"].keys(), old["files"].keys() - new["files"].keys()
        redone = [n for n in new["files"].keys() & old["files"].keys() if new["files"][n].get("dv") != old["files"][n].get("dv")]
        out = self._live(new, added).withColumn("_q_change", F.lit("insert"))
        if removed:
            out = out.unionByName(self._live(old, removed).withColumn("_q_change", F.lit("delete")))
        if redone:
            before, after = self._deleted(old, redone), self._deleted(new, redone)
            rows = self._rows(new, redone)
            for here, there, change in ((after, before, "delete"), (before, after, "insert")):
                if here is not None:
                    fresh = here if there is None else here.join(there, ["_q_file", "_q_pos"], "left_anti")
                    out = out.unionByName(rows.join(fresh, ["_q_file", "_q_pos"], "left_semi").withColumn("_q_change", F.lit(change)))
        return out.drop("_q_file", "_q_pos")

    # -- writing ---------------------------------------------------------------------------
    def append(self, df: DataFrame, processed: dict | None = None, base: dict | None = None) -> int:
        """Add rows; ``processed`` is stored in the same commit.

        ``base`` is the manifest that the rows were made from, by default the present one: a commit
        after it is a conflict.
        """
        m = self.manifest(self.version()) if base is None else base
        files = m["files"] | {n: {"path": p} for n, p in self._write(df, "data").items()}
        return self._commit(m["version"], files, m["schema"] or df.schema.json(), m["processed"] | (processed or {}))

    def overwrite(self, df: DataFrame, processed: dict | None = None) -> int:
        base = self.version()
        m = self.manifest(base)
        files = {n: {"path": p} for n, p in self._write(df, "data").items()}
        return self._commit(base, files, df.schema.json(), m["processed"] | (processed or {}))

    def upsert(self, df: DataFrame, key: list[str], same: Callable[[str, str], F.Column], processed: dict | None = None,
               remove_missing: bool = False) -> int:
        """Bring the table to the state ``df``, which holds every key once at most.

        A stored row with an equal key stays if ``same("stored", "given")`` holds of the two
        sides; otherwise its position goes into a deletion vector and the given row into a
        new file. Keys that ``df`` lacks stay, or go with ``remove_missing``.
        """
        base = self.version()
        m = self.manifest(base)
        if m["schema"] is None or not m["files"]:
            return self.append(df, processed)
        stored = self._live(m, list(m["files"])).alias("stored")
        # Written once: three joins read it.
        given = materialize(df, "given").alias("given")
        matched = [F.col(f"stored.{k}") == F.col(f"given.{k}") for k in key]
        keep = F.coalesce(same("stored", "given"), F.lit(False))
        unchanged = given.join(stored, [*matched, keep], "left_anti")
        gone = stored.join(given, matched, "left_anti") if remove_missing else None
        stale = stored.join(given, [*matched, ~keep], "left_semi")
        dead = (stale if gone is None else stale.unionByName(gone)).select("_q_file", "_q_pos")
        files = dict(m["files"]) | {n: {"path": p} for n, p in self._write(unchanged, "data").items()}
        written = self._write(dead.distinct(), "dv")
        dv = next(iter(written.values())).rpartition("/")[0] if written else None
        hit = set()
        if dv:
            # One row a data file: as many as the manifest lists.
            hit = {r[0] for r in self.spark.read.schema(_DV).parquet(f"{self.path}/{dv}").select("_q_file").distinct().collect()}
        if hit:
            old = self._deleted(m, hit)
            if old is not None:
                both = self.spark.read.schema(_DV).parquet(f"{self.path}/{dv}").unionByName(old)
                dv = next(iter(self._write(both, "dv").values())).rpartition("/")[0]
            files |= {n: files[n] | {"dv": dv} for n in hit}
        return self._commit(base, files, m["schema"], m["processed"] | (processed or {}))


def process_changes(source: VersionedTable, output: VersionedTable, run: Callable[[DataFrame], DataFrame], name: str = "source", tries: int = 5) -> int:
    """Run ``run`` over the changes of ``source`` that ``output`` has not seen; append its result.

    Returns the source version that ``output`` has now processed. The version is part of the
    output's commit, so a failure at any moment leaves both as they were. What was processed and the
    version that the commit follows come from one manifest of the output: a run that commits in
    between makes this commit a conflict, and the changes are looked at anew.
    """
    for _ in range(tries):
        base = output.manifest(output.version())
        seen, until = base["processed"].get(name, -1), source.version()
        if seen >= until:
            return seen
        try:
            output.append(run(source.changes(seen, until)), {name: until}, base)
            return until
        except VersionConflict:
            continue
    raise VersionConflict(f"gave up after {tries} tries")
