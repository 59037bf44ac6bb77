"""Problem 3: only the functions that are new or changed since the last successful run.

The state that successful runs left becomes a version of a table, the current functions
its next version (changed rows by deletion vector and new file, see ``versions``), and
the functions to process are the rows that the difference of the two versions adds.

Defined cases: a run without any attempt that ended in ``ok`` or ``success`` left no state;
of equal attempts the one that finished last counts, then the greater status; a null hash or
null code never counts as unchanged; empty tables give no or all functions; rows of one
identity count once, by their current row; functions whose id is null (null repo, path or
name) are always to be processed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import current_functions, entity_id, latest, tidy
from ..session import fresh_path
from .versions import VersionedTable, process_changes

#: The statuses of a successful run.
SUCCESS = ("ok", "success")


def successful_runs(runs: DataFrame) -> DataFrame:
    """``run_id`` of the runs whose highest attempt succeeded."""
    rows = runs.select("run_id", "attempt", "finished_at", tidy(F.col("status")).alias("status")).where("run_id is not null")
    order = [F.col("attempt").desc_nulls_last(), F.col("finished_at").desc_nulls_last(), F.col("status").desc_nulls_last()]
    return latest(rows, ["run_id"], order).where(F.col("status").isin(*SUCCESS)).select("run_id")


def stored_state(vectors: DataFrame, runs: DataFrame) -> DataFrame:
    """``id, hash``: what successful runs left, the latest row of each id."""
    rows = vectors.select("id", "run_id", "updated_at", "vec_id", tidy(F.col("content_hash")).alias("hash")).where("id is not null")
    rows = rows.join(successful_runs(runs), "run_id", "left_semi")
    return latest(rows, ["id"], [F.col("updated_at").desc_nulls_last(), F.col("vec_id").desc()]).select("id", "hash")


def current_state(functions: DataFrame) -> DataFrame:
    """``id, hash`` of the current functions."""
    rows = current_functions(functions, hash=F.sha2(F.col("code"), 256))
    return rows.select(entity_id(F.col("repo"), F.col("clean_path"), F.col("class_name"), F.col("name")).alias("id"), "hash")


def function_changes(spark: SparkSession, functions: DataFrame, vectors: DataFrame, runs: DataFrame) -> DataFrame:
    """``id, hash, change`` between the stored state and the current functions."""
    table = VersionedTable(spark, fresh_path(spark, "states"))
    before = table.append(stored_state(vectors, runs))
    after = table.upsert(current_state(functions), ["id"], lambda a, b: F.col(f"{a}.hash") == F.col(f"{b}.hash"))
    return table.changes(before, after).withColumnRenamed("_q_change", "change")


class Interrupted(RuntimeError):
    """A run that broke off between its files and its commit."""


def processed_functions(spark: SparkSession, functions: DataFrame, vectors: DataFrame, runs: DataFrame) -> DataFrame:
    """``id, hash``: the functions that incremental runs over a growing table process.

    Version 0 of the source is the state that successful runs left; versions 1, 2 and 3 bring the functions modified up
    to a third and two thirds of the time between the first and the last change, and all of them. A run processes
    version 1; the run over version 2 breaks off before its commit; the last one finds by the manifests
    what versions 2 and 3 changed. A row that one version took away and a later one gave back unchanged, both since
    the last commit, is not processed. Rows without a time are in every version.
    """
    source, output = VersionedTable(spark, fresh_path(spark, "source")), VersionedTable(spark, fresh_path(spark, "output"))
    same = lambda a, b: F.col(f"{a}.hash") == F.col(f"{b}.hash")
    first = source.append(stored_state(vectors, runs))
    output.append(spark.createDataFrame([], "id string, hash string"), {"source": first})

    def run(changes: DataFrame) -> DataFrame:
        rows = changes.where("_q_change = 'insert'").drop("_q_change")
        return rows.join(changes.where("_q_change = 'delete'").drop("_q_change"), ["id", "hash"], "left_anti")

    def breaks_off(changes: DataFrame) -> DataFrame:
        output._write(run(changes), "data")
        raise Interrupted

    at = F.unix_micros(F.col("modified_at").cast("timestamp"))
    low, high = functions.agg(F.min(at), F.max(at)).first()
    for third, job in ((1, run), (2, breaks_off), (3, run)):
        part = functions
        if third < 3 and low is not None:
            part = functions.where(at.isNull() | (at <= F.lit(low + (high - low) * third // 3)))
        source.upsert(current_state(part), ["id"], same)
        try:
            process_changes(source, output, job)
        except Interrupted:
            pass
    return output.snapshot()
