"""File changes as a stream: filter, debounce, and apply batches.

Defined cases: events of folders, with a null path or an ignored one vanish; of a path's events the last by time counts, of
equal times a deletion; a move is a deletion of the old path and an upsert of the new one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import CHANGE
from ..sources.scan import should_process

DEBOUNCE = "5 seconds"


def change_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Changes written as JSON files into a folder, as a stream of ``path, change_type, event_time``."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", max_files).json(folder)


def exploded_moves(events: DataFrame) -> DataFrame:
    """``path, change_type, event_time`` from ``event, path, dest, is_directory, event_time``."""
    one = lambda p, c: F.struct(p.alias("path"), F.lit(c).alias("change_type"))
    parts = F.when(F.col("event") == "moved", F.array(one(F.col("path"), "delete"), one(F.col("dest"), "upsert"))).when(
        F.col("event") == "deleted", F.array(one(F.col("path"), "delete"))).when(F.col("event").isin("created", "modified"), F.array(one(F.col("path"), "upsert")))
    return events.where(~F.coalesce("is_directory", F.lit(False))).select(F.explode(parts).alias("x"), "event_time").select("x.path", "x.change_type", "event_time").where("path is not null")


def accepted(changes: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    return changes.where(should_process(F.col("path"), suffixes))


def last_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """The last change of every path (and of ``keys``)."""
    order = F.struct("event_time", (F.col("change_type") == "delete").alias("d"))
    return changes.groupBy(*keys, "path").agg(F.max_by("change_type", order).alias("change_type"), F.max("event_time").alias("event_time"))


_PENDING = "paths array<string>, kinds array<string>, times array<long>"


def debounced(changes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """``path, change_type, event_time``: the last change of each path, given out after a pause of ``gap`` without any.

    On a stream the pause is one global timer by the clock, as an editor's bursts are to go out together. What waits is one
    entry a path: changes are merged before the state sees them and in it. A finished table is cut into sessions instead.
    """
    if not changes.isStreaming:
        return batch_sessions(changes, gap).drop("batch")
    wait = _micros(gap) // 1000

    def merge(key, parts, state):
        at = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            rows = sorted(at.items())
            yield pd.DataFrame({"path": [p for p, _ in rows], "change_type": [k for _, (k, _) in rows], "event_time": pd.to_datetime([t for _, (_, t) in rows], unit="us")})
            return
        for part in parts:
            stamps = part["event_time"].astype("datetime64[us]").astype("int64")
            for path, kind, t in zip(part["path"], part["change_type"], stamps):
                if path not in at or (t, kind == "delete") >= (at[path][1], at[path][0] == "delete"):
                    at[path] = (kind, int(t))
        if at:
            state.update((list(at), [k for k, _ in at.values()], [t for _, t in at.values()]))
            state.setTimeoutDuration(max(wait, 1))

    out = changes.select(F.lit(0).alias("k"), "path", "change_type", "event_time").groupBy("k").applyInPandasWithState(
        merge, "path string, change_type string, event_time timestamp", _PENDING, "append", "ProcessingTimeTimeout")
    return out


def batch_sessions(changes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """Sessions of a finished table of changes.

    The gaps are found by time slots: each slot (much longer than the gap) is searched by its own task, and only its
    first and last event meet those of other slots, so no task sorts all events.
    """
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    width = 3_600_000_000
    gap_us = F.lit(_micros(gap))
    rows = changes.where("event_time is not null").withColumn("_t", micros).withColumn("_slot", F.floor(F.col("_t") / width))
    inner = Window.partitionBy("_slot").orderBy("_t")
    rows = rows.withColumn("_before", F.lag("_t").over(inner))
    ends = rows.groupBy("_slot").agg(F.max("_t").alias("_end"))
    # One row a slot of an hour: the last event before each slot.
    earlier = ends.withColumn("_earlier", F.max("_end").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))).select("_slot", "_earlier")
    rows = rows.join(earlier, "_slot").withColumn("_new", (F.coalesce("_before", "_earlier").isNull() | (F.col("_t") - F.coalesce("_before", "_earlier") > gap_us)).cast("int"))
    rows = rows.withColumn("_within", F.sum("_new").over(inner.rangeBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy("_slot").agg(F.sum("_new").alias("_n"))
    offset = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_slot", "_offset")
    out = rows.join(offset, "_slot").withColumn("batch", F.col("_within") + F.col("_offset"))
    return last_changes(out, "batch")


def _micros(gap: str) -> int:
    n, unit = gap.split()
    scale = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
    return int(float(n) * scale[unit.rstrip("s")])


def corrected(changes: DataFrame, existing: DataFrame) -> DataFrame:
    """The change type by whether the file exists when the batch is applied."""
    there = existing.select("path").distinct().withColumn("_there", F.lit(True))
    return changes.join(there, "path", "left").select("path", F.when(F.col("_there"), "upsert").otherwise("delete").alias("change_type"))


def start(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = DEBOUNCE, debounce: bool = False):
    """Run ``apply`` on every micro-batch with the last change of each path; the checkpoint keeps what is pending.

    With ``debounce`` a batch goes out only after a pause of ``gap`` without changes; otherwise the trigger's interval parts batches.
    """
    rows = debounced(accepted(changes), gap) if debounce else accepted(changes)

    def each(batch: DataFrame, number: int) -> None:
        todo = last_changes(batch.select("path", "change_type", "event_time"))
        if not todo.isEmpty():
            apply(todo, number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
