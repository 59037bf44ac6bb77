"""Problem 8: filling containers of fixed capacity with items.

Bulk-synchronous best fit. The pieces are dealt out evenly to groups of bounded size, whatever their keys and sizes, and every group is packed by a task of
its own: its items and the gaps of its open containers are kept sorted by size, and in each step all items look for their
successor among the gaps, the smallest gap that holds them, in one sweep. Several items that meet at one gap are
told apart by rank: the first takes it, the others the next gaps, up to where larger items claim. The gaps shrink, and the
next step begins. When no item fits any more, as many containers are opened as the rest needs at least, the largest items first.

As groups are large against a container, what is lost at their ends is small: a container or two of many thousands.

Defined cases: an item larger than the capacity is cut into full pieces and a rest, a full piece is a container by itself; items of size
zero take no room and are spread over the containers of their group; null sizes count as zero; items given twice
are two items; no items give no rows. ``container`` is unique over all groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CAPACITY = 2048
#: Pieces that one task packs, about.
GROUP = 50_000
#: Container numbers of a group start at its number times this.
_NUMBERS = 1 << 32


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item (sizes from 1 to the capacity) and the number of containers."""
    container = np.full(len(sizes), -1, np.int64)
    full = np.flatnonzero(sizes == capacity)
    container[full] = np.arange(len(full))
    total = len(full)
    left = np.flatnonzero(sizes < capacity)
    left = left[np.argsort(-sizes[left], kind="stable")]  # the range sort of the items
    gaps, owners = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(left):
        need = sizes[left]
        place = np.searchsorted(gaps, need)  # each item's successor among the gaps; falls with the sizes
        first = np.searchsorted(-place, -place)  # the first item that meets there
        claim = place + np.arange(len(left)) - first
        # Larger items claim from their own place on: an item may go no further than the nearest of those.
        starts = np.unique(place)
        bound = np.append(starts[1:], len(gaps))[np.searchsorted(starts, place)]
        won = claim < np.minimum(bound, len(gaps))
        if won.any():
            at = claim[won]
            container[left[won]] = owners[at]
            gaps[at] -= need[won]
            left = left[~won]
        else:
            more = min(len(left), -(-int(need.sum()) // capacity))
            opened = left[:more]
            container[opened] = total + np.arange(more)
            gaps, owners = np.concatenate([gaps, capacity - sizes[opened]]), np.concatenate([owners, container[opened]])
            total += more
            left = left[more:]
        open_ = np.flatnonzero(gaps >= (sizes[left[-1]] if len(left) else capacity + 1))  # a gap below the least item is closed
        order = open_[np.argsort(gaps[open_], kind="stable")]
        gaps, owners = gaps[order], owners[order]
    return container, total


def fill_containers(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``key, piece_no, start, size, container``: one row for each piece; ``start`` is its offset in the item."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = sizes.select(F.col(key).alias("_key"), n.alias("_n")).select(
        "_key", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0)))).alias("piece_no"))
    pieces = pieces.select("_key", "piece_no", F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece_no").cast("long") * capacity).alias("_size"))
    pieces = materialize(pieces.withColumn("_no", F.monotonically_increasing_id()), "items")
    groups = max(1, -(-pieces.count() // group))

    def pack(table: pa.Table) -> pa.Table:
        no = table.column("_no").to_numpy()
        table = table.take(pa.array(np.argsort(no, kind="stable")))
        sz = table.column("_size").to_numpy()
        container = np.zeros(len(sz), np.int64)
        some = sz > 0
        container[some], total = best_fit(sz[some], capacity)
        container[~some] = np.arange(int((~some).sum())) % max(total, 1)
        piece = table.column("piece_no").to_numpy()
        start = piece.astype(np.int64) * capacity
        return pa.table({key: table.column("_key"), "piece_no": pa.array(piece, pa.int32()), "start": start, "size": sz, "container": container + table.column("_group")[0].as_py() * _NUMBERS})

    # Dealt out by a hash of the row's number: even, whatever keys or sizes repeat.
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_no"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, f"{key} long, piece_no int, start long, size long, container long")


def fill_rate(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens and the share of the room that is used."""
    by = placed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    return by.agg(
        F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"), F.max("used").alias("fullest"))
