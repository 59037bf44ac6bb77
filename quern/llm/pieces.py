"""Problem 1: oversized items in pieces under a limit, cut at natural boundaries, with overlap.

An item's tokens give prefix sums of offsets, its line and statement ends a sorted array of
boundaries. Each piece ends at the last boundary at or under its limit (binary search), failing that at
the last token end, failing that hard at the limit; the next piece starts ``overlap``
characters before that end. Lengths are in Unicode characters.

Defined cases: an item of at most ``limit`` characters or null gives no pieces here; pieces
without their overlap joined in order give the item back; a hard cut never parts ``\\r\\n``;
repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import current_classes, current_functions

LIMIT, OVERLAP = 2000, 200

_TOKEN = re.compile(r"\w+|\r\n|\s|[^\w\s]")
#: A line's end, or a statement's: ``;``, ``{`` or ``}`` before white space.
_END = re.compile("\r\n|[\n\r\u2028\u2029]|[;{}](?=\\s)")


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of each piece of ``text``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    boundaries = [m.end() for m in _END.finditer(text)]
    tokens = None
    out, start = [], 0
    while n - start > limit:
        most, least = start + limit, start + overlap
        i = bisect_right(boundaries, most) - 1
        if i >= 0 and boundaries[i] > least:
            end = boundaries[i]
        else:
            if tokens is None:
                tokens = list(accumulate(map(len, _TOKEN.findall(text))))
            i = bisect_right(tokens, most) - 1
            end = tokens[i] if i >= 0 and tokens[i] > least else most
            if end == most and end > least + 1 and text[end - 1] == "\r" and text[end: end + 1] == "\n":
                end -= 1
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_items(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key, piece_no, start, end, piece`` of the items longer than ``limit``; short ones are dropped in the scan's stage."""
    schema = f"{key} long, piece_no int, start int, `end` int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                for i, (a, b) in enumerate(cuts(t, limit, overlap)):
                    rows.append((k, i, a, b, t[a:b]))
                    size += b - a
                if size > 8_000_000:  # very long items: hand over what is ready
                    yield _batch(rows, key)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, key)

    return df.select(key, text).where(F.length(text) > limit).mapInArrow(run, schema)


def _batch(rows: list[tuple], key: str) -> pa.RecordBatch:
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "piece_no", "start", "end", "piece"])


def code_pieces(functions: DataFrame, classes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the current functions and classes whose code exceeds the limit.

    Only code beyond the limit enters the shuffle that finds the current rows.
    """
    long_code = F.when(F.length("code") > limit, F.col("code"))
    rows = current_functions(functions, code=long_code).select("seq", "code")
    rows = rows.unionByName(current_classes(classes, code=long_code).select("seq", "code"))
    return split_items(rows, "seq", "code", limit, overlap)


def joined(pieces: DataFrame, key: str = "seq", overlap: int = OVERLAP) -> DataFrame:
    """``key, text``: each item put together again from its pieces, without what they repeat."""
    fresh = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", overlap + 1, 2**31 - 1))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("fresh"))))
    return pieces.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["fresh"]), "").alias("text"))
