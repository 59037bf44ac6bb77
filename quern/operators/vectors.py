"""The vector table: search, lookup, counts, upserts and deletions.

Searching filters first (equality and prefix reach the Parquet scan), scores Arrow batches by the exact cosine as one matrix
product, and keeps the best k of each batch before they meet.

Defined cases: vectors that are null, of another length or all zero have no score and are in no result; ties go to the
smaller id; a limit below 1 is an error and one above 50 counts as 50 in ``semantic_search``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEARCH_LIMIT, LIMIT_CAP, OVERFETCH = 10, 50, 3


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays in double precision; null where it has none."""
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = double(a), double(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(x, y) / norm)


def _best(vectors: DataFrame, query: list[float], id_column: str, k: int) -> DataFrame:
    """The ``k`` best rows of each Arrow batch with their score: a matrix product and a partial sort, before batches meet."""
    names, at = vectors.columns, vectors.columns.index("embedding")
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), len(q)), False))
            rows = np.flatnonzero(right)
            if not len(rows) or not length:
                continue
            x = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), len(q))
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            rows, score = rows[good], np.round((x[good] @ q) / (norm[good] * length), 6)
            if len(rows) > k:  # all that tie with the k-th stay; the order by id decides among them later
                keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[keep], score[keep]
            out = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("score", T.DoubleType())])
    return vectors.mapInArrow(run, schema)


def search(vectors: DataFrame, query: list[float], limit: int = SEARCH_LIMIT, *, id_column: str = "id", equal: dict | None = None,
           prefix: tuple[str, str] | None = None, overfetch: int | None = None) -> DataFrame:
    """The ``limit`` rows nearest to ``query``, with ``score``.

    ``equal`` filters columns by value, ``prefix`` a column by its start. With ``overfetch`` the prefix filters
    only the best ``overfetch * limit`` rows, so fewer than ``limit`` may remain.
    """
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    rows = vectors
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    if prefix and overfetch is None:
        rows = rows.where(F.col(prefix[0]).startswith(prefix[1]))
    scored = _best(rows, query, id_column, limit if not prefix or overfetch is None else overfetch * limit)
    order = [F.col("score").desc(), F.col(id_column)]
    if prefix and overfetch is not None:
        scored = scored.orderBy(*order).limit(overfetch * limit).where(F.col(prefix[0]).startswith(prefix[1]))
    return scored.orderBy(*order).limit(limit)


def get_by_id(vectors: DataFrame, id_: str, id_column: str = "id") -> DataFrame:
    return vectors.where(F.col(id_column) == id_)


def content_hashes(vectors: DataFrame, repo: str | None = None) -> DataFrame:
    """``id, content_hash`` of a repository; a missing hash is empty."""
    rows = vectors if repo is None else vectors.where(F.col("repo") == repo)
    return rows.select("id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))


def count(vectors: DataFrame, **equal) -> int:
    for column, value in equal.items():
        vectors = vectors.where(F.col(column) == value)
    return vectors.count()


def counts(vectors: DataFrame, *by: str) -> DataFrame:
    """As :func:`count`, for every value of some columns."""
    return vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def cleared(vectors: DataFrame) -> DataFrame:
    """The table without any row."""
    return vectors.limit(0)


def upserted(vectors: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after ``fresh`` (one row an id) replaced rows of equal id."""
    return vectors.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id"), "id", "left_anti")


def without_file(vectors: DataFrame, repo: str, path: str) -> DataFrame:
    return vectors.where(~F.coalesce((F.col("repo") == repo) & (F.col("file_path") == path), F.lit(False)))


def without_repo(vectors: DataFrame, repo: str) -> DataFrame:
    return vectors.where(~F.coalesce(F.col("repo") == repo, F.lit(False)))
