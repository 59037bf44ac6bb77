"""An index of the vector table for cosine search: cells around centres, one folder a cell.

The centres are fitted on a bounded sample; every row is stored with the centre nearest to it, and each cell keeps its radius, the
greatest angle between its centre and a row. A search reads the likeliest cells first; the k-th best score then tells which
other cells can still hold a better row (no row of a cell is nearer to the query than the cell's centre by more than its radius), and only those are read. So
the result is exact, at the price of the cells that can't be excluded; with ``exact=False`` the search stops after the first.

Defined cases: rows without a usable vector are in no cell and in no result; an empty table has no cells and no results; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V

#: Rows that the centres are fitted on at most, rounds of fitting, and the most cells of an index.
SAMPLE, ROUNDS, CELLS = 20_000, 8, 4096
#: Cells read first.
PROBES = 8


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of a vector column and their directions."""
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), d), False))
    rows = np.flatnonzero(right)
    x = column.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d) if len(rows) else np.zeros((0, d))
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good][:, None]


def fitted(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Centres of length 1 around which the sample's directions crowd."""
    c = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    if not len(c):
        return c
    for _ in range(ROUNDS):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1))
        c[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9][:, None]
    return c


class VectorIndex:
    """The index below ``path``; :meth:`build` makes it, :meth:`search` asks it."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray, radius: np.ndarray, schema: T.StructType):
        self.spark, self.path, self.centres, self.radius, self.schema = spark, path.rstrip("/"), centres, radius, schema

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dimensions: int, cells: int | None = None, id_column: str = "id") -> "VectorIndex":
        """Write the rows of ``vectors`` by cell; about the square root of their number of cells, and :data:`CELLS` at most."""
        spark = vectors.sparkSession
        count = vectors.count()
        picked = vectors.where("embedding is not null").select(id_column, "embedding").orderBy(F.xxhash64(id_column), id_column).limit(SAMPLE).select("embedding").toArrow()
        column = picked.column(0).combine_chunks() if len(picked) else pa.array([], pa.list_(pa.float32()))
        _, sample = _matrix(column, dimensions)
        centres = fitted(sample, min(cells or max(1, int(math.sqrt(count))), CELLS))
        shared, at = spark.sparkContext.broadcast(centres), vectors.columns.index("embedding")
        names = vectors.columns

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                rows, u = _matrix(b.column(at), dimensions)
                if len(rows) and len(c):
                    s = u @ c.T
                    cell = s.argmax(axis=1)
                    near = np.take_along_axis(s, cell[:, None], axis=1)[:, 0]
                    out = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(np.arccos(np.clip(near, -1, 1)))], names=[*names, "_cell", "_angle"])

        schema = T.StructType([*vectors.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
        vectors.mapInArrow(route, schema).repartition("_cell").write.option("compression", "zstd").partitionBy("_cell").parquet(f"{path}/rows")
        radius = np.full(len(centres), -1.0)
        written = spark.read.schema(schema).parquet(f"{path}/rows")
        for r in written.groupBy("_cell").agg(F.max("_angle").alias("r")).collect():  # one row a cell
            radius[r["_cell"]] = r["r"]
        return cls(spark, path, centres, radius, schema)

    def order(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells that have rows, the best bound first, and the greatest cosine a row of each can have."""
        angle = np.arccos(np.clip(self.centres @ query, -1, 1)) if len(self.centres) else np.zeros(0)
        bound = np.where(self.radius < 0, -2.0, np.cos(np.maximum(angle - self.radius, 0.0)))
        order = np.lexsort((angle, -bound))
        return order[bound[order] > -2], bound

    def search(self, query: list[float], limit: int = V.SEARCH_LIMIT, *, probes: int = PROBES, exact: bool = True, id_column: str = "id", equal: dict | None = None) -> DataFrame:
        """The ``limit`` rows nearest to ``query``, with ``score``; ``equal`` filters columns by value first."""
        q = np.asarray(query, np.float64)
        norm = math.sqrt(float(q @ q))
        order, bound = self.order(q / norm if norm else q)
        nearest = order[np.argsort(-(self.centres[order] @ q), kind="stable")] if len(order) else order
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        inside = lambda cells: V.search(rows.where(F.col("_cell").isin([int(c) for c in cells])), query, limit, id_column=id_column, equal=equal)
        first = nearest[:probes]
        out = inside(first)
        if exact and len(order) > len(first):
            found = [r[0] for r in out.select("score").collect()]  # ``limit`` numbers
            kth = found[limit - 1] if len(found) >= limit else -2.0
            more = [c for c in order if bound[c] >= kth - 1e-6]
            out = inside(sorted({*map(int, first), *map(int, more)}))
        return out.drop("_cell", "_angle")
