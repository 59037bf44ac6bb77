"""Problem 2: the most similar vectors of every vector, and all pairs beyond a similarity.

Two levels. A coarse layer, fitted on a bounded sample, parts the vectors into cells around directions
where they crowd; every vector is stored in its home cell, and cells that a neighbour may lie in as
well are visited too. Within a cell, of whatever size, several p-stable hash tables (Gaussian directions, orthogonal
to one another over all tables, cut into buckets of a fixed width) hold the rows. How likely a bucket holds a neighbour follows from how far
it lies from the query, and as the tables' directions are orthogonal their estimates add up: for all buckets in use they are one
matrix product. Buckets are visited from the likeliest on, the tables' candidates are merged and ranked by their exact cosine.

* Pairs: a bucket is left out only if even its nearest point lies beyond the distance, in all tables together. So no
  pair within a cell is lost.
* Neighbours: the likeliest buckets give a first k-th best, and buckets are visited until a row nearer than that
  would have been met with the chance ``success``.

Cells larger than a block are worked on in pairs of blocks, so no task holds an unbounded group.

Defined cases: a vector that is null, not of the right length, all zero or holds null, NaN or an infinite
number is in no result; vectors of length other than 1 count by direction; equal vectors are
neighbours at similarity 1; ties go to the smaller id; fewer than k others give fewer rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSION = 64
#: The coarse layer is fitted on so many vectors at most (the least by a hash of their id).
SAMPLE = 20_000
CENTRES, MERGE = 128, 0.55
#: Vectors of one block; a task holds two.
BLOCK = 80_000
#: Hash tables of a cell for pairs and for neighbours, and functions of each; the width of a bucket in units of the projections' spread.
PAIR_TABLES, TABLES, FUNCTIONS, WIDTH = 4, 6, 8, 0.25
#: Standard deviations by which rows visit other cells.
MARGIN = 3.5
#: Share of the buckets that gives the first k-th best.
FIRST = 0.05
#: Queries and buckets judged at once, and candidates ranked at once, so that no intermediate outgrows some 60 MB.
_TILE, _CHUNK, _RANKED = 512, 4096, 100_000


def vectors_of(column: pa.Array, d: int = DIMENSION) -> tuple[np.ndarray, np.ndarray]:
    """``(usable, matrix)``: which rows are usable, and those rows as float32."""
    n = len(column)
    usable = np.zeros(n, bool)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    right = lengths == d
    if not right.any():
        return usable, np.zeros((0, d), np.float32)
    flat = column.filter(pa.array(right)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, d)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    usable[np.flatnonzero(right)[good]] = True
    return usable, x[good]


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (x / norm).astype(np.float32)


class Cells:
    """The coarse layer: centres, and the cell each belongs to; close centres share one."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        u = unit(sample) if len(sample) else np.zeros((1, DIMENSION), np.float32)
        rng = np.random.default_rng(seed)
        c = u[rng.permutation(len(u))[:CENTRES]].copy()
        for _ in range(8):
            near = (u @ c.T).argmax(axis=1)
            for k in range(len(c)):
                total = u[near == k].sum(axis=0)
                if (size := np.linalg.norm(total)) > 1e-6:
                    c[k] = total / size
        parent = list(range(len(c)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(c @ c.T > MERGE, 1))):
            parent[find(int(i))] = find(int(j))
        roots = sorted({find(i) for i in range(len(c))})
        self.centres = c
        self.cell = np.array([roots.index(find(i)) for i in range(len(c))])
        self.n = len(roots)
        #: The greatest distance of two centres.
        self.apart = float(np.sqrt(max(0.0, 2 - 2 * float((c @ c.T).min()))))
        home = self.similarity(u).argmax(axis=1)
        self.share = np.bincount(home, minlength=self.n) / len(u)

    def similarity(self, u: np.ndarray) -> np.ndarray:
        """Of each vector with each cell: that of its nearest centre."""
        s = u @ self.centres.T
        out = np.full((len(u), self.n), -2.0, np.float32)
        for k in range(self.n):
            out[:, k] = s[:, self.cell == k].max(axis=1)
        return out

    def blocks(self, total: int, block: int) -> np.ndarray:
        return np.maximum(1, np.ceil(self.share * total / block)).astype(np.int64)


class Tables:
    """The hash tables over the unit rows ``u`` of a cell.

    ``visited`` counts the rows ranked so far.
    """

    def __init__(self, u: np.ndarray, tables: int, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = u.shape[1]
        k = min(d, tables * functions)
        self.centre = u.mean(axis=0) if len(u) else np.zeros(d, np.float32)
        self.a = np.linalg.qr(rng.normal(size=(d, k)))[0].astype(np.float32)
        p = (u - self.centre) @ self.a
        self.spread = max(float(np.sqrt((p * p).mean())) if len(u) else 0.0, 1e-4)
        self.width = width * self.spread
        offset = (rng.random(k) * self.width).astype(np.float32)
        codes = np.floor((p + offset) / self.width).astype(np.int32)
        # A row's buckets in all tables; rows that share all of them (copies, above all) are judged once.
        codes, inverse = np.unique(codes, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.order = np.argsort(inverse, kind="stable")
        self.sizes = np.bincount(inverse, minlength=len(codes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.middle = ((codes + 0.5) * self.width - offset).astype(np.float32)
        #: How far a row can lie from the middle of its buckets, in the tables' directions.
        self.slack = math.sqrt(k) * self.width / 2
        self.visited = 0

    def rows(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some buckets, and how many each has."""
        n = self.sizes[buckets]
        at = np.repeat(self.starts[buckets] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        self.visited += len(at)
        return self.order[at], n

    def within(self, q: np.ndarray, distance: float, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, row)`` in parts: all rows whose buckets may hold a point within ``distance`` of a query.

        With ``own`` the queries are the rows themselves, and each pair of rows comes once.
        """
        p = (q - self.centre) @ self.a
        order = self.order if own else np.arange(len(q))
        p = p[order]
        bucket_of = np.repeat(np.arange(len(self.sizes)), self.sizes) if own else None
        # |p - m| <= reach as one product: p.m - |m|^2 / 2 >= (|p|^2 - reach^2) / 2.
        least = (((p * p).sum(axis=1) - (distance + self.slack) ** 2) / 2)[:, None].astype(np.float32)
        p = np.concatenate([p, np.ones((len(p), 1), np.float32)], axis=1)
        m = np.concatenate([self.middle, -(self.middle * self.middle).sum(axis=1, keepdims=True) / 2], axis=1).T
        for a in range(0, len(q), _TILE):
            for c in range(int(bucket_of[a]) if own else 0, m.shape[1], _CHUNK):
                near = p[a: a + _TILE] @ m[:, c: c + _CHUNK]
                hit = np.flatnonzero(near >= least[a: a + _TILE])
                if not len(hit):
                    continue
                i, bucket = a + hit // near.shape[1], c + hit % near.shape[1]
                if own:
                    keep = bucket >= bucket_of[i]
                    i, bucket = i[keep], bucket[keep]
                    if not len(i):
                        continue
                ends = np.cumsum(self.sizes[bucket])
                for part in np.split(np.arange(len(i)), np.searchsorted(ends, np.arange(_RANKED, int(ends[-1]), _RANKED))):
                    if not len(part):
                        continue
                    rows, n = self.rows(bucket[part])
                    at = np.repeat(order[i[part]], n)
                    if own:
                        once = (np.repeat(bucket_of[i[part]], n) != np.repeat(bucket[part], n)) | (at < rows)
                        at, rows = at[once], rows[once]
                    yield at, rows


def pairs_beyond(x: np.ndarray, y: np.ndarray | None, least: float, tables: int = PAIR_TABLES) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices of the rows of ``x`` and ``y`` (or of two rows of ``x``) with cosine at least ``least``, and the share of rows ranked."""
    ux, uy = unit(x), unit(x if y is None else y)
    held = Tables(uy, tables)
    found = [np.zeros(0, np.int64)]
    for i, j in held.within(ux, math.sqrt(max(0.0, 2 - 2 * least)) + 1e-4, y is None):
        if y is None:
            i, j = np.minimum(i, j), np.maximum(i, j)
        near = np.einsum("ij,ij->i", ux[i], uy[j]) >= least - 1e-4
        found.append(i[near] * len(uy) + j[near])
    key = np.concatenate(found)
    i, j = key // max(1, len(uy)), key % max(1, len(uy))
    a, b = x[i].astype(np.float64), (x if y is None else y)[j].astype(np.float64)
    exact = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return i[exact >= least], j[exact >= least], held.visited / max(1, len(ux) * len(uy))


def nearest(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray, success: float, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``(query, row, cosine)`` of the ``k`` best rows of ``x`` (sorted by ``ids``) a query, and the share of rows ranked; rows whose id is the query's ``skip`` are left out.

    What the tables' directions tell of the product of a query and a row is normal around its share of that product, if
    they are random. So the buckets that hold a row of at least a given product with chance ``success`` are those beyond a threshold.
    """
    uq, ux = unit(q), unit(x)
    held = Tables(ux, tables, seed=13)
    z = NormalDist().inv_cdf(success)
    seen = uq @ held.a
    part = np.minimum((seen * seen).sum(axis=1), 1.0)  # the share of a query that the directions see
    noise = np.sqrt(held.spread ** 2 * part * (1 - part) + part * held.width ** 2 / 12)
    mean = uq @ held.centre
    first = min(len(held.middle), max(4 * k, math.ceil(FIRST * len(held.middle))))
    out_i, out_j = [], []

    def best(i: int, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, _ = held.rows(buckets)
        rows = rows[ids[rows] != skip[i]]
        s = ux[rows] @ uq[i]
        if len(s) > k:  # all that tie with the k-th
            keep = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-6
            rows, s = rows[keep], s[keep]
        return rows, s

    for a in range(0, len(uq), _TILE // 4):
        score = seen[a: a + _TILE // 4] @ held.middle.T
        top = np.argpartition(-score, first - 1, axis=1)[:, :first]
        for i, line in enumerate(score, a):
            rows, s = best(i, top[i - a])
            if len(s) >= k:
                kth = np.partition(s, len(s) - k)[len(s) - k] - mean[i]
                more = line >= kth * part[i] - z * noise[i]
                more[top[i - a]] = False
            else:
                more = np.ones(len(line), bool)
                more[top[i - a]] = False
            r2, s2 = best(i, np.flatnonzero(more))
            rows, s = np.concatenate([rows, r2]), np.concatenate([s, s2])
            if len(s) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-6
                rows = rows[keep]
            out_i.append(np.full(len(rows), i))
            out_j.append(rows)
    i = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
    row = np.concatenate(out_j) if out_j else np.zeros(0, np.int64)
    a, b = q[i].astype(np.float64), x[row].astype(np.float64)
    cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    order = np.lexsort((ids[row], -cosine, i))
    i, row, cosine = i[order], row[order], cosine[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], row[keep], cosine[keep], held.visited / max(1, len(uq) * len(ux))


def _fit(vectors: DataFrame) -> tuple[Cells, int]:
    rows = vectors.where("embedding is not null and vec_id is not null")
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    column = sample.column(0).combine_chunks()
    column = column.cast(pa.list_(pa.float32())) if len(column) else pa.array([], pa.list_(pa.float32()))
    return Cells(vectors_of(column)[1]), rows.count()


_UNIT = "task long, side int, home boolean, vec_id long, same long, raw binary"


def _emit(unit_: np.ndarray, side: np.ndarray, home: np.ndarray, take: np.ndarray, ids: np.ndarray, same: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    buffer = np.ascontiguousarray(raw[take]).view(np.uint8).reshape(-1)
    width = raw.shape[1] * 4
    offsets = np.arange(len(take) + 1, dtype=np.int32) * width
    binary = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    return pa.RecordBatch.from_arrays(
        [pa.array(unit_), pa.array(side.astype(np.int32)), pa.array(home), pa.array(ids[take]), pa.array(same[take]), binary],
        names=["task", "side", "home", "vec_id", "same", "raw"])


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, d)


def similar_pairs(vectors: DataFrame, least: float = 0.9, block: int = BLOCK, d: int = DIMENSION, exact: bool = False) -> DataFrame:
    """``vec_a, vec_b`` (vec_a < vec_b): the rows of different ``id`` with cosine at least ``least``.

    Within cells no pair is lost. Two rows of different home cells may be, if they differ by more than ``MARGIN`` standard
    deviations of a random difference along the line between the centres; with ``exact`` none is, for several times the copies.
    """
    spark = vectors.sparkSession
    cells, total = _fit(vectors)
    blocks = cells.blocks(total, block)
    shared = spark.sparkContext.broadcast((cells, blocks))  # CENTRES * d numbers
    # Two rows at a distance lead their own cells by gaps that sum up to that distance times the centres' at most, so one of
    # them visits the other's home if its margin is half of it. Of a distance in a random direction the centres see a small share only.
    far = math.sqrt(max(0.0, 2 - 2 * least)) * cells.apart / 2
    margin = far + 1e-4 if exact else min(far, MARGIN * far / math.sqrt(d)) + 1e-4

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer, parts = shared.value
        most = int(parts.max())
        for b in batches:
            usable, raw = vectors_of(b.column(2), d)
            if not usable.any():
                continue
            ids, same = b.column(0).to_numpy()[usable], b.column(1).to_numpy()[usable]
            s = layer.similarity(unit(raw))
            home = s.argmax(axis=1)
            row, cell = np.nonzero(s >= s.max(axis=1, keepdims=True) - margin)
            part = np.abs(ids[row]) % parts[cell]
            out_t, out_s, out_h, out_r = [], [], [], []
            for other in range(most):
                on = other < parts[cell]
                r, c, p = row[on], cell[on], part[on]
                lo, hi = np.minimum(p, other), np.maximum(p, other)
                out_t.append((c * most + lo) * most + hi)
                out_s.append((p > other).astype(np.int32))
                out_h.append(home[r] == c)
                out_r.append(r)
            yield _emit(*(np.concatenate(x) for x in (out_t, out_s, out_h, out_r)), ids, same, raw)

    def search(table: pa.Table) -> pa.Table:
        side, home = table.column("side").to_numpy(), table.column("home").to_numpy()
        ids, same, raw = table.column("vec_id").to_numpy(), table.column("same").to_numpy(), _matrix(table.column("raw"), d)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        task = table.column("task")[0].as_py()
        most = int(shared.value[1].max())
        if task % most == task // most % most:
            i, j, _ = pairs_beyond(raw[one], None, least)
            i, j = one[i], one[j]
        elif len(one) and len(two):
            i, j, _ = pairs_beyond(raw[one], raw[two], least)
            i, j = one[i], two[j]
        else:
            i = j = np.zeros(0, np.int64)
        keep = (home[i] | home[j]) & (same[i] != same[j])
        a, b = ids[i[keep]], ids[j[keep]]
        return pa.table({"vec_a": np.minimum(a, b), "vec_b": np.maximum(a, b)})

    rows = vectors.where("embedding is not null and vec_id is not null").select("vec_id", F.xxhash64("id").alias("same"), F.col("embedding").cast("array<float>"))
    units = rows.mapInArrow(route, _UNIT)
    return units.groupBy("task").applyInArrow(search, "vec_a long, vec_b long").distinct()


def nearest_neighbours(vectors: DataFrame, k: int = 10, every: int = 20, block: int = BLOCK, d: int = DIMENSION, success: float = 0.9, tables: int = TABLES) -> DataFrame:
    """``vec_id, rank, neighbour, cosine`` of the query rows (those whose id ``every`` divides) against all rows.

    ``success`` is the chance with which a cell's probes meet a neighbour.
    """
    spark = vectors.sparkSession
    cells, total = _fit(vectors)
    blocks = cells.blocks(total, 2 * block)
    shared = spark.sparkContext.broadcast((cells, blocks))
    margin = 0.3

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer, parts = shared.value
        most = int(parts.max())
        for b in batches:
            usable, raw = vectors_of(b.column(2), d)
            if not usable.any():
                continue
            ids, same = b.column(0).to_numpy()[usable], b.column(1).to_numpy()[usable]
            s = layer.similarity(unit(raw))
            home = s.argmax(axis=1)
            out = [(home * most + np.abs(ids) % parts[home], np.zeros(len(ids), np.int32), np.arange(len(ids)))]
            query = np.flatnonzero(ids % every == 0)
            row, cell = np.nonzero(s[query] >= s[query].max(axis=1, keepdims=True) - margin)
            for part in range(most):
                on = part < parts[cell]
                out.append((cell[on] * most + part, np.ones(int(on.sum()), np.int32), query[row[on]]))
            t, side, take = (np.concatenate(x) for x in zip(*out))
            yield _emit(t, side, np.ones(len(t), bool), take, ids, same, raw)

    def search(table: pa.Table) -> pa.Table:
        side, ids, raw = table.column("side").to_numpy(), table.column("vec_id").to_numpy(), _matrix(table.column("raw"), d)
        base, query = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(base) or not len(query):
            i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            order = base[np.argsort(ids[base], kind="stable")]
            i, j, s, _ = nearest(raw[query], raw[order], k, ids[query], ids[order], success, tables)
            i, j = query[i], order[j]
        return pa.table({"vec_id": ids[i], "neighbour": ids[j], "cosine": s})

    rows = vectors.where("embedding is not null and vec_id is not null").select("vec_id", F.lit(0).cast("long").alias("same"), F.col("embedding").cast("array<float>"))
    found = rows.mapInArrow(route, _UNIT).groupBy("task").applyInArrow(search, "vec_id long, neighbour long, cosine double")
    w = Window.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", F.round("cosine", 6).alias("cosine"))
