"""Problem 4: records that share most of their content despite small edits, as pairs and groups.

The sets A, B of word shingles of two records are close if ``|A & B| / |A | B|`` reaches the threshold t, that
is if their Hamming distance is at most ``(1 - t) / (1 + t) * (|A| + |B|)``.

1. Records with equal sets form one class; its least member stands for it.
2. Candidates: of two close sets, each has among its rarest ``|A| - ceil(t |A|) + 1`` shingles one
   that is among the other's. Shingles of one record only are dropped, the others joined,
   with filters on size and place. A shingle that very many records hold in this place is joined
   by classes of size and in blocks, so that no task holds all of them.
3. Pigeonring: shingles fall into a ring of segments by hash. From some segment on, every chain of
   consecutive segments must keep its summed differences within its share of the distance;
   bitmaps of the segments, as wide as the set is large, give lower bounds of the differences. Other candidates are pruned.
4. The full Hamming distance of the survivors decides.

Defined cases: null texts and those below the least number of words are in no pair; repeated rows and
ties are equal sets; extra columns play no part; no rows give no pairs. Nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import current_functions
from ..operators.components import connected_components
from ..session import materialize
from .shingles import mix, shingle_sets

SHINGLE, THRESHOLD, LEAST_WORDS = 3, Fraction(6, 10), 20
SEGMENTS, CHAIN = 16, 8
#: Bits of a segment at least, and bits for each of its shingles.
SEGMENT_BITS, BITS_EACH = 64, 4
#: Records that hold one shingle in their prefix, beyond which it is joined in blocks of so many.
HOT = 2048
#: A bounded sample tells which shingles are so common that they come last in the order of
#: rarity; the order decides about speed only.
SAMPLE, COMMON = 4000, 40


def _bytes_column(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([flat[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())


def documents(rows: DataFrame, size: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``seq, file, n, sig, text`` of the records with enough words: the number of shingles and a 128-bit hash of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, ends, _ = shingle_sets(b.column("text").to_pylist(), size, least_words)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            n = ends - starts
            some = n > 0
            if not some.any():
                continue
            with np.errstate(over="ignore"):
                at = starts[some]
                one = np.add.reduceat(s, at)
                two = np.bitwise_xor.reduceat(s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(17)), at)
            sig = pa.array([x.tobytes() for x in np.stack([one, two], axis=1)], pa.binary())
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [b.column("seq").filter(keep), b.column("file").filter(keep), pa.array(n[some].astype(np.int32)), sig, b.column("text").filter(keep)],
                names=["seq", "file", "n", "sig", "text"])

    return rows.select("seq", "file", "text").where("text is not null").mapInArrow(run, "seq long, file long, n int, sig binary, text string")


def classes(docs: DataFrame) -> DataFrame:
    """``seq, file, n, rep``: each record with the least record of an equal set."""
    slim = docs.select("seq", "file", "n", "sig")
    return slim.join(slim.groupBy("sig", "n").agg(F.min("seq").alias("rep")), ["sig", "n"]).select("seq", "file", "n", "rep")


def _common(docs: DataFrame, size: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles of a bounded sample and their counts."""
    sample = docs.select("seq", "text").orderBy(F.xxhash64("seq"), "seq").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, _, _ = shingle_sets(b.column(1).to_pylist(), size, least_words)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["token"])

    rows = sample.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON).collect()
    rows.sort(key=lambda r: r["token"])
    return np.array([r["token"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)


def candidates(docs: DataFrame, t: Fraction = THRESHOLD, size: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``a, b``: pairs of records (each one of its class) that share a rare shingle and may be close.

    Shingles travel as 32-bit hashes: a collision can only add candidates, as the length of
    the prefix counts the true shingles.
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(_common(docs, size, least_words))  # at most the sample's shingles / COMMON
    num, den = t.numerator, t.denominator

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        for b in batches:
            seqs = b.column(0).to_numpy()
            s, ends, _ = shingle_sets(b.column(1).to_pylist(), size, least_words)
            sizes = np.diff(np.concatenate([[0], ends])).astype(np.int64)
            doc = np.repeat(np.arange(len(seqs)), sizes)
            rank = np.zeros(len(s), np.int64)
            if len(known) and len(s):
                signed = s.view(np.int64)
                at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                rank = np.where(known[at] == signed, times[at], 0)
            key = rank << 32 | (s >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            if len(key):
                first = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
                key, doc = key[first], doc[first]
            # In the order of (common, hash) a common shingle is needed only within the prefix.
            count = np.bincount(doc, minlength=len(seqs))
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            prefix = sizes - (sizes * num + den - 1) // den + 1
            keep = (key >> 32 == 0) | (place < prefix[doc])
            key, doc = key[keep], doc[keep]
            count = np.bincount(doc, minlength=len(seqs)).astype(np.int32)
            for i in range(0, len(key), 500_000):
                d = doc[i: i + 500_000]
                yield pa.RecordBatch.from_arrays([pa.array(seqs[d]), pa.array(key[i: i + 500_000]), pa.array(count[d])], names=["seq", "key", "e"])

    tokens = docs.select("seq", "text").mapInArrow(emit, "seq long, key long, e int")
    w = Window.partitionBy("key")
    # What only one record has is no link: it comes first in the order of rarity and is only counted.
    frequent = F.col("key") >= F.lit(1 << 32)
    shared = tokens.withColumn("df", F.count(F.lit(1)).over(w)).where(frequent | (F.col("df") > 1))
    item = F.struct(F.when(frequent, F.shiftright("key", 32)).otherwise(0).alias("rank"), F.when(frequent, 0).otherwise(F.col("df")).alias("df"), "key", F.col("df").alias("held"))
    lists = shared.groupBy("seq").agg(F.first("e").alias("e"), F.array_sort(F.collect_list(item)).alias("list"))
    lists = lists.join(docs.select("seq", "n"), "seq")
    singles = F.col("e") - F.size("list")
    prefix = F.col("n") - F.floor((F.col("n") * num + (den - 1)) / den).cast("int") + 1
    places = lists.select("seq", "n", singles.alias("_s"), prefix.alias("_p"), F.posexplode("list").alias("_i", "x"))
    places = places.select(F.col("x.key").alias("key"), "seq", "n", (F.col("_s") + F.col("_i")).alias("place"), "_p", F.when(F.col("x.held") > HOT, F.ceil(F.col("x.held") / HOT).cast("int")).alias("_m")).where("place < _p").drop("_p")
    places = materialize(places, "prefixes")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num))).cast("int")  # close sets are of neighbouring classes
    places = places.withColumn("_class", F.when(F.col("_m").isNotNull(), size_class).otherwise(0))
    own = F.when(F.col("_m").isNotNull(), F.pmod(F.xxhash64("seq"), F.col("_m")).cast("int")).otherwise(0)
    # Every row stays in its block; on the left it also visits the other blocks of its class and of those next to it.
    visits = F.when(F.col("_m").isNotNull(), F.sequence(F.lit(0), F.col("_m") - 1)).otherwise(F.array(F.lit(0)))
    classes_near = F.when(F.col("_m").isNotNull(), F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)).otherwise(F.array(F.lit(0)))
    left = places.select("key", F.col("seq").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), visits.alias("_v"), F.explode(classes_near).alias("_class"))
    left = left.select("key", "a", "na", "pa", "_class", F.explode("_v").alias("_block"))
    right = places.select("key", F.col("seq").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), "_class", own.alias("_block"))
    close = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) * (num + den) >= (F.col("na") + F.col("nb")) * num
    return left.join(right, ["key", "_class", "_block"]).where((F.col("a") < F.col("b")) & close & room).select("a", "b").distinct()


#: Bits of the map that tells which records are in candidates at all: 1 MB, whatever the data.
_MAP_BITS = 1 << 23


def _spot(seq: np.ndarray) -> np.ndarray:
    return (mix(seq.astype(np.int64).view(np.uint64)) & np.uint64(_MAP_BITS - 1)).astype(np.int64)


def _map_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids: it may hold others too, but lacks none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_MAP_BITS, bool)
        for b in batches:
            bits[_spot(b.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(_MAP_BITS // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                out |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    # One map a partition, 32 merged ones, and one row of 1 MB in the end.
    parts = ids.mapInArrow(run, "bits binary").repartition(32).mapInArrow(both, "bits binary").repartition(1).mapInArrow(both, "bits binary")
    return np.frombuffer(parts.first()["bits"], np.uint8)


def segment_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of a segment for sets of ``n`` shingles: a power of two, so that a wide bitmap folds into a narrow one."""
    bits = np.maximum(SEGMENT_BITS, n * BITS_EACH / SEGMENTS)
    return (1 << np.ceil(np.log2(bits / 64)).astype(np.int64).clip(0)).astype(np.int64)


def rings(s: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The segments' bitmaps of some sets, end to end; a set's bitmap has ``SEGMENTS * segment_words`` words."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    words = segment_words(ends - starts)
    first = np.cumsum(words * SEGMENTS) - words * SEGMENTS
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    out = np.zeros(int((words * SEGMENTS).sum()), np.uint64)
    segment, place = (s & np.uint64(SEGMENTS - 1)).astype(np.int64), (s >> np.uint64(8)).astype(np.uint64)
    # The low bits say which word, so that folding keeps the bit's place in it.
    word = (place >> np.uint64(6)).astype(np.int64) & (words[doc] - 1)
    np.bitwise_or.at(out, first[doc] + segment * words[doc] + word, np.uint64(1) << (place & np.uint64(63)))
    return [out[a: a + k].tobytes() for a, k in zip(first, words * SEGMENTS)]


def folded(ring: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (pairs, segments, words) made narrower: bits that fall together are joined, so differences can only shrink."""
    while ring.shape[2] > words:
        half = ring.shape[2] // 2
        ring = ring[:, :, :half] | ring[:, :, half:]
    return ring


def _sets(docs: DataFrame, ids: DataFrame, size: int, least_words: int) -> DataFrame:
    """``seq, n, ring, hashes``: the segment bitmaps and sorted shingles of the records in ``ids``, and perhaps of some others."""
    known = docs.sparkSession.sparkContext.broadcast(_map_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for b in batches:
            spot = _spot(b.column(0).to_numpy())
            b = b.filter(pa.array((bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1))
            if not b.num_rows:
                continue
            s, ends, _ = shingle_sets(b.column(1).to_pylist(), size, least_words)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array((ends - starts).astype(np.int32)), pa.array(rings(s, ends), pa.binary()), _bytes_column(s, starts, ends)],
                names=["seq", "n", "ring", "hashes"])

    return docs.select("seq", "text").mapInArrow(run, "seq long, n int, ring binary, hashes binary")


def ring_holds(x: np.ndarray, y: np.ndarray, budget: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Which pairs of segment bitmaps (pairs, segments[, words]) may be within ``budget``: from some segment on, all chains of up to ``chain`` segments keep their share."""
    boxes = np.bitwise_count(x ^ y).astype(np.float64)
    if boxes.ndim == 3:
        boxes = boxes.sum(axis=2)
    m = boxes.shape[1]
    share = (budget / m)[:, None]
    around = np.concatenate([boxes, boxes[:, : chain - 1]], axis=1)
    alive = np.ones_like(boxes, bool)
    total = np.zeros_like(boxes)
    for k in range(chain):
        total = total + around[:, k: k + m]
        alive &= total <= share * (k + 1) + 1e-9
    return alive.any(axis=1)


def surviving(ra: list[bytes], rb: list[bytes], budget: np.ndarray) -> np.ndarray:
    """The pairs that the ring does not prune; bitmaps of two widths are compared at the narrower one."""
    wa, wb = (np.array([len(r) // (8 * SEGMENTS) for r in side], np.int64) for side in (ra, rb))
    alive = np.zeros(len(ra), bool)
    for a, b in set(zip(wa.tolist(), wb.tolist())):
        at = np.flatnonzero((wa == a) & (wb == b))
        for part in np.array_split(at, -(-len(at) * (a + b) // 65_536)):  # some 16 MB of bitmaps at once
            side = lambda r, w: folded(np.frombuffer(b"".join(r[i] for i in part), np.uint64).reshape(-1, SEGMENTS, w), min(a, b))  # noqa: E731, B023
            alive[part] = ring_holds(side(ra, a), side(rb, b), budget[part])
    return np.flatnonzero(alive)


def close_classes(docs: DataFrame, t: Fraction = THRESHOLD, size: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``a, b, shared, united``: the close pairs among records that each stand for a class."""
    pairs = materialize(candidates(docs, t, size, least_words), "candidates")
    ids = pairs.select(F.col("a").alias("seq")).unionByName(pairs.select(F.col("b").alias("seq")))
    sets = materialize(_sets(docs, ids, size, least_words), "sets")
    side = lambda x: sets.select(F.col("seq").alias(x), F.col("ring").alias(f"r{x}"), F.col("hashes").alias(f"h{x}"))
    num, den = t.numerator, t.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb, ha, hb = (b.column(i).to_pylist() for i in (2, 3, 4, 5))
            n = np.array([(len(x) + len(y)) // 8 for x, y in zip(ha, hb)])
            budget = n * (den - num) / (den + num)
            alive = surviving(ra, rb, budget)
            both = [len(np.intersect1d(np.frombuffer(ha[i], np.uint64), np.frombuffer(hb[i], np.uint64), assume_unique=True)) for i in alive]
            both = np.array(both, np.int64)
            united = n[alive] - both
            ok = both * den >= united * num
            take = pa.array(alive[ok])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(both[ok]), pa.array(united[ok])], names=["a", "b", "shared", "united"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "ha", "hb")
    return joined.mapInArrow(verify, "a long, b long, shared long, united long")


class NearDuplicates:
    """The classes, their close pairs and what follows from them, for one set of records ``seq, file, text``."""

    def __init__(self, rows: DataFrame, t: Fraction = THRESHOLD, size: int = SHINGLE, least_words: int = LEAST_WORDS):
        docs = materialize(documents(rows, size, least_words), "documents")
        self.members = materialize(classes(docs), "classes")
        # Written, so that Spark knows their number and chooses the join by it.
        copies = materialize(self.members.where("seq <> rep").select("seq"), "copies")
        self.links = materialize(close_classes(docs.join(copies, "seq", "left_anti"), t, size, least_words), "links")

    def pairs(self) -> DataFrame:
        """``seq_a, seq_b`` (seq_a < seq_b): every close pair of records of different files."""
        one = self.members.select(F.col("rep").alias("a"), F.col("seq").alias("x"), F.col("file").alias("fx"))
        two = self.members.select(F.col("rep").alias("b"), F.col("seq").alias("y"), F.col("file").alias("fy"))
        far = self.links.select("a", "b").join(one, "a").join(two, "b").where("fx <> fy").select("x", "y")
        own = one.join(two, F.col("a") == F.col("b")).where("x < y and fx <> fy").select("x", "y")
        return far.unionByName(own).select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))

    def groups(self) -> DataFrame:
        """``seq, class_id, group_id, n_links``: one row a record.

        ``class_id`` is the least record of an equal set, ``group_id`` the least one that close pairs across
        files lead to, ``n_links`` the number of close records in other files.
        """
        cells = self.members.groupBy("rep", "file").agg(F.count(F.lit(1)).alias("k"))
        reps = cells.groupBy("rep").agg(F.sum("k").alias("size"), F.count(F.lit(1)).alias("files"), F.min("file").alias("file"))
        ends = lambda x: reps.select(F.col("rep").alias(x), F.col("files").alias(f"n{x}"), F.col("file").alias(f"f{x}"))
        valid = self.links.select("a", "b").join(ends("a"), "a").join(ends("b"), "b").where("na > 1 or nb > 1 or fa <> fb").select("a", "b")
        parts = connected_components(valid, "a", "b").select(F.col("node").alias("rep"), "component")
        # All records within reach, less those in the record's own file.
        near = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = near.unionByName(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        total = near.join(reps.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("reach"))
        here = near.join(cells.select(F.col("rep").alias("b"), "file", "k"), "b").groupBy("a", "file").agg(F.sum("k").alias("local"))
        rows = self.members.join(total.withColumnRenamed("a", "rep"), "rep").join(here.withColumnRenamed("a", "rep"), ["rep", "file"])
        rows = rows.join(reps.select("rep", "files"), "rep").join(parts, "rep", "left")
        group = F.coalesce("component", F.when(F.col("files") > 1, F.col("rep")).otherwise(F.col("seq")))
        return rows.select("seq", F.col("rep").alias("class_id"), group.alias("group_id"), (F.col("reach") - F.col("local")).alias("n_links"))


def similar_functions(functions: DataFrame) -> NearDuplicates:
    """Near duplicates among the current functions; a file is a repository and a clean path."""
    rows = current_functions(functions, text=F.col("code"))
    return NearDuplicates(rows.select("seq", F.xxhash64("repo", "clean_path").alias("file"), "text"))
