"""Problem 9: the reading level of each document.

Every sentence of a document's prose gets a distribution over the levels from a regularised
model of its words and their character n-grams; the document's difficulty is the mean over its
sentences, calibrated by an isotonic fit on labelled documents that the model has not seen.

The model is fitted on at most ``sample_docs`` labelled documents (the least by a hash of their id;
the median over annotators is the label), on all sentences of their whole texts. Counts of sentences, words and letters cover whole texts too.
How good it is on labelled documents that it has not seen tells :func:`held_out`.

Defined cases: null, blank and prose-free documents come out with zero counts and a null level;
without any label all levels are null and the counts remain; repeated labels of a document
give their median; documents given twice come out twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .prose import END, abbreviated, prose_parts, prose_sentences

LEVELS = 5
#: Labelled rows that the model is fitted on at most.
SAMPLE_DOCS = 1000
_BUCKETS = 1 << 14
_VOCABULARY = 300_000

PROFILE = "n_sentences long, n_words long, n_letters long, level_share array<double>, difficulty double, reading_level int"


def _word_features(word: str) -> list[int]:
    """Buckets of a word: itself, then its character 3-grams."""
    w = f"<{word.lower()}>".encode()
    return [zlib.crc32(w) % _BUCKETS] + [_BUCKETS + zlib.crc32(w[i: i + 3]) % _BUCKETS for i in range(len(w) - 2)]


class SentenceModel:
    """Softmax over levels, linear in the mean of the words' features and in three measures of the sentence."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.weights, self.dense, self.knots, self.values = weights, dense, knots, values

    def word_scores(self, words: list[str]) -> np.ndarray:
        feats = [_word_features(w) for w in words]
        sizes = np.fromiter(map(len, feats), np.int64, len(feats))
        flat = np.fromiter((x for f in feats for x in f), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        chars = np.add.reduceat(self.weights[flat], starts, axis=0) - self.weights[flat[starts]]
        return (self.weights[flat[starts]] + chars / np.maximum(sizes - 1, 1)[:, None]).astype(np.float32)

    def probabilities(self, mean_scores: np.ndarray, measures: np.ndarray) -> np.ndarray:
        z = mean_scores + measures @ self.dense
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def calibrated(self, expected: np.ndarray) -> np.ndarray:
        return np.interp(expected, self.knots, self.values)


def _measures(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(words)), np.log1p(words) - 2.5, letters / words - 5.0], axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the monotone fit of ``y`` on ``x`` (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum y, count, sum x
    for i in order:
        blocks.append([float(y[i]), 1.0, float(x[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(docs: list[tuple[list[list[str]], int]], rounds: int = 120, l2: float = 1e-4) -> SentenceModel | None:
    """The model from ``(sentences, level)`` of labelled documents; every fifth document calibrates. None without data."""
    docs = [(s, y) for s, y in docs if s]
    if not docs:
        return None
    hold = [d for i, d in enumerate(docs) if i % 5 == 4] or docs
    train = [d for i, d in enumerate(docs) if i % 5 != 4 or len(docs) < 5]
    vocab: dict[str, int] = {}
    ids, sizes, target, letters = [], [], [], []
    for sents, y in train:
        for words in sents:
            ids += [vocab.setdefault(w, len(vocab)) for w in words]
            sizes.append(len(words))
            letters.append(sum(map(len, words)))
            target.append(y)
    ids, sizes, target = np.array(ids), np.array(sizes), np.array(target) - 1
    m = _measures(sizes.astype(float), np.array(letters, float))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    feats = [_word_features(w) for w in vocab]
    word_of = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    scale = np.concatenate([np.array([1.0] + [1.0 / max(1, len(f) - 1)] * (len(f) - 1)) for f in feats])
    w, v = np.zeros((2 * _BUCKETS, LEVELS)), np.zeros((m.shape[1], LEVELS))
    gw, gv = np.full_like(w, 1e-8), np.full_like(v, 1e-8)
    onehot = np.eye(LEVELS)[target]
    first = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
    for _ in range(rounds):
        scores = np.add.reduceat(w[flat] * scale[:, None], first, axis=0)
        z = np.add.reduceat(scores[ids], starts, axis=0) / sizes[:, None] + m @ v
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - onehot) / len(sizes)
        share = error / sizes[:, None]
        on_word = np.stack([np.bincount(ids, share[owner, k], len(vocab)) for k in range(LEVELS)], axis=1)
        dw = np.stack([np.bincount(flat, on_word[word_of, k] * scale, len(w)) for k in range(LEVELS)], axis=1) + l2 * w
        dv = m.T @ error + l2 * v
        gw += dw * dw
        gv += dv * dv
        w -= 0.3 * dw / np.sqrt(gw)
        v -= 0.3 * dv / np.sqrt(gv)
    model = SentenceModel(w, v, np.array([1.0, LEVELS]), np.array([1.0, LEVELS]))
    expected = np.array([_expected(model, s) for s, _ in hold])
    model.knots, model.values = isotonic(expected, np.array([y for _, y in hold], float))
    return model


def _expected(model: SentenceModel, sents: list[list[str]]) -> float:
    total = np.zeros(LEVELS)
    for words in sents:
        n, k = np.array([float(len(words))]), np.array([float(sum(map(len, words)))])
        total += model.probabilities(model.word_scores(words).mean(axis=0, keepdims=True), _measures(n, k))[0]
    return float(total @ np.arange(1, LEVELS + 1) / len(sents))


def profile_batch(texts: list, kinds: list, model: SentenceModel | None, cache: dict) -> dict[str, np.ndarray]:
    """Counts and level shares of a batch of documents; ``cache`` keeps the vocabulary between batches."""
    if len(cache.get("vocab", ())) > _VOCABULARY:
        cache.clear()
    vocab, rows = cache.setdefault("vocab", {}), cache.setdefault("rows", [])
    ids: list[int] = []
    ends = np.zeros(len(texts), np.int64)
    for i, (text, kind) in enumerate(zip(texts, kinds)):
        parts = prose_parts(text, kind)
        for p in set(parts).difference(vocab):
            vocab[p] = len(vocab)
            rows.append(p)
        ids += map(vocab.__getitem__, parts)
        ends[i] = len(ids)
    known = len(cache.get("length", ()))
    if known < len(rows):
        fresh = rows[known:]
        new = {
            "length": np.array([sum(map(str.isalpha, p)) for p in fresh], np.int64),
            "tail": np.array([abbreviated(p) for p in fresh]), "dot": np.array([p == "." for p in fresh]),
            "end": np.array([p == END for p in fresh]), "letter": np.array([len(p) == 1 and p.isalpha() for p in fresh]),
            "scores": model.word_scores(fresh) if model is not None else np.zeros((len(fresh), LEVELS), np.float32),
        }
        cache.update({k: np.concatenate([cache[k], v]) if known else v for k, v in new.items()})
    n = len(texts)
    out = {"sentences": np.zeros(n, np.int64), "words": np.zeros(n, np.int64), "letters": np.zeros(n, np.int64), "share": np.zeros((n, LEVELS))}
    idx = np.array(ids, np.int64)
    if not len(idx):
        return out
    length = cache["length"][idx]
    word = length > 0
    doc = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    spurious = np.concatenate([[False], cache["dot"][idx[1:]] & cache["tail"][idx[:-1]]])
    spurious[2:] |= cache["end"][idx[2:]] & cache["dot"][idx[1:-1]] & cache["letter"][idx[:-2]]
    idx, length, word, doc = idx[~spurious], length[~spurious], word[~spurious], doc[~spurious]
    sentence = np.cumsum(~word)  # a word's sentence: the number of marks before it
    idx, length, sentence, doc = idx[word], length[word], sentence[word], doc[word]
    if not len(idx):
        return out
    first = np.concatenate([[0], np.flatnonzero(np.diff(sentence) != 0) + 1])
    size = np.diff(np.concatenate([first, [len(idx)]]))
    owner = doc[first]
    letters = np.add.reduceat(length, first)
    out["sentences"] = np.bincount(owner, minlength=n)
    out["words"] = np.bincount(owner, size, n).astype(np.int64)
    out["letters"] = np.bincount(owner, letters, n).astype(np.int64)
    if model is not None:
        mean = np.add.reduceat(cache["scores"][idx], first, axis=0) / size[:, None]
        p = model.probabilities(mean, _measures(size.astype(float), letters.astype(float)))
        for k in range(LEVELS):
            out["share"][:, k] = np.bincount(owner, p[:, k], n) / np.maximum(out["sentences"], 1)
    return out


def _labelled(documents: DataFrame, labels: DataFrame, kind: Column, sample_docs: int) -> list[tuple[int, list[list[str]], int]]:
    """``(doc_id, sentences, level)`` of a bounded sample of labelled documents, in the order of a hash of the id."""
    label = labels.where("doc_id is not null and reading_level between 1 and 5").groupBy("doc_id").agg(F.percentile("reading_level", 0.5).alias("level"))
    sample = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # The sample has sample_docs rows of two numbers at most, so it is small enough to broadcast.
    docs = documents.select("doc_id", "text", kind.alias("kind")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sents = [prose_sentences(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("kind").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("level"), pa.array(sents, pa.list_(pa.list_(pa.string())))], names=["doc_id", "level", "sents"])

    rows = docs.select("doc_id", "level", "text", "kind").mapInArrow(run, "doc_id long, level double, sents array<array<string>>").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [(r.doc_id, [list(s) for s in r.sents], int(round(r.level))) for r in rows]


def train(documents: DataFrame, labels: DataFrame, kind: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> SentenceModel | None:
    """The model from at most ``sample_docs`` labelled documents."""
    rows = _labelled(documents, labels, kind if kind is not None else F.col("doc_kind"), sample_docs)
    return fit([(s, y) for _, s, y in rows])


def held_out(spark: SparkSession, documents: DataFrame, labels: DataFrame, kind: Column | None = None, sample_docs: int = SAMPLE_DOCS, folds: int = 5) -> DataFrame:
    """One row: how the levels of labelled documents come out that the model has not seen, by cross-validation.

    ``accuracy`` is the share of right levels, ``near`` of those at most one off, ``error`` the mean distance; ``baseline`` and
    ``baseline_error`` are those of always saying the commonest level of the other folds. No labelled prose gives nulls.
    """
    docs = [(s, y) for _, s, y in _labelled(documents, labels, kind if kind is not None else F.col("doc_kind"), sample_docs) if s]
    right, near, off, base, base_off = [], [], [], [], []
    for fold in range(folds if len(docs) >= folds else 0):
        model = fit([d for i, d in enumerate(docs) if i % folds != fold])
        common = np.bincount([y for i, (_, y) in enumerate(docs) if i % folds != fold]).argmax()
        for s, y in docs[fold::folds]:
            level = int(np.clip(np.rint(model.calibrated(np.array([_expected(model, s)]))[0]), 1, LEVELS))
            right.append(level == y)
            near.append(abs(level - y) <= 1)
            off.append(abs(level - y))
            base.append(common == y)
            base_off.append(abs(int(common) - y))
    mean = lambda x: round(float(np.mean(x)), 4) if x else None
    return spark.createDataFrame([(len(docs), mean(right), mean(near), mean(off), mean(base), mean(base_off))], "documents long, accuracy double, near double, error double, baseline double, baseline_error double")


def reading_levels(spark: SparkSession, documents: DataFrame, labels: DataFrame, kind: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id`` with its counts, the share of each level among its sentences, the difficulty (1 to 5) and the rounded level."""
    model = spark.sparkContext.broadcast(train(documents, labels, kind, sample_docs))  # 2 * 16384 * 5 weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        m = model.value
        for b in batches:
            got = profile_batch(b.column(1).to_pylist(), b.column(2).to_pylist(), m, cache)
            some = (got["sentences"] > 0) & (m is not None)
            expected = got["share"] @ np.arange(1, LEVELS + 1)
            hard = m.calibrated(expected) if m is not None else expected
            share = pa.array([s.tolist() if ok else None for s, ok in zip(got["share"], some)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(got[c], pa.int64()) for c in ("sentences", "words", "letters")), share,
                 pa.array(hard, pa.float64(), mask=~some), pa.array(np.clip(np.rint(hard), 1, LEVELS).astype(np.int32), pa.int32(), mask=~some)],
                names=["doc_id", "n_sentences", "n_words", "n_letters", "level_share", "difficulty", "reading_level"])

    docs = spread(documents.select("doc_id", "text", (kind if kind is not None else F.col("doc_kind")).alias("_kind")))
    return docs.mapInArrow(run, "doc_id long, " + PROFILE)


def demanding(levels: DataFrame, words: int = 18, letters: int = 6) -> DataFrame:
    """The documents whose prose averages at least so many words a sentence and letters a word."""
    return levels.where((F.col("n_sentences") > 0) & (F.col("n_words") >= words * F.col("n_sentences")) & (F.col("n_letters") >= letters * F.col("n_words")))
