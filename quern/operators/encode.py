"""Encoders of texts, and the default one: signed feature hashing in an Arrow-batched UDF.

An encoder turns a text column into a vector column. The default needs no model: words and pairs of
words fall into buckets by hash, with a sign, and the sums are brought to length 1. Others plug in as subclasses, for
example around a model in a ``pandas_udf``.

Defined cases: null and wordless texts give a vector of zeros. A batch whose encoding fails gives null
vectors; the sync counts them as failed and tries again next time.
"""

from __future__ import annotations

import json
import logging
import re
import urllib.request
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that tell a stored text from a query.
DOCUMENT_PREFIX, QUERY_PREFIX = "search_document: ", "search_query: "
DIMENSIONS = 768
#: Texts that an encoder gets at once.
BATCH = 128

log = logging.getLogger(__name__)


class Encoder(ABC):
    dimensions: int = DIMENSIONS

    @abstractmethod
    def encode(self, text: Column, is_query: bool = False) -> Column:
        """``array<float>`` of ``dimensions`` numbers."""


def in_batches(text: Column, encode: Callable[[list[str]], list], size: int) -> Column:
    """``encode`` over the texts in batches of ``size``; a batch that fails is logged and gives nulls."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for a in range(0, len(texts), size):
            part = [t or "" for t in texts.iloc[a: a + size]]
            try:
                out += [np.asarray(v, np.float32) for v in encode(part)]
            except Exception:  # noqa: BLE001
                log.exception("a batch of %d texts could not be encoded", len(part))
                out += [None] * len(part)
        return pd.Series(out, dtype=object)

    return run(text)


class HashEncoder(Encoder):
    def __init__(self, dimensions: int = DIMENSIONS, prefixed: bool = False):
        self.dimensions, self.prefixed = dimensions, prefixed

    def encode(self, text: Column, is_query: bool = False) -> Column:
        if self.prefixed:
            text = F.concat(F.lit(QUERY_PREFIX if is_query else DOCUMENT_PREFIX), text)
        d = self.dimensions
        return in_batches(text, lambda texts: hashed_batch(texts, d), BATCH)


class ModelEncoder(Encoder):
    """A model in the workers: ``load`` gives a function from texts to vectors, once a worker.

    Texts get the prefix of documents or queries; vectors are cut to ``dimensions`` and not brought to length 1 again.
    """

    _loaded: dict[str, Callable] = {}

    def __init__(self, load: Callable[[], Callable[[list[str]], list]] | None = None, dimensions: int = DIMENSIONS, name: str = "", batch: int = BATCH):
        self.dimensions, self.load, self.name, self.batch = dimensions, load, name, batch

    def encode(self, text: Column, is_query: bool = False) -> Column:
        load, key, d, prefix = self.load or _sentence_model(self.name), self.name or str(id(self)), self.dimensions, QUERY_PREFIX if is_query else DOCUMENT_PREFIX

        def run(texts: list[str]) -> list:
            if key not in ModelEncoder._loaded:
                ModelEncoder._loaded[key] = load()
            return [v[:d] for v in ModelEncoder._loaded[key]([prefix + t for t in texts])]

        return in_batches(text, run, self.batch)


def _sentence_model(name: str) -> Callable[[], Callable]:
    def load() -> Callable:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, trust_remote_code=True)
        return lambda texts: model.encode(texts, convert_to_numpy=True)

    return load


class HttpEncoder(Encoder):
    """A server that embeds one text a request (``{"model", "prompt"}`` to ``/api/embeddings``, ``{"embedding"}`` back); queries are like documents."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "", dimensions: int = DIMENSIONS, timeout: float = 60.0):
        self.url, self.model, self.dimensions, self.timeout = url.rstrip("/"), model, dimensions, timeout

    def encode(self, text: Column, is_query: bool = False) -> Column:
        url, model, timeout = f"{self.url}/api/embeddings", self.model, self.timeout

        def one(t: str) -> list[float]:
            body = json.dumps({"model": model, "prompt": t}).encode()
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                return json.load(answer)["embedding"]

        return in_batches(text, lambda texts: [one(t) for t in texts], BATCH)


_WORDS = re.compile(r"\w+")


def hashed_batch(texts: list[str], dimensions: int) -> np.ndarray:
    """The vectors of some texts, made at once."""
    marks: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    known: dict[str, int] = {}
    for i, t in enumerate(texts):
        words = _WORDS.findall(t.lower())
        parts = [*words, *map(" ".join, zip(words, words[1:]))]
        for w in set(parts).difference(known):
            known[w] = zlib.crc32(w.encode())
        marks += map(known.__getitem__, parts)
        sizes[i] = len(parts)
    h = np.array(marks, np.int64)
    at = np.repeat(np.arange(len(texts)), sizes) * dimensions + h % dimensions
    v = np.bincount(at, np.where(h >> 31 & 1, -1.0, 1.0), len(texts) * dimensions).reshape(len(texts), dimensions)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1.0)).astype(np.float32)


def truncated(vector: Column, dimensions: int) -> Column:
    """The first ``dimensions`` numbers, not brought to length 1 again."""
    return F.slice(vector, 1, dimensions)


_ENCODERS: dict[str, type[Encoder]] = {"hash": HashEncoder, "model": ModelEncoder, "http": HttpEncoder}


def register(name: str, encoder: type[Encoder]) -> None:
    _ENCODERS[name] = encoder


def encoder_for(name: str = "hash", **options) -> Encoder:
    if name not in _ENCODERS:
        raise ValueError(f"no encoder {name!r}; there are {sorted(_ENCODERS)}")
    return _ENCODERS[name](**options)
