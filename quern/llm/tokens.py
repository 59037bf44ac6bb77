"""Problem 7: token ids of every document by a public tokenizer.

The vocabulary file is read by each Python worker once; its path is a parameter.

Defined cases: null and empty texts have an empty list of ids; a document given twice comes out
twice; strings that look like special tokens are plain text; very long texts take linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import spread
from .transducer import Transducer, load_ranks, tokenizer_path

_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This process's transducer for a vocabulary; reused workers keep its states."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(load_ranks(path))
    return _LOADED[path]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids``: one row a document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(path).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, parts, ends, total = 0, [], [0], 0
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py())
                total += len(ids)
                parts.append(np.array(ids, np.int32))
                ends.append(total)
                if total > 4_000_000 or i == batch.num_rows - 1:
                    flat = pa.array(np.concatenate(parts), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat)
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), lists], names=[key, "ids"])
                    start, parts, ends, total = i + 1, [], [0], 0

    return spread(df.select(key, text)).mapInArrow(run, f"{key} long, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_tokens``: only the number of ids of each document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(path).encode
        for batch in batches:
            counts = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "n_tokens"])

    return spread(df.select(key, text)).mapInArrow(run, f"{key} long, n_tokens long")


def decoded(ids: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key, text`` from ``key, ids``; null ids give an empty text."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = transducer(path).decoder()
        for batch in batches:
            texts = [decoder.feed(x.as_py() or []) + decoder.finish() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} long, text string")
