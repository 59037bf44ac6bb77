"""The extraction operator: files in, entities out.

Each file gives its functions, classes, types and one row for itself, numbered by their place in the file: ``(file_path, seq)``
orders all entities, whichever files are extracted together. A file that can't be read gives its file row at least; nothing stops the others.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import ENTITY
from .braces import brace_entities
from .python_source import python_entities

log = logging.getLogger(__name__)


def extract(text: str, language: str) -> tuple[list[dict], list[dict], list[dict], list[str]]:
    """Functions, classes, types and imports of one text."""
    return python_entities(text) if language == "python" else brace_entities(text, language)


def file_rows(path: str, language: str, content: bytes | None, repo: str) -> list[dict]:
    """All entities of one file; ``seq`` is the place in it."""
    text = (content or b"").decode("utf-8", "replace")
    try:
        functions, classes, types, imports = extract(text, language)
    except Exception:  # noqa: BLE001
        log.exception("could not parse %s", path)
        functions, classes, types, imports = [], [], [], []
    rows = [{"entity_type": t, **e} for t, part in (("function", functions), ("class", classes), ("type", types)) for e in part]
    ids = []
    for r in rows:
        entity = f"{r['class_name']}.{r['name']}" if r["entity_type"] == "function" and r.get("class_name") else r["name"]
        ids.append(f"{repo}:{path}:{entity}")
    rows.append({"entity_type": "file", "name": path.rsplit("/", 1)[-1], "start_line": 1, "end_line": text.count("\n") + 1, "imports": imports, "defines": ids})
    for i, r in enumerate(rows):
        r |= {"repo": repo, "file_path": path, "language": language, "seq": i}
    return rows


def extract_entities(files: DataFrame, repo: str) -> DataFrame:
    """Entities of ``file_path, language, content``; ``seq`` is the place in the file. One pass: contents are read once."""
    spark = files.sparkSession
    schema = to_arrow_schema(ENTITY)
    names = ENTITY.names
    shared = spark.sparkContext.broadcast(repo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, language, content in zip(*(b.column(i) for i in range(3))):
                rows = file_rows(path.as_py(), language.as_py(), content.as_py(), shared.value)
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema=schema)

    return files.select("file_path", "language", "content").mapInArrow(run, ENTITY)
