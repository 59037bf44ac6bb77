"""Source files of a repository, filtered by path before any content is read.

Defined cases: paths are relative to the root; a null path is ignored; files without a known suffix are left out; bytes that are
no UTF-8 are replaced; an empty folder gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.imports import SUFFIXES, language_of

#: Folders that hold no sources of the repository itself.
IGNORED = (
    ".git", ".svn", ".hg",
    "__pycache__", ".venv", "venv", ".env", "env", "ENV", ".tox", ".nox", ".pytest_cache", ".mypy_cache", ".pytype", ".ruff_cache", ".coverage", "htmlcov", "coverage", ".eggs", "egg-info", "wheels", "sdist", ".Python", "lib64",
    "node_modules", ".npm", ".pnpm-store", ".yarn", "bower_components", ".cache", ".parcel-cache", ".turbo", ".next", ".nuxt", ".svelte-kit", ".vitepress", ".docusaurus", ".astro", ".remix", "storybook-static", ".vercel", ".netlify",
    "android", "ios", ".expo", ".expo-shared", "Pods", ".bundle", "DerivedData", "xcuserdata",
    "vendor", "bin", "pkg",
    "target",
    ".dart_tool", ".pub-cache", ".pub", ".packages", ".fvm",
    ".gradle", ".mvn", ".settings",
    "CMakeFiles", "cmake-build-debug", "cmake-build-release", "Debug", "Release", "x64", "x86", "ipch", ".ccls-cache",
    ".idea", ".vscode", ".vs", ".eclipse", "nbproject",
    "dist", "build", "out", ".output",
    "logs", "log", "tmp", "temp", ".tmp", ".temp", ".local",
)
#: Folders with a leading dot that are kept.
DOTTED = (".github", ".gitlab")


def ignored(path: Column, include_dirs: tuple[str, ...] = ()) -> Column:
    """True if a part of the path is an ignored folder or starts with a dot; parts in ``include_dirs`` pass."""
    bad = lambda p: (p.isin(*IGNORED) | (p.startswith(".") & ~p.isin(*DOTTED))) & (~p.isin(*include_dirs) if include_dirs else F.lit(True))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.exists(parts, bad)


def should_process(path: Column, suffixes: tuple[str, ...] | None = None) -> Column:
    """Whether a changed file counts: not ignored, and of a known (or given) suffix."""
    known = F.lower(F.regexp_extract(path, r"(?s)[^/]\.([^./]+)$", 1)).isin(*(s.lstrip(".").lower() for s in suffixes)) if suffixes else language_of(path).isNotNull()
    return F.coalesce(~ignored(path) & known, F.lit(False))


def is_ignored(path: str, include_dirs: tuple[str, ...] = ()) -> bool:
    """As :func:`ignored`, of one path."""
    return any((p in IGNORED or p.startswith(".") and p not in DOTTED) and p not in include_dirs for p in path.split("/") if p not in ("", "."))


def _filesystem(root: str):
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    return fs.LocalFileSystem(), root


def list_sources(root: str, include_dirs: tuple[str, ...] = (), strict_abs: bool = False) -> list[tuple[str, int, object]]:
    """``(relative path, size, time)`` of the supported files; ignored folders are not entered.

    Spark's own file index would hide names with a leading ``_``, such as ``__init__.py``.
    """
    from pyarrow import fs

    system, top = _filesystem(root)
    if strict_abs and is_ignored(top, include_dirs):
        return []
    out, open_ = [], [top.rstrip("/")]
    while open_:
        for info in system.get_file_info(fs.FileSelector(open_.pop())):
            relative = info.path[len(top.rstrip("/")) + 1:]
            if is_ignored(relative, include_dirs):
                continue
            if info.type == fs.FileType.Directory:
                open_.append(info.path)
            elif info.type == fs.FileType.File and "." in info.base_name[1:] and info.base_name.rsplit(".", 1)[-1].lower() in SUFFIXES:
                out.append((relative, info.size, info.mtime))
    return sorted(out)


_FILES = "file_path string, size long, modified_at timestamp"


def source_files(spark: SparkSession, root: str, include_dirs: tuple[str, ...] = (), strict_abs: bool = False) -> DataFrame:
    """``file_path, language, content, modified_at`` of every supported file below ``root``.

    The driver holds the listing, as Spark's file sources do; contents are read by the tasks, some 64 MB each.
    """
    found = list_sources(root, include_dirs, strict_abs)
    files = spark.createDataFrame(found, _FILES)
    parts = max(1, min(len(found), max(sum(f[1] for f in found) // 64_000_000 + 1, spark.sparkContext.defaultParallelism if len(found) > 200 else 1)))
    return read_files(files.select("file_path", "modified_at").repartition(parts), root)


def read_files(files: DataFrame, root: str) -> DataFrame:
    """``file_path, language, content, modified_at`` of the named files that exist below ``root``; the tasks read them, nothing is listed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _filesystem(root)
        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                try:
                    with system.open_input_stream(f"{top.rstrip('/')}/{path}") as f:
                        content = f.read()
                except OSError:  # not there, or gone since the listing
                    continue
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([content], pa.binary())], names=["file_path", "modified_at", "content"])

    rows = files.select("file_path", "modified_at").mapInArrow(read, "file_path string, modified_at timestamp, content binary")
    return rows.select("file_path", language_of(F.col("file_path")).alias("language"), "content", "modified_at")
