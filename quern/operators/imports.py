"""Imports to files: every language gives an ordered array of candidate paths, one join finds the first that exists.

Defined cases: a null import gives no row; an unknown language and an empty array of candidates mean an external
import; of equal paths in a repository the first file counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First parts of imports that lie outside the repository.
PYTHON_EXTERNAL = (
    "os", "sys", "re", "json", "logging", "pathlib", "typing", "collections", "itertools", "functools", "dataclasses", "abc", "hashlib",
    "datetime", "time", "unittest", "pytest", "asyncio", "enum", "copy", "io", "tempfile", "shutil", "glob", "subprocess")
GO_EXTERNAL = (
    "fmt", "os", "io", "net", "sync", "context", "strings", "strconv", "encoding", "errors", "log", "path", "time", "testing", "flag", "bytes",
    "bufio", "sort", "math", "crypto", "database", "html", "regexp", "runtime", "reflect", "unsafe", "debug")
JAVA_EXTERNAL = ("java.", "javax.", "sun.")
#: Where each language's sources may lie, in order.
PYTHON_ROOTS, GO_ROOTS = ("", "src/"), ("", "pkg/", "internal/", "cmd/")
JAVA_ROOTS = ("", "src/", "src/main/java/", "app/src/main/java/")
TS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
C_ROOTS = ("include/", "src/")

_EMPTY = "cast(array() as array<string>)"


def _arr(*xs: Column) -> Column:
    return F.array(*xs)


def _empty() -> Column:
    return F.expr(_EMPTY)


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), r"/+$", "")


def normal(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; ``..`` beyond the top stays, so that such a path is no file's."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = lambda acc: (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
    step = lambda acc, x: F.when((x == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.expr(_EMPTY), step), "/")


def join_path(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def python_candidates(imp: Column, context: Column) -> Column:
    """Dots in front climb from the file's folder; otherwise the module below the roots, unless known to lie outside."""
    dots = F.length(F.regexp_extract(imp, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(imp, r"^\.+", ""), r"\.", "/")
    folder = parent(context)
    ups = F.filter(F.split(folder, "/"), lambda x: x != "")
    base = F.array_join(F.slice(ups, F.lit(1), F.greatest(F.size(ups) - (dots - 1), F.lit(0))), "/")
    target = F.when(rest == "", base).otherwise(join_path(base, rest))
    relative = _arr(F.concat(target, F.lit(".py")), join_path(target, F.lit("__init__.py")))
    module = F.regexp_replace(imp, r"\.", "/")
    absolute = _arr(*[F.concat(F.lit(root), module, F.lit(tail)) for root in PYTHON_ROOTS for tail in (".py", "/__init__.py")])
    outside = F.split(imp, r"\.")[0].isin(*PYTHON_EXTERNAL)
    return F.when(imp.startswith("."), relative).when(outside, _empty()).otherwise(absolute)


def script_candidates(imp: Column, context: Column) -> Column:
    base = normal(join_path(parent(context), imp))
    tries = _arr(*[F.concat(base, F.lit(s)) for s in TS_SUFFIXES])
    return F.when(imp.startswith("./") | imp.startswith("../"), tries).otherwise(_empty())


def go_candidates(imp: Column, context: Column) -> Column:
    imp = F.regexp_replace(imp, """^["']+|["']+$""", "")
    first = F.split(imp, "/")[0]
    tries = _arr(*[F.concat(F.lit(root), imp, F.lit(tail)) for root in GO_ROOTS for tail in (".go", "/main.go")])
    return F.when(F.contains(first, F.lit(".")) | first.isin(*GO_EXTERNAL), _empty()).otherwise(tries)


def rust_candidates(imp: Column, context: Column) -> Column:
    """What follows ``self``, ``super`` or ``crate`` below the file's folder, its parent or ``src``; other crates lie outside."""
    parts = F.split(imp, "::")
    first = parts[0]
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), "/")
    folder = parent(context)
    base = F.when(first == "super", parent(folder)).when(first == "crate", F.lit("src")).otherwise(folder)
    local = normal(join_path(base, rest))
    tries = _arr(F.concat(local, F.lit(".rs")), F.concat(local, F.lit("/mod.rs")))
    return F.when(first.isin("self", "super", "crate") & (rest != ""), tries).otherwise(_empty())


def java_candidates(imp: Column, context: Column) -> Column:
    path = F.regexp_replace(imp, r"\.", "/")
    outside = F.lit(False)
    for p in JAVA_EXTERNAL:
        outside = outside | imp.startswith(p)
    return F.when(outside, _empty()).otherwise(_arr(*[F.concat(F.lit(root), path, F.lit(".java")) for root in JAVA_ROOTS]))


def c_candidates(imp: Column, context: Column) -> Column:
    name = F.regexp_replace(imp, """^[<>"']+|[<>"']+$""", "")
    tries = _arr(normal(join_path(parent(context), name)), normal(name), *[normal(F.concat(F.lit(root), name)) for root in C_ROOTS])
    return F.when(name.endswith(".h"), tries).otherwise(_empty())


RESOLVERS = {
    "python": python_candidates, "typescript": script_candidates, "javascript": script_candidates, "go": go_candidates, "rust": rust_candidates,
    "java": java_candidates, "c": c_candidates, "cpp": c_candidates}


def import_candidates(language: Column, imp: Column, context: Column) -> Column:
    """The paths an import may mean, best first; none for an external one."""
    out = _empty()
    for name, rule in RESOLVERS.items():
        out = F.when(F.lower(language) == name, rule(imp, context)).otherwise(out)
    return out


#: Suffixes of the languages.
SUFFIXES = {
    "py": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hxx": "cpp", "h++": "cpp", "dart": "dart"}


def language_of(path: Column) -> Column:
    """The language by the lower-cased suffix, or null."""
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    name = F.element_at(F.split(path, "/"), -1)
    # A name that only starts with a dot has no suffix.
    return F.try_element_at(table, F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)))


def path_suffixes(files: DataFrame) -> DataFrame:
    """``repo, suffix, id``: the first file for every path and every tail of it that starts at a segment."""
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = files.where("file_path is not null").select("repo", "id", "seq", F.explode(tails).alias("suffix"))
    return rows.groupBy("repo", "suffix").agg(F.min_by("id", "seq").alias("id"))


def resolved_imports(entities: DataFrame) -> DataFrame:
    """``id, repo, file_path, seq, pos, import, resolved_path, resolved_id, is_external, is_relative`` of every import of a file.

    The first candidate that is a file's path is what the import resolves to; the node is the first file of
    that path or of one that ends with it. Both are joins by equality.
    """
    files = entities.where("entity_type = 'file' and id is not null")
    language = F.coalesce(F.lower(F.trim("language")), language_of(F.col("file_path")))
    rows = files.select("id", "repo", "file_path", "seq", language.alias("language"), F.posexplode("imports").alias("pos", "import")).where("import is not null and import <> ''")
    rows = rows.withColumn("candidates", import_candidates(F.col("language"), F.col("import"), F.col("file_path")))
    known = files.where("file_path is not null").select(F.col("repo").alias("_repo"), F.col("file_path").alias("_path")).distinct()
    tries = rows.select("id", "pos", "repo", F.posexplode("candidates").alias("rank", "candidate"))
    exact = tries.join(known, (F.col("repo") == F.col("_repo")) & (F.col("candidate") == F.col("_path")))
    hit = exact.groupBy("id", "pos").agg(F.min_by("_path", "rank").alias("resolved_path"))
    tails = path_suffixes(files).select(F.col("repo").alias("_repo"), F.col("suffix").alias("_suffix"), F.col("id").alias("resolved_id"))
    out = rows.join(hit, ["id", "pos"], "left").join(tails, (F.col("repo") == F.col("_repo")) & (F.col("resolved_path") == F.col("_suffix")), "left")
    relative = F.col("import").startswith(".") | F.col("import").rlike(r"^(self|super|crate)\b")
    return out.select("id", "repo", "file_path", "seq", "pos", "import", "resolved_path", "resolved_id", F.col("resolved_path").isNull().alias("is_external"), relative.alias("is_relative"))
