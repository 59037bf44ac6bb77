"""Small cases for what the driver's tables cannot show, with the expected rows written by hand as SQL.

Import resolution in all languages, call chains and paths with cycles and stubs, and an engine's answers over a small repository.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..engine import Engine
from ..operators import entities as E
from ..operators import graph as G
from ..operators import graph_queries as Q
from ..operators.imports import resolved_imports
from ..session import filesystem, fresh_path
from .snippets import values_sql

#: The files of a repository that imports may mean, in the order they were scanned.
KNOWN = [
    "pkg/util.py", "src/pkg/util.py", "pkg/deep/__init__.py", "src/only.py", "web/lib/util.ts", "web/lib/index/index.tsx", "web/both.js", "web/both.ts", "svc/store.go", "pkg/svc/queue.go", "cmd/run/main.go", "internal/secret.go",
    "src/a/b.rs", "src/a/mod.rs", "core/x/mod.rs", "p/Q.java", "src/p/Q.java", "src/main/java/p/R.java", "app/src/main/java/p/S.java", "src/p/S.java", "native/u.h", "include/v.h", "src/w.h", "u.h", "lib/deep/far.h",
]
#: Language, importing file, import, the file it means (null if it lies outside), whether it is relative.
CASES = [
    ("python", "main.py", "pkg.util", "pkg/util.py", False), ("python", "main.py", "pkg.deep", "pkg/deep/__init__.py", False), ("python", "main.py", "only", "src/only.py", False), ("python", "main.py", "os.path", None, False),
    ("python", "main.py", "pytest", None, False), ("python", "main.py", "numpy.linalg", None, False), ("python", "pkg/deep/m.py", "..util", "pkg/util.py", True), ("python", "pkg/m.py", ".util", "pkg/util.py", True),
    ("python", "pkg/deep/m.py", ".", "pkg/deep/__init__.py", True), ("python", "pkg/m.py", ".nothing", None, True),
    ("typescript", "web/app.ts", "./lib/util", "web/lib/util.ts", True), ("typescript", "web/app.ts", "./lib/index", "web/lib/index/index.tsx", True), ("typescript", "web/app.ts", "./both", "web/both.ts", True),
    ("javascript", "web/lib/x.js", "../both", "web/both.ts", True), ("javascript", "web/app.js", "lodash", None, False), ("typescript", "app.ts", "../web/both", None, True),
    ("go", "main.go", "svc/store", "svc/store.go", False), ("go", "main.go", "svc/queue", "pkg/svc/queue.go", False), ("go", "main.go", "run", "cmd/run/main.go", False), ("go", "main.go", "secret", "internal/secret.go", False),
    ("go", "main.go", "net/http", None, False), ("go", "main.go", "github.com/x/y", None, False),
    ("rust", "core/m.rs", "crate::a::b", "src/a/b.rs", True), ("rust", "core/m.rs", "crate::a", "src/a/mod.rs", True), ("rust", "core/m.rs", "self::x", "core/x/mod.rs", True), ("rust", "core/y/m.rs", "super::x", "core/x/mod.rs", True),
    ("rust", "core/m.rs", "std::io", None, False), ("rust", "core/m.rs", "rand::Rng", None, False), ("rust", "core/m.rs", "self", None, True),
    ("java", "Main.java", "p.Q", "p/Q.java", False), ("java", "Main.java", "p.R", "src/main/java/p/R.java", False), ("java", "Main.java", "p.S", "src/p/S.java", False), ("java", "Main.java", "java.util.List", None, False), ("java", "Main.java", "q.T", None, False),
    ("c", "native/a.c", "u.h", "native/u.h", False), ("c", "other/a.c", "u.h", "u.h", False), ("c", "a.c", "v.h", "include/v.h", False), ("cpp", "a.cpp", "w.h", "src/w.h", False), ("c", "lib/a.c", "deep/far.h", "lib/deep/far.h", False),
    ("c", "a.c", "<stdio>", None, False), ("cpp", "a.cpp", "vector", None, False), ("dart", "a.dart", "package:a/b.dart", None, False),
]


def resolver_cases(spark: SparkSession, d: str) -> DataFrame:
    """What every import of :data:`CASES` means among :data:`KNOWN`."""
    files = [(i, p, None, None) for i, p in enumerate(KNOWN)] + [(100 + i, c[1], c[0], [c[2]]) for i, c in enumerate(CASES)]
    rows = spark.createDataFrame(files, "seq long, file_path string, language string, imports array<string>").withColumn("entity_type", F.lit("file")).withColumn("repo", F.lit("r"))
    rows = E.complete(rows.withColumn("name", F.element_at(F.split("file_path", "/"), -1))).withColumn("id", F.concat(F.lit("f"), F.col("seq").cast("string")))
    return resolved_imports(rows).select("seq", "import", "resolved_path", "is_external", "is_relative")


#: Calls in the order of the text: two ways from a to d, a cycle c -> a, a call of oneself, and an unknown name.
CALLS = {"a": ["b", "c"], "b": ["d", "ghost"], "c": ["a", "d", "c"], "d": ["e"], "e": ["f"], "f": ["g"], "g": ["h"], "h": [], "lone": []}


def _chain_graph(spark: SparkSession) -> G.Graph:
    rows = spark.createDataFrame([(i, n, calls) for i, (n, calls) in enumerate(CALLS.items())], "seq long, name string, calls array<string>")
    rows = E.complete(rows.withColumn("entity_type", F.lit("function")).withColumn("repo", F.lit("r")).withColumn("file_path", F.lit("m.py")))
    return G.Graph.build(E.identified(rows))


def _flat(node: dict, child: str, parent: str, depth: int, rows: list[tuple], way: str) -> None:
    rows.append((way, len([r for r in rows if r[0] == way]), parent, node["id"].rsplit(":", 1)[-1], depth, node["truncated"], node["cycle"]))
    for x in node[child]:
        _flat(x, child, node["id"].rsplit(":", 1)[-1], depth + 1, rows, way)


def call_chain_cases(spark: SparkSession, d: str) -> DataFrame:
    """The trees of calls from ``a`` at the default depth and of callers of ``d`` at depth 2, node by node."""
    g, rows = _chain_graph(spark), []
    _flat(Q.call_chain(g, "r:m.py:a"), "calls", "", 0, rows, "outgoing")
    _flat(Q.call_chain(g, "r:m.py:d", 2, "incoming"), "callers", "", 0, rows, "incoming")
    return spark.createDataFrame(rows, "way string, place int, parent string, node string, depth int, truncated boolean, cycle boolean")


def find_path_cases(spark: SparkSession, d: str) -> DataFrame:
    """All simple paths at the default length, and at a shorter one."""
    g = _chain_graph(spark)
    short = F.array_join(F.transform("path", lambda x: F.element_at(F.split(x, ":"), -1)), ">").alias("path")
    out = None
    for a, b, most in (("a", "d", Q.PATH_LENGTH), ("a", "h", 6), ("a", "h", 5), ("h", "a", Q.PATH_LENGTH), ("a", "lone", Q.PATH_LENGTH)):
        part = Q.find_paths(g, f"r:m.py:{a}", f"r:m.py:{b}", most).select(F.lit(f"{a}-{b}-{most}").alias("asked"), short)
        out = part if out is None else out.unionByName(part)
    return out


REPOSITORY = {
    "__init__.py": "", "util.py": 'def helper():\n    """Finds the merged cache of the graph."""\n    return 1\n',
    "main.py": "import util\nimport os\n\nclass A(Base):\n    def go(self):\n        helper()\n        self.rest()\n\n    def rest(self):\n        print(1)\n\nclass Base:\n    pass\n",
    "shape.ts": "export interface Shape { area(): number; }\n", "build/gone.py": "def ignored(): pass\n",
}


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, file = filesystem(spark, path)
    out = fs.create(file, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def engine_answers(spark: SparkSession, d: str) -> DataFrame:
    """An engine indexes a repository, answers every question, indexes again, and applies changes; its answers as JSON.

    The repository and the state lie in the shared folder.
    """
    root = fresh_path(spark, "repository")
    folder = root.removeprefix("file://").removeprefix("file:")
    for name, text in REPOSITORY.items():
        _put(spark, f"{root}/repo/{name}", text)
    e = Engine(spark, Settings(f"{folder}/repo", storage_path=f"{root}/state", dimensions=64))
    rows: list[tuple[str, str]] = []
    say = lambda what, answer: rows.append((what, json.dumps(answer, sort_keys=True, separators=(",", ":"))))
    counts = lambda x: {k: x[k] for k in ("added", "updated", "deleted", "skipped", "errors")}
    say("status before", e.get_index_status()["status"])
    say("index", counts(e.index()))
    status = e.get_index_status()
    say("status", {"status": status["status"], "graph": status["graph"], "embeddings": status["embeddings"], "phase": status["indexing"]["phase"], "watcher": status["watcher_active"]})
    say("calls", {"count": e.get_function_calls("repo:main.py:A.go")["count"], "ids": [r["id"] for r in e.get_function_calls("repo:main.py:A.go")["calls"]]})
    say("callers", [r["id"] for r in e.get_callers("repo:util.py:helper")["callers"]])
    say("unknown callers", e.get_callers("repo:nowhere"))
    say("chain", e.get_call_chain("repo:main.py:A.go"))
    say("hierarchy", e.get_class_hierarchy("repo:main.py:A"))
    say("children", e.get_class_hierarchy("repo:main.py:Base", "children"))
    say("unknown class", e.get_class_hierarchy("repo:nowhere"))
    found = e.semantic_search("the merged cache of the graph", 1)
    say("search", {"count": found["count"], "ids": [r["id"] for r in found["results"]], "keys": sorted(found["results"][0])})
    say("search types", [r["id"] for r in e.semantic_search("shape", 60, "type")["results"]])
    say("search prefix", sorted(r["id"] for r in e.semantic_search("anything", 50, file_path_prefix="main")["results"]))
    say("bad path", e.reindex("nope"))
    say("reindex", {k: v for k, v in e.reindex().items() if k != "path"})
    say("full reindex", {k: v for k, v in e.reindex(full=True).items() if k != "path"})
    _put(spark, f"{root}/repo/util.py", "def helper():\n    return other()\n\ndef other(): pass\n")
    _put(spark, f"{root}/repo/new.py", "from util import helper\n")
    fs, gone = filesystem(spark, f"{root}/repo/main.py")
    fs.delete(gone, False)
    batch = spark.createDataFrame([("util.py", "upsert"), ("main.py", "upsert"), ("new.py", "upsert"), ("never.py", "delete"), ("build/gone.py", "upsert"), (None, "upsert")], "path string, change_type string")
    say("changes", counts(e.apply_changes(batch)))
    say("nodes", sorted(r.id for r in e.graph().nodes.collect()))
    say("edges", sorted(f"{r.src} {r.type} {r.dst}" for r in e.graph().edges.collect()))
    say("vectors", sorted(r.id for r in e.vectors().collect()))
    e.close()
    return spark.createDataFrame(rows, "asked string, answer string")


def settings_cases(spark: SparkSession, d: str) -> DataFrame:
    """What settings make of their values: lists, names, levels; and which values they refuse."""
    root = fresh_path(spark, "settings")
    folder = root.removeprefix("file://").removeprefix("file:")
    _put(spark, f"{root}/demo/a.py", "")
    rows = []
    for label, given in (("plain", {}), ("lists", {"include_dirs": "build, out ,", "log_level": "debug"}), ("named", {"repo_name": "other", "dimensions": 16}), ("missing", {"repo_path": f"{folder}/none"}), ("a file", {"repo_path": f"{folder}/demo/a.py"}),
                         ("level", {"log_level": "loud"}), ("dimensions", {"dimensions": 0})):
        try:
            s = Settings(**({"repo_path": f"{folder}/demo"} | given))
            rows.append((label, s.repo_name, ",".join(s.include_dirs), s.log_level, s.dimensions, s.storage_path.endswith("/.embeddings"), False))
        except ValueError:
            rows.append((label, None, None, None, None, None, True))
    return spark.createDataFrame(rows, "given string, repo_name string, include_dirs string, log_level string, dimensions int, stored_inside boolean, refused boolean")


_TREE = [
    ("outgoing", 0, "", "a", 0, False, False), ("outgoing", 1, "a", "b", 1, False, False), ("outgoing", 2, "b", "d", 2, False, False), ("outgoing", 3, "d", "e", 3, False, False), ("outgoing", 4, "e", "f", 4, False, False),
    ("outgoing", 5, "f", "g", 5, False, False), ("outgoing", 6, "g", "h", 6, True, False), ("outgoing", 7, "b", "ghost", 2, False, False), ("outgoing", 8, "a", "c", 1, False, False), ("outgoing", 9, "c", "a", 2, False, True),
    ("outgoing", 10, "c", "d", 2, False, True), ("outgoing", 11, "c", "c", 2, False, True),
    ("incoming", 0, "", "d", 0, False, False), ("incoming", 1, "d", "b", 1, False, False), ("incoming", 2, "b", "a", 2, False, False), ("incoming", 3, "a", "c", 3, True, False), ("incoming", 4, "d", "c", 1, False, False),
    ("incoming", 5, "c", "a", 2, False, True), ("incoming", 6, "c", "c", 2, False, True),
]
_PATHS = [("a-d-10", "a>b>d"), ("a-d-10", "a>c>d"), ("a-h-6", "a>b>d>e>f>g>h"), ("a-h-6", "a>c>d>e>f>g>h")]
_GO = "repo:main.py:A.go"
_ANSWERS = [
    ("status before", "indexing"), ("index", {"added": 6, "updated": 0, "deleted": 0, "skipped": 0, "errors": []}),
    ("status", {"status": "ready", "graph": {"total_nodes": 12, "total_edges": 14, "functions": 3, "classes": 2, "files": 4, "types": 1, "external_references": 2}, "embeddings": {"total": 6}, "phase": "complete", "watcher": False}),
    ("calls", {"count": 2, "ids": ["repo:util.py:helper", "repo:main.py:A.rest"]}), ("callers", [_GO]), ("unknown callers", {"function_id": "repo:nowhere", "callers": [], "count": 0}),
    ("chain", {"id": _GO, "name": "go", "file_path": "main.py", "truncated": False, "cycle": False, "calls": [
        {"id": "repo:util.py:helper", "name": "helper", "file_path": "util.py", "truncated": False, "cycle": False, "calls": []},
        {"id": "repo:main.py:A.rest", "name": "rest", "file_path": "main.py", "truncated": False, "cycle": False, "calls": [{"id": "external:print", "name": "print", "file_path": None, "truncated": False, "cycle": False, "calls": []}]}]}),
    ("hierarchy", {"id": "repo:main.py:A", "name": "A", "file_path": "main.py", "parents": [{"id": "repo:main.py:Base", "name": "Base", "file_path": "main.py", "is_external": False}], "children": []}),
    ("children", {"id": "repo:main.py:Base", "name": "Base", "file_path": "main.py", "children": [{"id": "repo:main.py:A", "name": "A", "file_path": "main.py"}]}),
    ("unknown class", {"id": "repo:nowhere", "name": "unknown", "file_path": None, "parents": [], "children": []}),
    ("search", {"count": 1, "ids": ["repo:util.py:helper"], "keys": ["class_name", "docstring", "end_line", "entity_type", "file_path", "id", "name", "score", "signature", "start_line"]}),
    ("search types", ["repo:shape.ts:Shape"]), ("search prefix", ["repo:main.py:A", _GO, "repo:main.py:A.rest", "repo:main.py:Base"]), ("bad path", {"error": "Path does not exist: nope", "path": "nope"}),
    ("reindex", {"full_reindex": False, "entities_parsed": 10, "graph": {"nodes": 12, "edges": 14}, "embeddings": {"added": 0, "updated": 0, "deleted": 0, "skipped": 6, "errors": []}}),
    ("full reindex", {"full_reindex": True, "entities_parsed": 10, "graph": {"nodes": 12, "edges": 14}, "embeddings": {"added": 6, "updated": 0, "deleted": 6, "skipped": 0, "errors": []}}),
    ("changes", {"added": 1, "updated": 1, "deleted": 4, "skipped": 0, "errors": []}),
    ("nodes", ["repo:__init__.py", "repo:new.py", "repo:shape.ts", "repo:shape.ts:Shape", "repo:util.py", "repo:util.py:helper", "repo:util.py:other"]),
    ("edges", ["repo:new.py imports repo:util.py", "repo:shape.ts defines repo:shape.ts:Shape", "repo:util.py defines repo:util.py:helper", "repo:util.py defines repo:util.py:other", "repo:util.py:helper calls repo:util.py:other"]),
    ("vectors", ["repo:shape.ts:Shape", "repo:util.py:helper", "repo:util.py:other"]),
]
QUERIES = {"resolver_cases": resolver_cases, "call_chain_cases": call_chain_cases, "find_path_cases": find_path_cases, "engine_answers": engine_answers, "settings_cases": settings_cases}
ORACLES = {
    "resolver_cases": values_sql('seq, "import", resolved_path, is_external, is_relative', [(100 + i, c[2], c[3], c[3] is None, c[4]) for i, c in enumerate(CASES)]),
    "call_chain_cases": values_sql("way, place, parent, node, depth, truncated, cycle", _TREE),
    "find_path_cases": values_sql("asked, path", _PATHS),
    "engine_answers": values_sql("asked, answer", [(k, json.dumps(v, sort_keys=True, separators=(",", ":"))) for k, v in _ANSWERS]),
    "settings_cases": values_sql("given, repo_name, include_dirs, log_level, dimensions, stored_inside, refused", [
        ("plain", "demo", "", "INFO", 768, True, False), ("lists", "demo", "build,out", "DEBUG", 768, True, False), ("named", "other", "", "INFO", 16, True, False),
        *((x, None, None, None, None, None, True) for x in ("missing", "a file", "level", "dimensions"))]),
}
