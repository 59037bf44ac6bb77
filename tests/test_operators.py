import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.config import Settings
from quern.engine import Engine
from quern.operators import entities as E
from quern.operators import imports as I
from quern.operators import sync as Y
from quern.operators import vectors as V
from quern.operators.encode import HashEncoder, encoder_for, truncated
from quern.sources.scan import is_ignored, ignored, should_process
from quern.streaming import changes as C


IMPORTS = [
    ("python", "a.b", "x/y.py", ["a/b.py", "a/b/__init__.py", "src/a/b.py", "src/a/b/__init__.py"]), ("python", "os.path", "x.py", []), ("python", ".m", "p/q/r.py", ["p/q/m.py", "p/q/m/__init__.py"]),
    ("python", "..m.n", "p/q/r.py", ["p/m/n.py", "p/m/n/__init__.py"]), ("python", ".", "p/q.py", ["p.py", "p/__init__.py"]), ("python", "....m", "p/q.py", ["m.py", "m/__init__.py"]),
    ("typescript", "./u", "a/b.ts", ["a/u.ts", "a/u.tsx", "a/u.js", "a/u.jsx", "a/u/index.ts", "a/u/index.tsx", "a/u/index.js", "a/u/index.jsx"]), ("javascript", "react", "a.js", []),
    ("go", "x/y", "m.go", ["x/y.go", "x/y/main.go", "pkg/x/y.go", "pkg/x/y/main.go", "internal/x/y.go", "internal/x/y/main.go", "cmd/x/y.go", "cmd/x/y/main.go"]), ("go", "fmt", "m.go", []), ("go", "github.com/a/b", "m.go", []),
    ("rust", "std::io", "a.rs", []), ("rust", "self::x", "s/a.rs", ["s/x.rs", "s/x/mod.rs"]), ("rust", "super::x", "s/t/a.rs", ["s/x.rs", "s/x/mod.rs"]),
    ("rust", "crate::a::b", "s/m.rs", ["src/a/b.rs", "src/a/b/mod.rs"]), ("rust", "crate", "s/m.rs", []), ("rust", "super", "s/m.rs", []), ("typescript", "../x", "a.ts", ["../x.ts", "../x.tsx", "../x.js", "../x.jsx", "../x/index.ts", "../x/index.tsx", "../x/index.js", "../x/index.jsx"]), ("rust", "rand::Rng", "a.rs", []),
    ("java", "java.util.List", "A.java", []), ("java", "p.Q", "A.java", ["p/Q.java", "src/p/Q.java", "src/main/java/p/Q.java", "app/src/main/java/p/Q.java"]),
    ("c", "<stdio.h>", "s/a.c", ["s/stdio.h", "stdio.h", "include/stdio.h", "src/stdio.h"]), ("cpp", '"x.hpp"', "a.cpp", []), ("cpp", "../u.h", "s/t/a.cpp", ["s/u.h", "../u.h", "u.h", "u.h"]), ("dart", "package:a/b.dart", "a.dart", []), (None, "x", "y", [])]


def test_import_candidates(spark):
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(IMPORTS)], "n int, l string, i string, c string")
    got = {r.n: r.x for r in df.select("n", I.import_candidates(F.col("l"), F.col("i"), F.col("c")).alias("x")).collect()}
    for n, (language, imp, context, want) in enumerate(IMPORTS):
        assert got[n] == want, (language, imp, context)


def test_paths_of_files(spark):
    rows = [("src/a.py", False, True), ("node_modules/x.js", True, False), (".github/a.py", False, True), (".x/a.py", True, False), ("a/build/b.go", True, False), ("a/b.H++", False, True), ("a.txt", False, False), (".py", True, False), ("Makefile", False, False)]
    df = spark.createDataFrame(rows, "p string, i boolean, s boolean")
    for r in df.select("*", ignored(F.col("p")).alias("gi"), should_process(F.col("p")).alias("gs"), ignored(F.col("p"), ("build",)).alias("inc")).collect():
        assert (r.gi, r.gs) == (r.i, r.s), r
        assert is_ignored(r.p) == r.i and r.inc == (r.i and "build" not in r.p)
    assert spark.range(1).select(should_process(F.lit(None).cast("string")).alias("x")).first().x is False


def test_identity_hash_text_and_metadata(spark):
    rows = [("function", "r", "a/b.py", "m", "Outer.Inner", "code", None, None, None), ("class", "r", "a.py", "K", None, "body", "doc", ["z", "b"], ["d"]), ("type", "r", "t.go", "T", None, "def", None, None, None), ("file", "r", "f.py", "f.py", None, None, None, None, None), ("function", None, None, None, None, None, None, None, None)]
    df = E.identified(E.complete(spark.createDataFrame(rows, "entity_type string, repo string, file_path string, name string, class_name string, code string, docstring string, bases array<string>, decorators array<string>")))
    got = {r.entity_type + str(r.name): r for r in df.select("*", E.embedding_text().alias("text"), E.file_of_id(F.col("id")).alias("file")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    m, k, t, f = got["functionm"], got["classK"], got["typeT"], got["filef.py"]
    assert m.id == "r:a/b.py:Outer.Inner.m" and m.file == "a/b.py" and m.content_hash == sha("code") and m.text == "File: a/b.py\nClass: Outer.Inner\nMethod: m\nCode:\ncode"
    assert k.content_hash == sha("K:b,z:d") and k.text == "File: a.py\nClass: K\nInherits: z, b\nDescription: doc\nDecorators: d\nDefinition:\nbody"
    assert t.content_hash == sha("def") and f.id == "r:f.py" and f.file == "f.py" and f.content_hash is None and got["functionNone"].id is None
    flat = E.flat_metadata({"a": F.lit("x"), "n": F.lit(None), "l": F.array(F.lit("p"), F.lit("q"))}, {"l"})
    assert spark.range(1).select(flat.alias("m")).first().m == {"a": "x", "l": "p,q"}


def vectors(spark):
    rows = [("a", [1.0, 0.0], "r", "function", "x/1", "h"), ("b", [0.9, 0.1], "r", "class", "x/2", None), ("c", [0.0, 1.0], "q", "function", "y/3", "h3"), ("d", [0.0, 0.0], "r", "function", "y/4", "h"), ("e", None, "r", "function", "y/5", "h"), ("f", [1.0], "r", "function", "y", "h"), ("a2", [2.0, 0.0], "r", "function", "y/6", "h")]
    return spark.createDataFrame(rows, "id string, embedding array<float>, repo string, entity_type string, file_path string, content_hash string")


def test_vector_search(spark):
    v = vectors(spark)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(V.search(v, [1.0, 0.0])) == ["a", "a2", "b", "c"] and ids(V.search(v, [1.0, 0.0], 1)) == ["a"]
    assert ids(V.search(v, [1.0, 0.0], equal={"repo": "r", "entity_type": "class"})) == ["b"]
    assert ids(V.search(v, [1.0, 0.0], 1, prefix=("file_path", "y/"))) == ["a2"] and ids(V.search(v, [1.0, 0.0], 1, prefix=("file_path", "y/3"), overfetch=3)) == []
    with pytest.raises(ValueError):
        V.search(v, [1.0], 0)
    assert V.count(v) == 7 and V.count(v, repo="q") == 1 and V.without_file(v, "r", "x/1").count() == 6 and V.without_repo(v, "r").count() == 1 and ids(V.get_by_id(v, "c")) == ["c"]
    assert {r.id: r.content_hash for r in V.content_hashes(v, "r").collect()}["b"] == "" and V.search(v.limit(0), [1.0, 0.0]).collect() == []
    assert V.upserted(v, v.where("id = 'a'")).count() == 7 and V.without_ids(v, v.where("id = 'a'")).count() == 6


def test_encoder(spark):
    df = spark.createDataFrame([(1, "merge the graph"), (2, "merge the graph"), (3, None), (4, "")], "i int, t string")
    got = {r.i: list(r.v) for r in df.select("i", HashEncoder(32).encode(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[3] == got[4] == [0.0] * 32
    assert spark.range(1).select(F.size(truncated(F.array_repeat(F.lit(1.0), 9), 4)).alias("n")).first().n == 4
    with pytest.raises(ValueError):
        encoder_for("nothing")


def test_sync_actions(spark):
    given = spark.createDataFrame([("r:a:1", "x"), ("r:a:2", "new"), ("r:a:3", "x"), (None, "x")], "id string, content_hash string")
    stored = spark.createDataFrame([("r:a:1", "x"), ("r:a:2", "old"), ("r:a:4", "x"), ("r:b:5", "x"), ("r:a:3", None)], "id string, content_hash string")
    acts = {r.id: r.action for r in Y.actions(given, stored).collect()}
    assert acts == {"r:a:1": "skipped", "r:a:2": "updated", "r:a:3": "updated", "r:a:4": "deleted", None: "added"}
    assert {r.id: r.action for r in Y.actions(given, stored, reconcile=True).collect()}["r:b:5"] == "deleted"
    assert Y.summary(Y.actions(given.limit(0), stored.limit(0))).first().total_processed == 0


def test_changes(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a.py", "upsert", t(0)), ("a.py", "delete", t(3)), ("b.py", "upsert", t(7)), ("a.py", "upsert", t(20)), ("a.py", "delete", t(20)), ("c.py", "upsert", t(3599)), ("c.py", "delete", t(3602)), ("d.py", "upsert", None), ("e.py", "upsert", t(9000))]
    df = spark.createDataFrame(rows, "path string, change_type string, event_time timestamp")
    got = {(r.batch, r.path): r.change_type for r in C.batch_sessions(df).collect()}
    assert got == {(1, "a.py"): "delete", (1, "b.py"): "upsert", (2, "a.py"): "delete", (3, "c.py"): "delete", (4, "e.py"): "upsert"}
    moved = spark.createDataFrame([("moved", "a", "b", False, t(0)), ("modified", "d", None, True, t(0)), ("deleted", "c", None, None, t(0)), ("other", "c", None, False, t(0))], "event string, path string, dest string, is_directory boolean, event_time timestamp")
    assert sorted((r.path, r.change_type) for r in C.exploded_moves(moved).collect()) == [("a", "delete"), ("b", "upsert"), ("c", "delete")]
    assert {r.path: r.change_type for r in C.corrected(df.where("path in ('a.py', 'b.py')"), spark.createDataFrame([("b.py",)], "path string")).collect()} == {"a.py": "delete", "b.py": "upsert"}


def test_settings(tmp_path, monkeypatch):
    s = Settings(str(tmp_path), include_dirs="build, x", log_level="debug")
    assert s.repo_name == tmp_path.name and s.include_dirs == ("build", "x") and s.log_level == "DEBUG" and s.storage_path.endswith(".embeddings")
    monkeypatch.setenv("DIMENSIONS", "16")
    assert Settings.from_environment(repo_path=str(tmp_path)).dimensions == 16
    for bad in ({"repo_path": str(tmp_path / "no")}, {"log_level": "loud"}, {"dimensions": 0}):
        with pytest.raises(ValueError):
            Settings(**({"repo_path": str(tmp_path)} | bad))


def test_engine_end_to_end(spark, tmp_path):
    repo, store = tmp_path / "repo", tmp_path / "store"
    repo.mkdir()
    (repo / "__init__.py").write_text("")
    (repo / "util.py").write_text('def helper():\n    """Finds the merged cache of the graph."""\n    return 1\n')
    (repo / "main.py").write_text("import util\nclass A(Base):\n    def go(self):\n        helper()\nclass Base: pass\n")
    e = Engine(spark, Settings(str(repo), storage_path=str(store), dimensions=64))
    assert e.get_index_status()["status"] == "indexing" and e.index()["added"] == 4 and e.index()["skipped"] == 4
    status = e.get_index_status()
    assert status["status"] == "ready" and status["graph"]["files"] == 3 and status["embeddings"]["total"] == 4
    assert e.get_callers("repo:util.py:helper")["callers"][0]["id"] == "repo:main.py:A.go" and e.get_function_calls("repo:main.py:A.go")["count"] == 1
    assert e.get_class_hierarchy("repo:main.py:A")["parents"][0]["id"] == "repo:main.py:Base" and e.get_call_chain("repo:main.py:A.go")["calls"][0]["name"] == "helper"
    found = e.semantic_search("the merged cache of the graph", 1)
    assert found["results"][0]["id"] == "repo:util.py:helper" and set(found["results"][0]) >= {"signature", "docstring", "score"}
    assert "error" in e.reindex("nope") and "error" in e.reindex("util.py", full=True)
    changes, check = tmp_path / "changes", tmp_path / "check"
    changes.mkdir()
    (repo / "util.py").write_text("def helper():\n    return other()\ndef other(): pass\n")
    (repo / "main.py").unlink()
    lines = [{"path": p, "change_type": c, "event_time": "2024-01-01T00:00:00"} for p, c in (("util.py", "upsert"), ("main.py", "delete"), ("x.txt", "upsert"))]
    (changes / "1.json").write_text("\n".join(map(json.dumps, lines)))
    query = e.watch(str(changes), str(check))
    query.processAllAvailable()
    e.stop()
    assert {r.id for r in e.graph().nodes.collect()} == {"repo:__init__.py", "repo:util.py", "repo:util.py:helper", "repo:util.py:other"}
    assert {r.id for r in e.vectors().collect()} == {"repo:util.py:helper", "repo:util.py:other"}
    assert e.reindex(full=True)["embeddings"]["added"] == 2


def test_updates_equal_a_full_build(spark, tmp_path):
    import random

    repo = tmp_path / "repo"
    repo.mkdir()
    r = random.Random(3)
    names = ["a.py", "b.py", "m.py", "z.py"]

    def edit(name):
        defs = "".join(f"def {f}():\n    {r.choice('fghk')}()\n" for f in r.sample("fghk", r.randrange(0, 4)))
        (repo / name).write_text(f"import {r.choice('abmz')}\nclass K{r.randrange(2)}(Base):\n    def go(self):\n        f()\n" + defs)

    for n in names:
        edit(n)
    e = Engine(spark, Settings(str(repo), storage_path=str(tmp_path / "s"), dimensions=8))
    e.index()
    other = Engine(spark, Settings(str(repo), storage_path=str(tmp_path / "t"), dimensions=8))
    for changed in (["z.py"], ["a.py", "m.py"]):
        for n in changed:
            edit(n)
        if "a.py" in changed:
            (repo / "b.py").unlink()
            changed = [*changed, "b.py"]
        before = e.store.version()
        e.apply_changes(spark.createDataFrame([(n, "upsert") for n in changed], "path string, change_type string"))
        assert e.store.version() == before + 1
        other.index(reconcile=True)
        for table, columns in (("nodes", ["id", "type", "file_path", "start_line"]), ("edges", ["src", "dst", "type"]), ("vectors", ["id", "content_hash"])):
            assert set(e._table(table).select(*columns).collect()) == set(other._table(table).select(*columns).collect()), table


def test_a_repository_keeps_out_of_another(spark):
    given = spark.createDataFrame([("B:src/a.py:f", "x")], "id string, content_hash string")
    stored = spark.createDataFrame([("A:src/a.py:g", "x"), ("B:src/a.py:h", "x")], "id string, content_hash string")
    assert {r.id: r.action for r in Y.actions(given, stored).collect()} == {"B:src/a.py:f": "added", "B:src/a.py:h": "deleted"}


class Failing(HashEncoder):
    def encode(self, text, is_query=False):
        from quern.operators.encode import in_batches

        def run(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return [[1.0, 0.0] for _ in texts]

        return in_batches(text, run, 1)


def test_what_cannot_be_encoded_is_an_error(spark):
    rows = [("function", "r", "a.py", n, c) for n, c in (("f", "fine"), ("g", "boom"), ("h", "boom"))]
    df = E.identified(E.complete(spark.createDataFrame(rows, "entity_type string, repo string, file_path string, name string, code string"))).withColumn("seq", F.monotonically_increasing_id())
    stored = spark.createDataFrame([("r:a.py:h", [0.5, 0.5], "old", "r", "a.py")], "id string, embedding array<float>, content_hash string, repo string, file_path string")
    out, acts = Y.sync(df, stored, Failing(2))
    assert {r.id: r.action for r in acts.collect()} == {"r:a.py:f": "added", "r:a.py:g": "failed", "r:a.py:h": "failed"} and Y.summary(acts).first().total_processed == 1
    assert {r.id: r.content_hash for r in out.collect()}["r:a.py:h"] == "old" and out.count() == 2


def test_encoders_of_models_and_servers(spark):
    import http.server
    import threading

    from quern.operators.encode import HttpEncoder, ModelEncoder

    df = spark.createDataFrame([("abc",), ("de",)], "t string")
    model = ModelEncoder(lambda: lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts], 2, "lengths")
    assert [list(r.v) for r in df.select(model.encode(F.col("t")).alias("v")).collect()] == [[20.0, 1.0], [19.0, 1.0]] and df.select(model.encode(F.col("t"), True).alias("v")).first().v[0] == 17

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [float(len(asked["prompt"])), 7.0 if asked["model"] == "m" else 0.0]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        encoder = encoder_for("http", url=f"http://127.0.0.1:{server.server_port}", model="m")
        assert isinstance(encoder, HttpEncoder) and sorted(list(r.v) for r in df.select(encoder.encode(F.col("t")).alias("v")).collect()) == [[2.0, 7.0], [3.0, 7.0]]
    finally:
        server.shutdown()
    lost = encoder_for("http", url="http://127.0.0.1:9", model="m", timeout=1.0)
    assert [r.v for r in df.select(lost.encode(F.col("t")).alias("v")).collect()] == [None, None]


def test_watcher_pauses_and_corrects(tmp_path):
    from quern.sources.watcher import FolderWatcher

    root, out = tmp_path / "r", tmp_path / "o"
    root.mkdir()
    out.mkdir()
    (root / "a.py").write_text("1")
    w = FolderWatcher(str(root), str(out), pause=5)
    w.known = w._listing()
    (root / "b.py").write_text("2")
    (root / "c.txt").write_text("2")
    w.poll(0)
    (root / "a.py").unlink()
    w.poll(3)
    w.poll(7)
    assert not list(out.glob("*.json"))  # the second change started the pause anew
    w.poll(8.5)
    rows = [json.loads(x) for f in out.glob("*.json") for x in f.read_text().splitlines()]
    assert [(r["path"], r["change_type"]) for r in rows] == [("a.py", "delete"), ("b.py", "upsert")] and not w.pending
    with FolderWatcher(str(root), str(out), pause=60, interval=0.05) as live:
        assert live.is_running() and live.start() is live
    assert not live.is_running()


def test_stream_goes_out_after_a_pause(spark, tmp_path):
    import time

    inbox, got = tmp_path / "in", []
    inbox.mkdir()
    put = lambda n, rows: (inbox / f"{n}.json").write_text("\n".join(json.dumps({"path": p, "change_type": c, "event_time": t}) for p, c, t in rows))
    put(1, [("a.py", "upsert", "2024-01-01T00:00:01"), ("b.py", "delete", "2024-01-01T00:00:01"), ("n.txt", "upsert", "2024-01-01T00:00:01")])
    query = C.start(C.change_stream(spark, str(inbox)), lambda batch, n: got.append({(r.path, r.change_type) for r in batch.collect()}), str(tmp_path / "c"), "3 seconds", True).trigger(processingTime="1 second").start()
    try:
        time.sleep(1)
        put(2, [("a.py", "delete", "2024-01-01T00:00:02")])
        end = time.time() + 90
        while not got and time.time() < end:
            time.sleep(0.3)
    finally:
        query.stop()
    assert set().union(*got) >= {("b.py", "delete"), ("a.py", "delete")} and all("n.txt" != p for part in got for p, _ in part)


def test_vector_index_is_exact_and_reads_few_cells(spark, tmp_path):
    import numpy as np

    from quern.operators.vector_index import VectorIndex

    r = np.random.default_rng(4)
    x = r.normal(size=(30, 16))[r.integers(0, 30, 1500)] + r.normal(size=(1500, 16)) * 0.25
    rows = [(i, [float(v) for v in row], i % 3) for i, row in enumerate(x)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [1.0] * 3, 0), (9004, [float("nan")] * 16, 0)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    index = VectorIndex.build(df, f"file://{tmp_path}/index", 16)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in (0, 7, 500):
        want = [int(i) for i in np.argsort(-(u @ u[q]), kind="stable")[:10]]
        assert [r_.id for r_ in index.search(list(x[q]), 10).collect()] == want
        hits += len(set(want) & {r_.id for r_ in index.search(list(x[q]), 10, probes=3, exact=False).collect()})
        assert {r_.label for r_ in index.search(list(x[q]), 5, equal={"label": 1}).collect()} == {1}
    assert hits >= 27 and len(index.centres) == 38
    order, bound = index.order(u[0])
    assert (bound[order] >= 0.8).mean() < 0.5
    assert VectorIndex.build(df.limit(0), f"file://{tmp_path}/none", 16).search([1.0] * 16).collect() == []


def test_command_line_and_watching_a_folder(spark, tmp_path, capsys):
    import time

    from quern.__main__ import main

    repo = tmp_path / "repo"
    repo.mkdir()
    (repo / "a.py").write_text("def f():\n    g()\ndef g(): pass\n")
    common = ["--repo", str(repo), "--state", str(tmp_path / "s")]
    said = []
    for command in (["index"], ["callers", "repo:a.py:g"], ["chain", "repo:a.py:f", "--depth", "1"], ["search", "g", "--limit", "2"], ["status"]):
        assert main([*common, *command], spark) == 0
        said.append(json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert said[0]["added"] == 2 and said[1]["count"] == 1 and said[2]["calls"][0]["name"] == "g" and said[3]["count"] == 2 and said[4]["status"] == "ready"
    with Engine(spark, Settings(str(repo), storage_path=str(tmp_path / "s"), dimensions=768, debounce_seconds=0.5)) as e:
        e.watch_repository()
        assert e.get_index_status()["watcher_active"] and e.watch_repository() is e.query
        (repo / "b.py").write_text("def h():\n    f()\n")
        end = time.time() + 120
        while time.time() < end and not e.get_callers("repo:a.py:f")["count"]:
            time.sleep(1)
        assert [r["id"] for r in e.get_callers("repo:a.py:f")["callers"]] == ["repo:b.py:h"]
    assert e.query is None and e.watcher is None
