import pytest
from pyspark.sql import functions as F

from quern.operators import incremental
from quern.operators.versions import VersionConflict, VersionedTable, process_changes
from quern.session import fresh_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same(a, b):
    return F.col(f"{a}.v") == F.col(f"{b}.v")


def test_changes_between_versions(spark):
    t = VersionedTable(spark, fresh_path(spark, "t"))
    assert t.version() == -1
    make = lambda x: spark.createDataFrame(x, "k string, v string")
    t.append(make([("a", "1"), ("b", "1"), ("b2", None), ("c", "1")]))
    t.upsert(make([("a", "1"), ("b", "2"), ("b2", None), ("d", "1"), (None, "9")]), ["k"], same)
    assert sorted(map(str, rows(t.snapshot()))) == sorted(map(str, [("a", "1"), ("b", "2"), ("b2", None), ("c", "1"), ("d", "1"), (None, "9")]))
    got = sorted(map(str, rows(t.changes(0))))
    assert got == sorted(map(str, [("b", "1", "delete"), ("b", "2", "insert"), ("b2", None, "delete"), ("b2", None, "insert"), ("d", "1", "insert"), (None, "9", "insert")]))
    t.upsert(make([("a", "5"), ("b", "2")]), ["k"], same, remove_missing=True)
    assert rows(t.snapshot()) == [("a", "5"), ("b", "2")]
    assert ("c", "1", "delete") in rows(t.changes(1)) and t.changes(2, 2).collect() == []
    t.overwrite(make([("z", "1"), ("z", "1")]))
    assert rows(t.snapshot()) == [("z", "1"), ("z", "1")] and len(rows(t.changes(2))) == 4
    assert t.snapshot(0).count() == 4


def test_a_failed_run_skips_and_repeats_nothing(spark):
    source, out = VersionedTable(spark, fresh_path(spark, "s")), VersionedTable(spark, fresh_path(spark, "o"))
    source.append(spark.createDataFrame([("a", "1")], "k string, v string"))
    keep = lambda ch: ch.where("_q_change = 'insert'").select("k")
    process_changes(source, out, keep)
    source.append(spark.createDataFrame([("b", "1")], "k string, v string"))

    def breaks(ch):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_changes(source, out, breaks)
    out._write(spark.createDataFrame([("junk",)], "k string"), "data")  # files of a run that broke off
    process_changes(source, out, keep)
    process_changes(source, out, keep)
    assert rows(out.snapshot()) == [("a",), ("b",)]
    with pytest.raises(VersionConflict):
        out._commit(0, {}, out.manifest(0)["schema"], {})


def test_a_run_that_another_one_overtakes_repeats_nothing(spark):
    source, out = VersionedTable(spark, fresh_path(spark, "s")), VersionedTable(spark, fresh_path(spark, "o"))
    source.append(spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string"))
    keep = lambda ch: ch.where("_q_change = 'insert'").select("k")
    calls = []

    def overtaken(ch):
        calls.append(1)
        if len(calls) == 1:  # another runner commits while this one works
            process_changes(source, out, keep)
            source.append(spark.createDataFrame([("c", "1")], "k string, v string"))
        return keep(ch)

    assert process_changes(source, out, overtaken) == 1
    assert rows(out.snapshot()) == [("a",), ("b",), ("c",)] and len(calls) == 2


FN = "seq long, repo string, file_path string, class_name string, name string, code string, modified_at timestamp, hash string"
VEC = "vec_id long, id string, content_hash string, run_id long, updated_at timestamp"
RUN = "run_id long, attempt int, finished_at timestamp, status string"


def test_function_changes(spark):
    import datetime as dt
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    fns = [(1, "r", "a/./x.py", None, "f", "old", None, "q"), (2, "r", "a\\x.py", None, "f", "new", t1, "q"), (3, "r", "b.py", "C", "m", "m", t1, "q"),
           (4, "r", "b.py", None, "g", None, t1, None), (5, "r", "c.py", None, "never", "n", t1, None), (6, "r", "c.py", None, "bad", "n", t1, None), (7, "r", "c.py", None, "late", "n", t1, None)]
    vecs = [(1, "r:a/x.py:f", f"  {h('new').upper()}\t", 1, t1), (2, "r:b.py:C.m", "stale", 1, t1), (3, "r:b.py:C.m", h("m"), 1, t2), (4, "r:b.py:g", None, 1, t1),
            (5, "r:c.py:bad", h("n"), 2, t1), (6, "r:c.py:late", h("n"), 9, t1)]
    runs = [(1, 1, t1, "failed"), (1, 2, t2, " OK "), (1, 2, t2, " OK "), (2, 1, t1, "ok"), (2, 2, None, None)]
    df = lambda x, s: spark.createDataFrame(x, s)
    got = incremental.function_changes(spark, df(fns, FN), df(vecs, VEC), df(runs, RUN)).where("change = 'insert'").collect()
    assert sorted(r.id for r in got) == ["r:b.py:g", "r:c.py:bad", "r:c.py:late", "r:c.py:never"]
    assert incremental.function_changes(spark, df([], FN), df(vecs, VEC), df(runs, RUN)).collect() == []
    assert incremental.function_changes(spark, df(fns, FN), df([], VEC), df([], RUN)).count() == 6


def test_an_interrupted_run_over_versions_loses_and_repeats_nothing(spark):
    import datetime as dt
    import hashlib

    from quern.plans import data_queries as D

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    t1, t2, t3 = (dt.datetime(2024, 1, i) for i in (1, 5, 7))  # versions 1, 2 and 3
    # early: changed in version 1 only; back: changed in 2 and as stored again in 3; twice: changed in 1 and 3; late: new in 2.
    fns = [(1, "r", "a.py", None, "early", "e2", t1, None), (2, "r", "a.py", None, "back", "x", t2, None), (3, "r", "a.py", None, "back", "b1", t3, None), (4, "r", "a.py", None, "twice", "w2", t1, None),
           (5, "r", "a.py", None, "twice", "w3", t3, None), (6, "r", "a.py", None, "late", "l", t2, None), (7, "r", "a.py", None, "kept", "k", t3, None)]
    vecs = [(i, f"r:a.py:{n}", h(c), 1, t1) for i, (n, c) in enumerate([("early", "e1"), ("back", "b1"), ("twice", "w1"), ("kept", "k"), ("gone", "g")])]
    df = lambda x, s: spark.createDataFrame(x, s)
    given = df(fns, FN), df(vecs, VEC), df([(1, 1, t1, "ok")], RUN)
    got = sorted(((r.id, r.hash) for r in incremental.processed_functions(spark, *given).collect()), key=str)
    assert got == sorted([("r:a.py:early", h("e2")), ("r:a.py:twice", h("w2")), ("r:a.py:twice", h("w3")), ("r:a.py:late", h("l"))], key=str)
    assert "p3_processed" in D.QUERIES
    assert incremental.processed_functions(spark, df([], FN), *given[1:]).collect() == []
    # Without a stored state all functions are new once, and ``twice`` changed after it was processed.
    alone = given[0], df([], VEC), df([], RUN)
    want = incremental.function_changes(spark, *alone).where("change = 'insert'").select("id", "hash")
    assert rows(incremental.processed_functions(spark, *alone)) == sorted([*rows(want), ("r:a.py:twice", h("w2"))], key=str)
