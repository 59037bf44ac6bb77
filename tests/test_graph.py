import random

import pytest

from quern.operators import entities as E
from quern.operators import graph as G
from quern.operators import graph_queries as Q
from quern.operators.components import connected_components
from quern.plans import reference_queries as R

COLS = "entity_type string, repo string, file_path string, name string, seq long, start_line int, end_line int, class_name string, calls array<string>, bases array<string>, imports array<string>, defines array<string>, language string, extra string"


def fn(seq, path, name, calls=(), cls=None):
    return ("function", "r", path, name, seq, 1, 2, cls, list(calls), None, None, None, None, "x")


def cl(seq, path, name, bases=()):
    return ("class", "r", path, name, seq, 1, 2, None, None, list(bases), None, None, None, "x")


def file(seq, path, imports=(), defines=()):
    return ("file", "r", path, path.rsplit("/", 1)[-1], seq, 1, 9, None, None, None, list(imports), list(defines), "python", "x")


def entities(spark, rows):
    return E.identified(E.complete(spark.createDataFrame(rows, COLS)))


def edges(g):
    return {(r.src, r.dst, r.type) for r in g.edges.collect()}


def test_build_resolves_by_scope(spark):
    rows = [
        fn(1, "a.py", "process"), fn(2, "b.py", "process"), fn(3, "a.py", "other", ["process", "ext", "K.run", "", None]), fn(4, "a.py", "run", [], "K"), cl(5, "a.py", "K", ["Base", "abc.ABC"]),
        cl(6, "b.py", "Base"), fn(7, "c.py", "far", ["process", "process"]), file(8, "a.py", ["b", "nothing"], ["r:a.py:process", "r:a.py:gone"]), file(9, "b.py"), fn(10, "a.py", "process", ["late"])]
    g = G.Graph.build(entities(spark, rows))
    got = edges(g)
    assert {("r:a.py:other", "r:a.py:process", "calls"), ("r:a.py:other", "external:ext", "calls"), ("r:a.py:other", "r:a.py:K.run", "calls"), ("r:a.py:K", "r:a.py:K.run", "contains"),
            ("r:a.py:K", "r:b.py:Base", "inherits"), ("r:a.py:K", "external:abc.ABC", "inherits"), ("r:a.py", "r:b.py", "imports"), ("r:a.py", "external:nothing", "imports"),
            ("r:a.py", "r:a.py:process", "defines"), ("r:a.py:process", "external:late", "calls")} <= got
    assert ("r:c.py:far", "r:a.py:process", "calls") in got  # registered last
    assert not any(d == "r:a.py:gone" for _, d, _ in got)
    s = g.statistics().first()
    assert (s.functions, s.classes, s.files, s.external, s.edges) == (5, 2, 2, 4, len(got)) and s.nodes == 13
    assert [r.score for r in Q.find_symbol(g, "process", "b.py").collect()] == [150, 100]
    assert [r.id for r in Q.find_symbol(g, "K.run").collect()] == ["r:a.py:K.run"]
    h = {(r.relation, r.id, r.is_external) for r in Q.class_hierarchy(g).where("of = 'r:a.py:K'").collect()}
    assert h == {("parent", "r:b.py:Base", False), ("parent", "external:abc.ABC", True)}
    shape = Q.file_structure(g, "a.py")
    assert [c["name"] for c in shape["classes"]] == ["K"] and shape["classes"][0]["methods"][0]["name"] == "run" and {f["name"] for f in shape["functions"]} == {"process", "other"} and len(shape["imports"]) == 2
    assert "error" in Q.file_structure(g, "none.py")
    less, gone = g.remove_file("a.py")
    assert gone.count() == 5 and not any("a.py" in a or "a.py:" in b for a, b, _ in edges(less))
    assert [r.id for r in Q.function_calls(g, "r:a.py:other").collect()] == ["r:a.py:process", "external:ext", "r:a.py:K.run"] and {r.id for r in Q.callers(g, "r:a.py:process").collect()} == {"r:a.py:other", "r:c.py:far"}


def test_empty_and_updates(spark):
    g = G.Graph.build(entities(spark, [file(1, "a.py")]).limit(0))
    assert g.nodes.collect() == [] and g.edges.collect() == [] and g.statistics().first().nodes == 0 and Q.components(g).collect() == []
    g = G.Graph.build(entities(spark, [fn(1, "a.py", "f", ["g"]), fn(2, "b.py", "g")]))
    one = spark.createDataFrame([("r:a.py:f", "r:b.py:g", "uses", 9), ("r:a.py:f", "nowhere", "calls", 9)], "src string, dst string, type string, seq long")
    assert edges(g.add_edges(one)) == {("r:a.py:f", "r:b.py:g", "uses")}
    assert g.has_entity("r:b.py:g") and not g.has_entity("x") and g.by_file("b.py").count() == 1 and g.by_type("function").count() == 2
    renamed = g.nodes.where("id = 'r:b.py:g'").replace("g", "h", "name").selectExpr("id", "repo", "type", "'h' as name", "file_path", "start_line", "end_line", "99L as seq")
    assert {r.id: (r.name, r.seq) for r in g.add_entities(renamed).nodes.collect()}["r:b.py:g"] == ("h", 2)
    assert [r.id for r in g.successors("r:a.py:f", "calls").collect()] == ["r:b.py:g"] and [r.id for r in g.predecessors("r:b.py:g").collect()] == ["r:a.py:f"]


def model_chain(calls, node, depth, limit, seen):
    if depth > limit or node in seen:
        return (node, depth > limit, node in seen, ())
    seen.add(node)
    return (node, False, False, tuple(model_chain(calls, x, depth + 1, limit, seen) for x in calls.get(node, [])))


def flat(tree, key):
    return (tree["id"].rsplit(":", 1)[-1], tree["truncated"], tree["cycle"], tuple(flat(x, key) for x in tree[key]))


@pytest.mark.parametrize("seed", [1, 2])
def test_walks_equal_a_model(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    calls = {a: r.sample(names, r.randrange(0, 3)) for a in names}
    g = G.Graph.build(entities(spark, [fn(i, "m.py", a, calls[a]) for i, a in enumerate(names)]))
    for limit in (2,):
        assert flat(Q.call_chain(g, "r:m.py:n0", limit), "calls") == model_chain(calls, "n0", 0, limit, set())
    few = {row.id: row.depth for row in Q.call_chain_levels(g, "r:m.py:n0", 4).collect()}
    Q.SMALL, small = 1, Q.SMALL
    try:
        assert {row.id: row.depth for row in Q.call_chain_levels(g, "r:m.py:n0", 4).collect()} == few
    finally:
        Q.SMALL = small
    back = {}
    for a in names:
        for b in calls[a]:
            back.setdefault(b, []).append(a)
    assert flat(Q.call_chain(g, "r:m.py:n1", 3, "incoming"), "callers") == model_chain(back, "n1", 0, 3, set())
    assert Q.call_chain(g, "r:m.py:none")["name"] == "unknown"

    def paths(at, goal, path):
        if at == goal:
            yield tuple(path)
        elif len(path) <= 4:
            for b in calls[at]:
                if b not in path:
                    yield from paths(b, goal, [*path, b])

    want = {p for p in paths("n0", "n5", ["n0"])}
    got = [tuple(x.rsplit(":", 1)[-1] for x in row.path) for row in Q.find_paths(g, "r:m.py:n0", "r:m.py:n5", 4).collect()]
    assert set(got) == want and len(got) == len(want) and Q.find_paths(g, "r:m.py:n0", "none").collect() == []
    label = {row.id: row.component for row in Q.components(g).collect()}
    for a in names:
        for b in calls[a]:
            assert label[f"r:m.py:{a}"] == label[f"r:m.py:{b}"]


def test_components_of_a_long_path_a_hub_and_nulls(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, 1000 + i) for i in range(50)] + [(7000, 7000), (None, 8000), (100, 99)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[1000 + i] == 500 for i in range(50)) and got[7000] == 7000 and got[8000] == 8000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_registered_chains_and_paths_go_to_the_operators_depth(spark, monkeypatch):
    # The chain a0 ... a11 hangs on the root; a short cut from a1 to a3 gives two ways to all that follows.
    rows = [fn(0, "m.py", "root", ["a0", "x", "y", "z"]), fn(1, "m.py", "a1", ["a2", "a3"])]
    rows += [fn(2 + i, "m.py", f"a{i}", [f"a{i + 1}"]) for i in range(11) if i != 1]
    g = G.Graph.build(entities(spark, rows))
    monkeypatch.setattr(R, "graph", lambda spark, d: g)
    short = lambda x: x.rsplit(":", 1)[-1]
    out = {"root": 0, "a0": 1, "a1": 2, "a2": 3, "a3": 3, "a4": 4, "a5": 5, "x": 1, "y": 1, "z": 1}
    assert {short(r.id): r.depth for r in R.QUERIES["call_chain_levels"](spark, "").collect()} == out
    tree = [(short(r.id), r.depth, r.truncated, r.cycle) for r in R.QUERIES["call_chain_tree"](spark, "").collect()]
    assert [x for x in tree if x[0] in ("a4", "a5", "a3")] == [("a3", 4, False, False), ("a4", 5, False, False), ("a5", 6, True, False), ("a3", 3, False, True)]
    # a10 is 10 calls away, the farthest within PATH_LENGTH; the way that does without the short cut has 11.
    paths = [[short(x) for x in r.path.split(" > ")] for r in R.QUERIES["find_paths"](spark, "").collect()]
    assert paths == [["root", "a0", "a1", *[f"a{i}" for i in range(3, 11)]]]
