import random

import pytest

from quern.operators import hierarchy as H


def brute(edges):
    parent = dict(edges)
    parent = {n: (p if p in parent else None) for n, p in parent.items()}
    out = {}
    for n in parent:
        seen, x = [n], n
        while parent[x] is not None and parent[x] not in seen:
            x = parent[x]
            seen.append(x)
        if parent[x] is None:
            out[n] = (seen[-1], "root" if len(seen) == 1 else "tree", tuple(reversed(seen)))
        else:
            ring = seen[seen.index(parent[x]):]
            way = seen[: seen.index(ring[0]) + 1]
            out[n] = (min(ring), "cycle" if n in ring else "below", tuple(reversed(way)))
    return out


def run(spark, edges, **kw):
    df = spark.createDataFrame(edges, "node long, parent long, block long" if edges and len(edges[0]) == 3 else "node long, parent long")
    return {r.node: (r.root, r.kind, tuple(r.path)) for r in H.hierarchy(df, **kw).collect()}


@pytest.mark.parametrize("seed,size,task,block", [(1, 120, 1000, False), (2, 150, 40, False), (3, 150, 30, True)])
def test_random_forests_with_cycles(spark, seed, size, task, block):
    r = random.Random(seed)
    edges = []
    for n in range(size):
        p = r.choice([None, r.randrange(size), max(0, n - 1), max(0, n - 1), n // 2])
        edges.append((n, p))
    given = [(n, p, n // 20) for n, p in edges] if block else edges
    assert run(spark, given, task_nodes=task, **({"block": "block"} if block else {})) == brute(edges)


def test_long_chain_and_wide_ring(spark):
    chain = [(i, i - 1 if i else None) for i in range(90)]
    ring = [(1000 + i, 1000 + (i + 1) % 30) for i in range(30)] + [(2000, 1005), (2001, 2000)]
    random.Random(5).shuffle(chain)
    assert run(spark, chain + ring, task_nodes=25) == brute(chain + ring)


def test_nulls_loops_repeats_and_empty(spark):
    assert run(spark, [(1, None), (2, 99), (3, 3), (None, 1), (4, 1), (4, 1)]) == {
        1: (1, "root", (1,)), 2: (2, "root", (2,)), 3: (3, "cycle", (3,)), 4: (1, "tree", (1, 4))}
    assert run(spark, []) == {}


def test_base_names(spark):
    rows = [
        (1, "r", "a.py", "Base", None), (2, "r", "./a.py", "Kid", ["meta=X", " m.Base [T] "]), (3, "r", "b.py", "Far", ["Base<int>"]),
        (4, "r", "c.py", "Twin", []), (5, "r", "d.py", "Twin", [None, "Outside"]), (6, "r", "e.py", "Two", ["Twin", "Kid"]), (7, "q", "a.py", "Else", ["Base"]),
    ]
    df = spark.createDataFrame([(s, r, p, n, b, None, "x") for s, r, p, n, b in rows], "seq long, repo string, file_path string, name string, bases array<string>, modified_at timestamp, node string")
    assert {r.seq: r.parent_seq for r in H.class_parents(df).collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: 2, 7: None}
    assert sorted((r.ancestor, r.descendant, r.distance) for r in H.descendants(H.class_hierarchy(df)).collect()) == [(1, 2, 1), (1, 3, 1), (1, 6, 2), (2, 6, 1)]
    assert H.class_hierarchy(df.limit(0)).collect() == []


def test_small_forests_are_contracted_too(spark, monkeypatch):
    # Chains of 12 through blocks of 4, a ring through all blocks and a way into it.
    edges = [(100 * c + i, 100 * c + i - 1 if i else None, i // 4) for c in range(6) for i in range(12)]
    edges += [(1000 + i, 1000 + (i + 1) % 12, i // 4) for i in range(12)] + [(2000, 1005, 0), (2001, 2000, 1)]
    quotients = []
    kept = H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, label: (lambda out: (label == "quotient" and quotients.append(out.count())) or out)(kept(df, label)))
    assert run(spark, edges, block="block") == brute([e[:2] for e in edges])
    assert len(quotients) == 1 and 0 < quotients[0] < len(edges)


def test_a_long_chain_is_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    n = 3000
    monkeypatch.setattr(H, "_BATCH", 20_000)
    given = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None, *range(n - 1)], pa.int64())], names=["node", "parent"])
    seen = 0
    for b in H._contract(iter([given])):
        ups = b.column(5)
        assert len(ups.values) <= 20_000 + n
        for node, root, kind, up in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), ups):
            assert root == 0 and kind == ("tree" if node else "root") and len(up) == node and (not node or up[0].as_py() == node - 1)
            seen += 1
    assert seen == n
