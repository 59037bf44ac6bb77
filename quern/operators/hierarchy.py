"""Problem 6: parent-child rows to full hierarchies.

Every round contracts the parent chains inside a partition to fragment exits: the first
ancestor that another partition holds. The nodes that are such exits form the smaller
quotient forest, which is solved the same way over coarser partitions until one bounded
task holds it; then every fragment is joined with its exit's answer. Cycles inside a fragment show
in its own chain, longer ones in the quotient forest.

Defined cases: a null parent or one that is no node makes a root; a node given twice keeps
its smallest parent; a self-loop is a cycle of length one; empty input gives empty output.
For nodes on or below a cycle, ``root`` is the smallest node on it; ``path`` then leads to the first
node that is on the cycle, and ``depth`` counts the steps to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import current_classes
from ..session import materialize

#: Nodes that one task solves at most, at some 100 bytes each.
TASK_NODES = 1_000_000
#: Ids of ways that a task holds at once before it hands them on.
_BATCH = 500_000
#: Partitions that a forest of any size is contracted in at least.
PARTS = 8

_FRAGMENT = "node long, parent long, exit long, root long, kind string, up array<long>"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's chains: for each node the exit (null if the chain ends here), the root and kind if known, and ``up``, its ancestors up to but without the exit."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    node = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in table]).astype(np.int64)
    has = np.concatenate([b.column(1).is_valid().to_numpy(zero_copy_only=False) for b in table])
    parent = np.concatenate([b.column(1).fill_null(0).to_numpy(zero_copy_only=False) for b in table]).astype(np.int64)
    where = {int(n): i for i, n in enumerate(node)}
    n = len(node)
    local = [where.get(int(p), -1) if h else -1 for p, h in zip(parent, has)]
    # state: 0 unseen, 1 on the present walk, 2 done
    state = bytearray(n)
    least: dict[int, int] = {}  # members of cycles: the smallest node
    for start in range(n):
        walk, i = [], start
        while i >= 0 and not state[i]:
            state[i] = 1
            walk.append(i)
            i = local[i]
        if i >= 0 and state[i] == 1:  # a new cycle
            ring = walk[walk.index(i):]
            smallest = int(min(node[j] for j in ring))
            least |= dict.fromkeys(ring, smallest)
        for j in walk:
            state[j] = 2
    below: dict[int, list[int]] = {}
    for j, p in enumerate(local):
        if p >= 0 and j not in least:
            below.setdefault(p, []).append(j)
    # Each tree from its top down: the way up is the stack, so no more than one way and one batch are held.
    rows: list[tuple] = []
    volume = 0
    for top in range(n):
        if local[top] >= 0 and top not in least:
            continue
        if top in least:
            ends = (None, least[top], "cycle", "below")
        elif has[top]:
            ends = (int(parent[top]), None, None, None)
        else:
            ends = (None, int(node[top]), "root", "tree")
        stack: list[int] = []
        open_ = [(top, 0)]
        while open_:
            j, depth = open_.pop()
            del stack[depth:]
            rows.append((int(node[j]), int(parent[j]) if has[j] else None, ends[0], ends[1], ends[2] if j == top else ends[3], stack[::-1]))
            volume += depth + 1
            stack.append(int(node[j]))
            open_ += [(c, depth + 1) for c in below.get(j, ())]
            if volume >= _BATCH:
                yield _fragments(rows)
                rows, volume = [], 0
    if rows:
        yield _fragments(rows)


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names=["node", "parent", "exit", "root", "kind", "up"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last quotient forest (node, exit, root, kind, up) in one task: the ways between the exits put together from the top down."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    node, exit_, root, kind = (table.column(c).to_pylist() for c in ("node", "exit", "root", "kind"))
    up = table.column("up").combine_chunks()
    where = {x: i for i, x in enumerate(node)}
    local = [where[e] if e is not None else -1 for e in exit_]
    n, state, least = len(node), bytearray(len(node)), {}
    for start in range(n):
        walk, i = [], start
        while i >= 0 and not state[i]:
            state[i] = 1
            walk.append(i)
            i = local[i]
        if i >= 0 and state[i] == 1:
            ring = walk[walk.index(i):]
            least |= dict.fromkeys(ring, min(node[j] for j in ring))
        for j in walk:
            state[j] = 2
    below: dict[int, list[int]] = {}
    for j, p in enumerate(local):
        if p >= 0 and j not in least:
            below.setdefault(p, []).append(j)
    rows, volume = [], 0
    for top in range(n):
        if local[top] >= 0 and top not in least:
            continue
        top_root, top_kind = (least[top], "cycle") if top in least else (root[top], kind[top])
        under = "below" if top_kind in ("cycle", "below") else "tree"
        stack: list[int] = [exit_[top]] if top in least else []
        open_ = [(top, len(stack))]
        while open_:
            j, depth = open_.pop()
            del stack[depth:]
            stack += up[j].as_py()[::-1]
            rows.append((node[j], top_root, top_kind if j == top else under, stack[::-1]))
            volume += len(stack) + 1
            stack.append(node[j])
            open_ += [(c, len(stack)) for c in below.get(j, ())]
            if volume >= _BATCH:
                yield _answers(rows)
                rows, volume = [], 0
    if rows:
        yield _answers(rows)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names=["node", "root", "kind", "up"])


_NONE = "cast(array() as array<long>)"


def _solve(edges: DataFrame, total: int, block: str | None, task_nodes: int, level: int) -> DataFrame:
    """``node, parent, root, kind, up`` for the forest ``edges`` (node, parent[, block]): ``up`` lists all ancestors, nearest first."""
    if level and total <= task_nodes:
        return edges.select("node", "parent").coalesce(1).mapInArrow(_contract, _FRAGMENT).select("node", "parent", "root", "kind", "up")
    parts = max(PARTS, -(-total // task_nodes) * 2)
    if block and total <= task_nodes / 2:
        keys = [F.col(block)]  # no block can be too large for a task
    elif block:
        # Blocks beyond half a task are salted by node; there are fewer of them than 2 * parts.
        large = edges.groupBy(block).count().where(F.col("count") > task_nodes / 2)
        edges = edges.join(large, block, "left").withColumn("_salt", F.when(F.col("count").isNotNull(), F.pmod(F.hash("node"), F.ceil(F.col("count") * 2 / task_nodes))).otherwise(0))
        keys = [F.col(block), F.col("_salt")]
    else:
        keys = [F.floor(F.col("node") / F.lit(4 ** level))]
    fragments = materialize(edges.repartition(parts, *keys).select("node", "parent").mapInArrow(_contract, _FRAGMENT), "fragments")
    exits = fragments.where("exit is not null").select(F.col("exit").alias("node")).distinct()
    quotient = materialize(fragments.drop("parent").join(exits, "node", "left_semi"), "quotient")
    count = quotient.count()
    if count <= task_nodes:
        solved = quotient.coalesce(1).mapInArrow(_finish, "node long, root long, kind string, up array<long>")
    elif count > 0.7 * total:
        solved = _by_doubling(quotient.withColumnRenamed("exit", "parent"))
    else:
        inner = _solve(quotient.select("node", F.col("exit").alias("parent")), count, None, task_nodes, level + 1)
        solved = _fill(inner, quotient)
    if count > task_nodes:  # what one task makes of a written quotient is made again rather than written
        solved = materialize(solved, "solved")
    at_exit = solved.select(F.col("node").alias("exit"), F.col("root").alias("_root"), F.col("kind").alias("_kind"), F.col("up").alias("_up"))
    out = fragments.join(at_exit, "exit", "left").select(
        "node", "parent", F.coalesce("root", "_root").alias("root"),
        F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("_kind").isin("cycle", "below"), F.lit("below")).otherwise(F.lit("tree")).alias("kind"),
        F.when(F.col("exit").isNull(), F.col("up")).otherwise(F.concat("up", F.array("exit"), F.coalesce("_up", F.expr(_NONE)))).alias("up"))
    ring = solved.where("kind = 'cycle'").select("node", F.col("root").alias("label")).join(
        quotient.where("root is null").select("node", "up"), "node").select("label", F.explode(F.concat(F.array("node"), "up")).alias("member"))
    return out if ring.isEmpty() else _rings(out, materialize(ring, "rings"))


def _fill(inner: DataFrame, quotient: DataFrame) -> DataFrame:
    """The quotient's answers with the nodes inside each fragment put between the exits."""
    ends = quotient.select(F.col("node").alias("_at"), F.col("exit").alias("_exit"), F.col("root").alias("_root"), F.col("kind").alias("_kind"), F.col("up").alias("_between"))
    steps = inner.select("node", "root", "kind", F.posexplode(F.concat(F.array("node"), "up")).alias("_i", "_at")).join(ends, "_at", "left")
    piece = F.concat(F.coalesce("_between", F.expr(_NONE)), F.when(F.col("_exit").isNotNull(), F.array("_exit")).otherwise(F.expr(_NONE)))
    merged = steps.groupBy("node").agg(
        F.first("root").alias("root"), F.first("kind").alias("kind"), F.max("_i").alias("_n"),
        F.max_by("_root", "_i").alias("_root"), F.max_by("_kind", "_i").alias("_kind"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", piece.alias("p")))), lambda x: x["p"])).alias("up"))
    looped = F.col("kind").isin("cycle", "below")
    return merged.select(
        "node", F.when(looped, F.col("root")).otherwise(F.col("_root")).alias("root"),
        F.when(looped, F.col("kind")).when(F.col("_n") == 0, F.col("_kind")).when(F.col("_kind").isin("cycle", "below"), F.lit("below")).otherwise(F.lit("tree")).alias("kind"),
        "up")


def _rings(out: DataFrame, ring: DataFrame) -> DataFrame:
    """Cycles across fragments: their members' kind and least node, and ways up that end at the first member."""
    least = ring.groupBy("label").agg(F.min("member").alias("least"))
    members = ring.join(least, "label").select("member", "least").distinct()
    hits = out.where("kind in ('cycle', 'below')").select("node", F.posexplode("up").alias("_i", "member")).join(members, "member")
    hits = hits.groupBy("node").agg(F.min("_i").alias("_cut"), F.min_by("least", "_i").alias("_least"))
    on = members.select(F.col("member").alias("node"), F.col("least").alias("_own"))
    return out.join(hits, "node", "left").join(on, "node", "left").select(
        "node", "parent", F.coalesce("_own", "_least", "root").alias("root"),
        F.when(F.col("_own").isNotNull(), F.lit("cycle")).when(F.col("_least").isNotNull(), F.lit("below")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("_own").isNotNull(), F.expr(_NONE)).when(F.col("_least").isNotNull(), F.slice("up", F.lit(1), F.coalesce("_cut", F.lit(0)) + 1)).otherwise(F.col("up")).alias("up"))


def _by_doubling(quotient: DataFrame) -> DataFrame:
    """Pointer doubling, for forests whose chains no partitioning keeps together: as many rounds as the logarithm of the longest chain."""
    state = quotient.select("node", "parent", "root", "kind", "up")
    while True:
        nxt = state.select(F.col("node").alias("parent"), F.col("parent").alias("_p"), F.col("root").alias("_r"), F.col("kind").alias("_k"), F.col("up").alias("_u"))
        open_ = F.col("root").isNull()
        moved = state.join(nxt, "parent", "left").select(
            "node", F.when(open_, F.col("_p")).alias("parent"), F.coalesce("root", "_r").alias("root"),
            F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("_k").isin("cycle", "below"), F.lit("below")).when(F.col("_r").isNotNull(), F.lit("tree")).alias("kind"),
            F.when(open_, F.concat("up", F.array("parent"), F.coalesce("_u", F.expr(_NONE)))).otherwise(F.col("up")).alias("up"))
        # A node that meets itself on the way up is on a cycle.
        at = F.when(F.col("root").isNull(), F.array_position("up", F.col("node")).cast("int"))
        found = moved.withColumn("_at", at).select(
            "node", "parent", F.when(F.col("_at") > 0, F.array_min(F.slice("up", F.lit(1), F.greatest("_at", F.lit(1))))).otherwise(F.col("root")).alias("root"),
            F.when(F.col("_at") > 0, F.lit("cycle")).otherwise(F.col("kind")).alias("kind"),
            F.when(F.col("_at") > 0, F.expr(_NONE)).otherwise(F.col("up")).alias("up"))
        state = materialize(found.withColumn("parent", F.when(F.col("root").isNull(), F.col("parent"))), "doubling")
        if state.where("root is null").isEmpty():
            return state.select("node", "root", "kind", "up")


def hierarchy(edges: DataFrame, block: str | None = None, task_nodes: int = TASK_NODES, known: bool = False) -> DataFrame:
    """``node, parent, root, kind, depth, path`` of every node of ``edges`` (node, parent).

    ``kind`` is ``root``, ``tree``, ``cycle`` or ``below`` (a cycle); ``path`` runs from the top
    down to the node. ``block`` names a column whose values keep chains together (a file, a repository). ``known`` promises
    that every parent is a node.
    """
    cols = ["node", "parent"] + ([block] if block else [])
    rows = edges.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"), *([F.min(block).alias(block)] if block else []))
    if not known:
        nodes = rows.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
        rows = rows.join(nodes, "parent", "left").withColumn("parent", F.when(F.col("_known"), F.col("parent"))).select(*cols)
    rows = materialize(rows, "forest")
    solved = _solve(rows, rows.count(), block, task_nodes, 0)
    # ``up`` of a node below a cycle ends where the cycle begins; one on a cycle has no way up.
    return solved.select("node", "parent", "root", "kind", F.size("up").alias("depth"), F.reverse(F.concat(F.array("node"), "up")).alias("path"))


def descendants(solved: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for all pairs; the members of one cycle are not each other's descendants here, see ``kind``."""
    up = F.posexplode(F.reverse(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))
    return solved.where("depth > 0").select(F.col("node").alias("descendant"), up.alias("_i", "ancestor")).select("ancestor", "descendant", (F.col("_i") + 1).alias("distance"))


def class_parents(classes: DataFrame) -> DataFrame:
    """``seq, parent_seq, repo, clean_path`` of the current classes.

    A base's name is what stands before any ``[`` or ``<``, trimmed, after the last dot; bases with
    ``=`` don't count. It means the current class of that name in the same file, otherwise the one
    in the same repo if there is exactly one. The parent is the first base that means a class.
    """
    rows = materialize(current_classes(classes, bases=F.col("bases")), "classes")
    base = F.element_at(F.split(F.trim(F.regexp_replace(F.regexp_extract("base", r"(?s)^([^\[<]*)", 1), r"^\s+|\s+$", "")), r"\.", -1), -1)
    wanted = rows.select("seq", "repo", "clean_path", F.posexplode("bases").alias("at", "base")).where("base is not null and not contains(base, '=')")
    wanted = wanted.select("seq", "repo", "clean_path", "at", F.trim(base).alias("name"))
    here = rows.select("repo", "clean_path", "name", F.col("seq").alias("here"))
    only = rows.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("only")).where("_n = 1").drop("_n")
    same = wanted.alias("w").join(here.alias("h"), F.col("w.repo").eqNullSafe(F.col("h.repo")) & F.col("w.clean_path").eqNullSafe(F.col("h.clean_path")) & (F.col("w.name") == F.col("h.name")), "left")
    same = same.select("w.*", "here").alias("s").join(only.alias("o"), F.col("s.repo").eqNullSafe(F.col("o.repo")) & (F.col("s.name") == F.col("o.name")), "left")
    found = same.select("seq", "at", F.coalesce("here", "only").alias("parent_seq")).where("parent_seq is not null")
    first = found.groupBy("seq").agg(F.min_by("parent_seq", "at").alias("parent_seq"))
    return rows.join(first, "seq", "left").select("seq", "parent_seq", "repo", "clean_path", "name")


def class_hierarchy(classes: DataFrame, task_nodes: int = TASK_NODES) -> DataFrame:
    """The hierarchy of the current classes, in fragments of files."""
    edges = class_parents(classes).select(F.col("seq").alias("node"), F.col("parent_seq").alias("parent"), F.xxhash64("repo", "clean_path").alias("file"))
    return hierarchy(edges, "file", task_nodes, known=True)
