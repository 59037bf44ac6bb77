"""Questions to a graph: calls, callers, chains, hierarchies, dependencies, symbols, structure, components and paths.

Every function takes a ``Graph``. Those that start at one node filter the edges first, so Parquet prunes by ``src`` or ``dst``;
``all_*`` variants answer for every node at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components
from .graph import Graph

DEPTH, PATH_LENGTH = 5, 10
#: Nodes of a search step that may travel with the driver's plan.
SMALL = 10_000


def _joined(g: Graph, type_: str, key: str, other: str) -> DataFrame:
    nodes = g.nodes.select(F.col("id").alias("_id"), "name", "file_path", F.col("type").alias("node_type"))
    return g.edges.where(F.col("type") == type_).join(nodes, F.col(other) == F.col("_id")).select(
        F.col(key).alias("of"), F.col(other).alias("id"), "name", "file_path", F.col("node_type").alias("type"), "seq", "pos")


def all_function_calls(g: Graph) -> DataFrame:
    """``of, id, name, file_path, type`` for every function's calls."""
    return _joined(g, "calls", "src", "dst")


def all_callers(g: Graph) -> DataFrame:
    return _joined(g, "calls", "dst", "src")


def function_calls(g: Graph, id_: str) -> DataFrame:
    return all_function_calls(Graph(g.nodes, g.edges.where(F.col("src") == id_))).orderBy("seq", "pos").select("id", "name", "file_path", "type")


def callers(g: Graph, id_: str) -> DataFrame:
    return all_callers(Graph(g.nodes, g.edges.where(F.col("dst") == id_))).orderBy("seq", "pos").select("id", "name", "file_path", "type")


def file_dependencies(g: Graph) -> DataFrame:
    """``of, id, name, file_path, type, is_external`` for every file's imports."""
    return _joined(g, "imports", "src", "dst").withColumn("is_external", F.col("type") == "external").drop("seq", "pos")


def file_dependents(g: Graph) -> DataFrame:
    return _joined(g, "imports", "dst", "src").select("of", "id", "name", "file_path")


def class_hierarchy(g: Graph) -> DataFrame:
    """``of, relation, id, name, file_path, is_external``: the direct parents and children of every class."""
    up = _joined(g, "inherits", "src", "dst").withColumn("relation", F.lit("parent"))
    down = _joined(g, "inherits", "dst", "src").withColumn("relation", F.lit("child"))
    return up.unionByName(down).select("of", "relation", "id", "name", "file_path", (F.col("type") == "external").alias("is_external"))


def _reached(edges: DataFrame, start: str, most: int) -> DataFrame:
    """``id, depth``: what is reachable over ``edges`` (_from, _to) in at most ``most`` steps, with the least number of them.

    Breadth first with a frontier of distinct nodes; nodes met before are not expanded again. A step is one job: while its nodes are
    few (:data:`SMALL`, looked at before anything is kept) they go along as a local table; a larger frontier is written.
    """
    spark = edges.sparkSession
    known = {start: 0}
    frontier, found, depth = [start], [], 0
    for depth in range(1, most + 1):
        now = spark.createDataFrame([(x,) for x in frontier], "_from string")
        step = edges.join(F.broadcast(now), "_from").select("_to").distinct()  # SMALL rows at most
        found = step.limit(SMALL + 1).collect()
        if len(found) > SMALL:
            break
        frontier = [r[0] for r in found if r[0] not in known]
        known |= dict.fromkeys(frontier, depth)
        if not frontier:
            break
    seen = spark.createDataFrame(list(known.items()), "id string, depth int")
    if not frontier or depth >= most and len(found) <= SMALL:
        return seen
    wide = spark.createDataFrame([(x,) for x in frontier], "id string")
    for depth in range(depth, most + 1):
        step = edges.join(wide.select(F.col("id").alias("_from")), "_from").select(F.col("_to").alias("id")).distinct()
        wide = materialize(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if wide.isEmpty():
            break
        seen = seen.unionByName(wide)
    return seen


def call_chain_levels(g: Graph, id_: str, max_depth: int = DEPTH, direction: str = "outgoing") -> DataFrame:
    """``id, depth``: what is reachable in at most ``max_depth`` calls, with the least number of them."""
    a, b = ("src", "dst") if direction == "outgoing" else ("dst", "src")
    return _reached(g.edges.where("type = 'calls'").select(F.col(a).alias("_from"), F.col(b).alias("_to")), id_, max_depth)


def call_chain(g: Graph, id_: str, max_depth: int = DEPTH, direction: str = "outgoing") -> dict:
    """The nested tree of calls (or callers): a node met before, anywhere, or beyond the depth is a stub.

    The edges within reach are found by the distributed search above; the tree, which is the
    result, is put together from them on the driver.
    """
    a, b, child, other = ("src", "dst", "calls", "callers") if direction == "outgoing" else ("dst", "src", "callers", "calls")
    near = call_chain_levels(g, id_, max_depth + 1, direction)
    rows = g.edges.where("type = 'calls'").join(near.select(F.col("id").alias(a)), a, "left_semi").select(a, b, "seq", "pos").orderBy("seq", "pos").collect()
    nodes = {r.id: r for r in g.nodes.join(near.select("id"), "id", "left_semi").select("id", "name", "file_path").collect()}
    after: dict[str, list[str]] = {}
    for r in rows:
        after.setdefault(r[a], []).append(r[b])
    visited: set[str] = set()

    def visit(node: str, depth: int) -> dict:
        known = nodes.get(node)
        name = known.name if known else "unknown"
        if depth > max_depth or node in visited:
            return {"id": node, "name": name, "truncated": depth > max_depth, "cycle": node in visited, child: [], other: None}
        visited.add(node)
        return {"id": node, "name": name, "file_path": known.file_path if known else None, "truncated": False, "cycle": False,
                child: [visit(x, depth + 1) for x in after.get(node, [])]}

    return visit(id_, 0)


def find_symbol(g: Graph, name: str, file_context: str | None = None) -> DataFrame:
    """``id, name, file_path, type, start_line, end_line, score``: exact names 100 (and 50 in the file), suffixes 50 (and 25)."""
    here = F.coalesce(F.col("file_path") == F.lit(file_context), F.lit(False)) if file_context else F.lit(False)
    loose = F.col("name").endswith(f".{name}") | F.col("id").endswith(f":{name}")
    score = F.when(F.col("name") == name, F.when(here, 150).otherwise(100)).when(loose, F.when(here, 75).otherwise(50))
    return g.nodes.withColumn("score", score).where("score is not null").orderBy(F.col("score").desc(), "seq").select("id", "name", "file_path", "type", "start_line", "end_line", "score")


def file_structure(g: Graph, path: str) -> dict:
    """The classes with methods, top-level functions and imports of one file."""
    own = g.nodes.where(F.col("file_path") == path)
    file = own.where("type = 'file'").first()
    if file is None:
        return {"error": f"File not found: {path}"}
    rows = own.where("type in ('class', 'function')").orderBy("seq").collect()
    held = g.edges.where("type = 'contains'").join(own.select(F.col("id").alias("src")), "src", "left_semi")
    methods: dict[str, list[dict]] = {}
    for r in held.join(g.nodes.select(F.col("id").alias("dst"), "name", "start_line"), "dst").orderBy("seq").collect():
        methods.setdefault(r.src, []).append({"name": r.name, "start_line": r.start_line})
    inner = {r.id: ":" in r.id and "." in r.id.rsplit(":", 1)[1] for r in rows}
    span = lambda r: {"id": r.id, "name": r.name, "start_line": r.start_line, "end_line": r.end_line}
    imports = file_dependencies(Graph(g.nodes, g.edges.where(F.col("src") == file.id))).collect()
    return {
        "id": file.id, "name": file.name, "file_path": path,
        "classes": [{**span(r), "methods": methods.get(r.id, [])} for r in rows if r.type == "class"],
        "functions": [span(r) for r in rows if r.type == "function" and not inner[r.id]],
        "imports": [{"name": r.name, "is_external": r.is_external} for r in imports]}


def all_file_structures(g: Graph) -> DataFrame:
    """``of, classes, functions, imports`` of every file, each in the order of the text.

    ``classes`` have their ids, names, lines and methods (by containment), ``functions`` are those of no class, as in :func:`file_structure`.
    """
    methods = g.edges.where("type = 'contains'").join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("_m"), F.col("seq").alias("_s")), "dst")
    methods = methods.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_m"))), lambda x: x["_m"]).alias("_methods"))
    own = g.nodes.where("type in ('class', 'function') and file_path is not null").join(methods, F.col("id") == F.col("src"), "left")
    inner = F.contains(F.element_at(F.split("id", ":"), -1), F.lit("."))
    entry = F.struct("seq", "id", "name", "start_line", "end_line", F.coalesce("_methods", F.array().cast("array<string>")).alias("methods"))
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, entry)))
    inside = own.groupBy("repo", "file_path").agg(listed(F.col("type") == "class").alias("classes"), listed((F.col("type") == "function") & ~inner).alias("functions"))
    files = g.nodes.where("type = 'file'").select("repo", "file_path", F.col("id").alias("of"))
    imports = _joined(g, "imports", "src", "dst").groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "name"))), lambda x: x["name"]).alias("imports"))
    out = files.join(inside, ["repo", "file_path"], "left").join(imports, "of", "left")
    none = lambda name: F.coalesce(name, F.array().cast(out.schema[name].dataType))
    return out.select("of", none("classes").alias("classes"), none("functions").alias("functions"), none("imports").alias("imports"))


def components(g: Graph) -> DataFrame:
    """``id, component``: weakly connected components over all edges; a node without edges is its own."""
    found = connected_components(g.edges.select("src", "dst")).withColumnRenamed("node", "id")
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def find_paths(g: Graph, source: str, target: str, max_length: int = PATH_LENGTH) -> DataFrame:
    """``path``: all simple paths of at most ``max_length`` edges of any type; none if an end is unknown.

    Paths grow from the source; a backward search first keeps only nodes that can still reach the target in time.
    """
    spark = g.edges.sparkSession
    edges = g.edges.select("src", "dst").where("src <> dst").distinct()
    reach = _reached(edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to")), target, max_length).withColumnRenamed("depth", "left")
    useful = materialize(edges.join(reach.select(F.col("id").alias("dst"), "left"), "dst"), "useful")
    known = g.nodes.where(F.col("id").isin(source, target)).select("id").distinct().count()
    empty = spark.createDataFrame([], "path array<string>")
    if known < len({source, target}) or source == target:
        return empty
    now, done = spark.createDataFrame([([source], source)], "path array<string>, at string"), empty
    for length in range(1, max_length + 1):
        now = now.join(useful, now["at"] == useful["src"]).where(~F.array_contains("path", F.col("dst")) & (F.col("left") <= max_length - length))
        now = materialize(now.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")), "paths")
        done = done.unionByName(now.where(F.col("at") == target).select("path"))
        now = now.where(F.col("at") != target)
        if now.isEmpty():
            break
    return done
