"""The dependency graph as tables of nodes and edges, made from the entity table by joins.

Names resolve within a repository: a qualified name first, then a name of the same file, then any, each time
the last one registered; otherwise the first node of that name, or an external node. Every join is by
equality on a key with one row on the looked-up side, so a frequent name costs rows, not pairs.
Edges are always made anew from the entities, so an incremental update equals a full build.

Defined cases: null or empty names give no edge; repeated edges count once, with the last type and the first
place; edges to ids that are no node are dropped; an empty entity table gives empty graphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .entities import deduplicated, identified
from .imports import resolved_imports

#: The order in which an entity's edges are made.
PHASES = {"calls": 0, "contains": 1, "inherits": 2, "defines": 3, "imports": 4}


def external_id(name: Column) -> Column:
    return F.concat(F.lit("external:"), name)


def real_nodes(entities: DataFrame, unique: bool = False) -> DataFrame:
    """One node an id; ``unique`` promises that the entities have one row an id already."""
    return (entities if unique else deduplicated(entities)).select("id", "repo", F.col("entity_type").alias("type"), "name", "file_path", "start_line", "end_line", "seq")


def _registrations(entities: DataFrame) -> DataFrame:
    """``repo, scope, path, symbol, id, seq``: every name an entity is registered under."""
    rows = entities.where(F.col("entity_type").isin("function", "class", "type") & F.col("id").isNotNull() & F.col("name").isNotNull())
    full = F.when((F.col("entity_type") == "function") & (F.coalesce("class_name", F.lit("")) != ""), F.concat_ws(".", "class_name", "name"))
    none = F.lit(None).cast("string")
    entry = lambda scope, path, name: F.struct(F.lit(scope).alias("scope"), path.alias("path"), name.alias("symbol"))
    path = F.col("file_path")
    all_ = F.array(
        entry("file", path, F.col("name")), entry("global", none, F.col("name")),
        entry("qualified", none, full), entry("file", path, full), entry("global", none, full))
    return rows.select("repo", "id", "seq", F.explode(all_).alias("x")).where("x.symbol is not null").select("repo", "x.scope", "x.path", "x.symbol", "id", "seq")


def symbols(entities: DataFrame) -> DataFrame:
    """``repo, scope, file_path, name, id``: scopes ``qualified``, ``file`` and ``global``; the last registration wins."""
    rows = _registrations(entities)
    return rows.groupBy("repo", "scope", F.col("path").alias("file_path"), F.col("symbol").alias("name")).agg(F.max_by("id", "seq").alias("id"))


def symbols_in_file(entities: DataFrame, path: str) -> DataFrame:
    """``repo, scope, file_path, name, id``: what the entities of one path register."""
    return symbols(entities.where(F.col("file_path") == path))


def unregistered(entities: DataFrame, path: str) -> DataFrame:
    """The entities without those of a path; the symbol table of the rest is made from the result."""
    return entities.where(~F.coalesce(F.col("file_path") == path, F.lit(False)))


class Names:
    """Two lookup tables with one row a key: names of a repository, and names of a file."""

    def __init__(self, entities: DataFrame, nodes: DataFrame):
        rows = _registrations(entities)
        first = nodes.where("name is not null").select("repo", F.lit("first").alias("scope"), F.lit(None).cast("string").alias("path"), F.col("name").alias("symbol"), "id", "seq")
        last = lambda scope: F.max_by(F.when(F.col("scope") == scope, F.col("id")), F.when(F.col("scope") == scope, F.col("seq")))
        is_first = F.col("scope") == "first"
        self.of_repo = rows.where("scope <> 'file'").unionByName(first).groupBy(F.col("repo").alias("_repo"), F.col("symbol").alias("_name")).agg(
            last("qualified").alias("_q"), last("global").alias("_g"), F.min_by(F.when(is_first, F.col("id")), F.when(is_first, F.col("seq"))).alias("first_id"))
        self.of_file = rows.where("scope = 'file'").groupBy(F.col("repo").alias("_frepo"), F.col("path").alias("_path"), F.col("symbol").alias("_fname")).agg(F.max_by("id", "seq").alias("_f"))

    def resolve(self, refs: DataFrame) -> DataFrame:
        """``refs`` (repo, file_path, ref) with ``target``, the id a name means in its file, and ``first_id``, the first node of that name; both may be null."""
        out = refs.join(self.of_repo, (F.col("repo") == F.col("_repo")) & (F.col("ref") == F.col("_name")), "left")
        out = out.join(self.of_file, (F.col("repo") == F.col("_frepo")) & (F.col("file_path") == F.col("_path")) & (F.col("ref") == F.col("_fname")), "left")
        return out.withColumn("target", F.coalesce("_q", "_f", "_g")).drop("_q", "_f", "_g", "_repo", "_name", "_frepo", "_path", "_fname")


def _references(entities: DataFrame, kind: str, column: str, edge: str) -> DataFrame:
    rows = entities.where((F.col("entity_type") == kind) & F.col("id").isNotNull())
    return rows.select(F.col("id").alias("src"), "repo", "file_path", "seq", F.posexplode(column).alias("pos", "ref")).where("ref is not null and ref <> ''").withColumn("type", F.lit(edge))


def build_edges(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, type, seq`` of all edges, external targets included."""
    names = Names(entities, nodes)
    methods = entities.where("entity_type = 'function' and coalesce(class_name, '') <> '' and id is not null")
    methods = methods.select(F.col("id").alias("src"), "repo", "file_path", "seq", F.lit(0).alias("pos"), F.col("class_name").alias("ref"), F.lit("contains").alias("type"))
    imported = resolved_imports(entities).select(F.col("id").alias("src"), "repo", "file_path", "seq", "pos", F.col("import").alias("ref"), F.lit("imports").alias("type"), "resolved_id")
    refs = _references(entities, "function", "calls", "calls").unionByName(_references(entities, "class", "bases", "inherits")).unionByName(methods)
    refs = refs.withColumn("resolved_id", F.lit(None).cast("string")).unionByName(imported)
    # One pass of lookups for all kinds. Calls and bases take the last symbol, imports the first node; methods take no placeholder.
    linked = names.resolve(refs)
    kind = F.col("type")
    other = F.when(kind == "imports", F.coalesce("resolved_id", "first_id", external_id(F.col("ref")))).when(kind == "contains", F.col("target")).otherwise(
        F.coalesce("target", "first_id", external_id(F.col("ref"))))
    held = kind == "contains"
    linked = linked.withColumn("_other", other).where("_other is not null").select(
        F.when(held, F.col("_other")).otherwise(F.col("src")).alias("src"), F.when(held, F.col("src")).otherwise(F.col("_other")).alias("dst"), "type", "seq", "pos")
    defined = _references(entities, "file", "defines", "defines").withColumn("dst", F.col("ref"))
    defined = defined.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    columns = ["src", "dst", "type", "seq", "pos"]
    out = linked.select(*columns).unionByName(defined.select(*columns))
    phase = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])[F.col("type")]
    return deduplicated_edges(out.withColumn("at", F.struct("seq", phase.alias("phase"), "pos")))


def deduplicated_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends: the last type, the first place."""
    out = edges.groupBy("src", "dst").agg(F.max_by("type", "at").alias("type"), F.min("at").alias("at"))
    return out.select("src", "dst", "type", F.col("at.seq").alias("seq"), F.col("at.phase").alias("phase"), F.col("at.pos").alias("pos"))


def external_nodes(edges: DataFrame) -> DataFrame:
    rows = edges.where(F.col("dst").startswith("external:")).groupBy("dst").agg(F.min("seq").alias("seq"))
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.col("dst").alias("id"), null("string").alias("repo"), F.lit("external").alias("type"), F.expr("substring(dst, 10)").alias("name"), null("string").alias("file_path"),
        null("int").alias("start_line"), null("int").alias("end_line"), "seq")


class Graph:
    """Nodes and edges; every method is a plan over the two tables."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def build(cls, entities: DataFrame, keep: bool = True, order: tuple[str, ...] = ("seq",), unique: bool = False, written: bool = False) -> "Graph":
        """The graph of an entity table; written to the shared folder, so that questions don't build it again, unless ``keep`` is false.

        ``order`` names the columns that say which registration is the last: an engine's entities are numbered within their
        file and ordered by path first, so that re-parsing a file keeps its place. ``unique`` promises one row an id, ``written`` that the
        entities are a written table already.
        """
        rows = entities if "id" in entities.columns else identified(entities)
        if len(order) > 1:
            rows = rows.withColumn("seq", F.struct(*order))
        keeping = materialize if keep else lambda df, label: df
        rows = (keeping if not written else lambda df, label: df)(rows.select("id", "repo", "file_path", "entity_type", "name", "seq", "start_line", "end_line", "language", "class_name", "calls", "bases", "imports", "defines"), "entities")
        nodes = real_nodes(rows, unique)
        edges = keeping(build_edges(rows, nodes), "edges")
        return cls(keeping(nodes.unionByName(external_nodes(edges)), "nodes"), edges)

    def add_entities(self, nodes: DataFrame) -> "Graph":
        """Upsert nodes."""
        both = self.nodes.withColumn("_new", F.lit(0)).unionByName(nodes.withColumn("_new", F.lit(1)))
        last = both.groupBy("id").agg(F.max_by(F.struct(*self.nodes.columns), "_new").alias("n"), F.min("seq").alias("_seq"))
        return Graph(last.select("n.*", "_seq").withColumn("seq", F.col("_seq")).drop("_seq"), self.edges)

    def add_edges(self, edges: DataFrame) -> "Graph":
        """Edges ``src, dst, type, seq`` whose ends are nodes; a pair's later type wins."""
        known = self.nodes.select("id")
        fresh = edges.join(known, edges["src"] == known["id"], "left_semi").join(known, edges["dst"] == known["id"], "left_semi")
        at = lambda df, late: df.withColumn("at", F.struct("seq", F.lit(late).alias("phase"), F.lit(0).alias("pos"))).select("src", "dst", "type", "at")
        return Graph(self.nodes, deduplicated_edges(at(self.edges, 0).unionByName(at(fresh, 1))))

    def remove_file(self, path: str) -> tuple["Graph", DataFrame]:
        """The graph without a file's nodes and their edges, and the removed ids."""
        gone = self.nodes.where(F.col("file_path") == path).select("id")
        return self.remove_entities(gone), gone

    def remove_entities(self, ids: DataFrame) -> "Graph":
        gone = ids.select(F.col("id").alias("_gone"))
        edges = self.edges.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
        return Graph(self.nodes.join(gone, F.col("id") == F.col("_gone"), "left_anti"), edges)

    def entity(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def has_entity(self, id_: str) -> bool:
        return not self.entity(id_).isEmpty()

    def by_type(self, type_: str) -> DataFrame:
        return self.nodes.where(F.col("type") == type_)

    def by_file(self, path: str) -> DataFrame:
        return self.nodes.where(F.col("file_path") == path)

    def successors(self, id_: str, type_: str | None = None) -> DataFrame:
        out = self.edges.where(F.col("src") == id_)
        return (out.where(F.col("type") == type_) if type_ else out).select(F.col("dst").alias("id"), "type", "seq")

    def predecessors(self, id_: str, type_: str | None = None) -> DataFrame:
        out = self.edges.where(F.col("dst") == id_)
        return (out.where(F.col("type") == type_) if type_ else out).select(F.col("src").alias("id"), "type", "seq")

    def statistics(self) -> DataFrame:
        """One row: nodes, edges, functions, classes, files, types, external."""
        count = lambda t: F.count_if(F.col("type") == t)
        rows = self.nodes.select("type").unionByName(self.edges.select(F.lit("an edge").alias("type")))
        return rows.agg(
            F.count_if(F.coalesce("type", F.lit("")) != "an edge").alias("nodes"), count("function").alias("functions"), count("class").alias("classes"),
            count("file").alias("files"), count("type").alias("types"), count("external").alias("external"), count("an edge").alias("edges"))

    def empty(self) -> "Graph":
        return Graph(self.nodes.limit(0), self.edges.limit(0))


def replace_files(entities: DataFrame, paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """The entity table with the rows of some files (``repo, file_path``) replaced; build the graph from the result.

    A file is a path in a repository; where ``paths`` has no ``repo``, the path in any of them.
    """
    keys = ["repo", "file_path"] if "repo" in paths.columns else ["file_path"]
    gone = paths.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return entities.join(gone, match, "left_anti").unionByName(fresh, allowMissingColumns=True)
