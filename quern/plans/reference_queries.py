"""One query for each operator over the driver's tables, with SQL for a second engine where it can express them.

The code tables are the entity table: functions, classes and files with clean paths, one row an id (the last wins).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.operator import extract_entities
from ..functions.columns import clean_path, current_functions, entity_id, tidy
from ..functions.sql import CLEAN_PATH, CURRENT_FUNCTIONS
from ..operators import entities as E
from ..operators import graph as G
from ..operators import graph_queries as Q
from ..operators import sync as Y
from ..operators import vectors as V
from ..operators.components import connected_components
from ..operators.encode import HashEncoder, ModelEncoder
from ..operators.imports import C_ROOTS, GO_EXTERNAL, GO_ROOTS, JAVA_EXTERNAL, JAVA_ROOTS, PYTHON_EXTERNAL, PYTHON_ROOTS, SUFFIXES, TS_SUFFIXES, language_of, resolved_imports
from ..operators.vector_index import VectorIndex
from ..session import fresh_path, materialize
from ..sources.scan import IGNORED, ignored, should_process
from ..sources.snapshots import SnapshotStore
from ..sources.tables import table
from ..streaming import changes as C

GENERATED = "src/generated/bindings.py"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The entity table."""
    path = clean_path(F.col("file_path"))
    functions = table(spark, d, "code_functions").withColumn("file_path", path).withColumn("entity_type", F.lit("function"))
    classes = table(spark, d, "code_classes").withColumn("file_path", path).withColumn("entity_type", F.lit("class"))
    files = table(spark, d, "code_files").withColumn("file_path", path).withColumn("entity_type", F.lit("file"))
    rows = E.complete(functions).unionByName(E.complete(classes)).unionByName(E.complete(files))
    return E.deduplicated(E.identified(rows))


_KEPT: dict[tuple[str, str, str], object] = {}


def _kept(spark: SparkSession, d: str, what: str, make):
    """One snapshot of ``what`` for a session and a folder: written once to the shared folder, then read."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def slim(spark: SparkSession, d: str) -> DataFrame:
    """The columns the graph is made of."""
    columns = ("id", "repo", "file_path", "entity_type", "name", "seq", "start_line", "end_line", "language", "class_name", "calls", "bases", "imports", "defines")
    return _kept(spark, d, "entities", lambda: materialize(corpus(spark, d).select(*columns), "entities"))


def graph(spark: SparkSession, d: str) -> G.Graph:
    """The graph of the whole corpus, as an engine keeps it."""
    return _kept(spark, d, "graph", lambda: G.Graph.build(slim(spark, d), unique=True, written=True))


# -- vectors --------------------------------------------------------------------------------------
def _probe(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumn("path", F.concat(F.lit("src/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.search(table(spark, d, "embeddings"), _probe(spark, d), 5, id_column="vec_id").select("vec_id", "label", "score")


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return V.search(table(spark, d, "embeddings"), _probe(spark, d), 10, id_column="vec_id", equal={"label": 3}).select("vec_id", "label", "score")


def vector_topk_prefix(spark: SparkSession, d: str, overfetch: int | None = None) -> DataFrame:
    return V.search(_paths(spark, d), _probe(spark, d), 10, id_column="vec_id", prefix=("path", "src/3/"), overfetch=overfetch).select("vec_id", "path", "score")


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """As vector_topk, by the index: only cells that can hold one of the best rows are read."""
    index = _kept(spark, d, "vector index", lambda: VectorIndex.build(table(spark, d, "embeddings"), fresh_path(spark, "index"), len(_probe(spark, d)), id_column="vec_id"))
    return index.search(_probe(spark, d), 5, id_column="vec_id").select("vec_id", "label", "score")


def hash_embed_topk(spark: SparkSession, d: str) -> DataFrame:
    encoder = HashEncoder(256)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", encoder.encode(F.col("text")).alias("embedding"))
    query = spark.range(1).select(encoder.encode(F.lit("which cache holds the merged graph"), True).alias("v")).first().v
    return V.search(rows, list(query), 10, id_column="doc_id").select("doc_id", "score")


def vector_get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return V.get_by_id(table(spark, d, "code_vectors"), f"tidewater-core:{GENERATED}:close_orbit_hash").select("vec_id", "id", "entity_type", "name", "content_hash")


def vector_count(spark: SparkSession, d: str) -> DataFrame:
    return V.counts(table(spark, d, "code_vectors"), "repo", "entity_type")


def vector_count_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_vectors")
    return spark.createDataFrame([(V.count(rows), V.count(rows, repo="tidewater-core"), V.count(rows, repo="tidewater-core", entity_type="function"), V.count(V.cleared(rows)))], "n long, of_repo long, of_kind long, cleared long")


def vector_delete_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """The table without the ids of the failed runs' rows."""
    rows = table(spark, d, "code_vectors")
    return V.without_ids(rows, rows.where("run_id % 7 = 0").select("id")).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def vector_delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    return V.without_file(table(spark, d, "code_vectors"), "tidewater-core", GENERATED).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def vector_delete_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return V.without_repo(table(spark, d, "code_vectors"), "tidewater-core").groupBy("repo", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored rows with those of the last run in place of rows of equal id."""
    rows = table(spark, d, "code_vectors").where("id is not null").select("vec_id", "id", "run_id", "content_hash")
    last = rows.groupBy("id").agg(F.max("vec_id").alias("vec_id"))
    fresh = rows.join(last, ["id", "vec_id"], "left_semi")
    return V.upserted(rows.select("id", "vec_id", "run_id", "content_hash"), fresh).select("vec_id", "id", "run_id")


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return V.content_hashes(table(spark, d, "code_vectors")).where("id is not null").distinct()


def file_of_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_vectors").select("vec_id", E.file_of_id(F.col("id")).alias("file"))


# -- entities -------------------------------------------------------------------------------------
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("id", "entity_type", "seq", "content_hash")


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    rows = E.embeddable(corpus(spark, d))
    return rows.select("id", F.sha2(E.embedding_text(), 256).alias("text_hash"))


def entity_metadata(spark: SparkSession, d: str) -> DataFrame:
    return E.metadata(E.embeddable(corpus(spark, d))).select("id", "entity_type", "signature", F.length("code").alias("code_chars"), "class_name")


def metadata_flat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_functions")
    m = E.flat_metadata({"name": F.col("name"), "class_name": F.col("class_name"), "calls": F.col("calls"), "is_async": F.col("is_async"), "start_line": F.col("start_line")}, {"calls"})
    return rows.select("seq", F.size(m).alias("keys"), F.try_element_at(m, F.lit("calls")).alias("calls"), F.try_element_at(m, F.lit("class_name")).alias("class_name"))


# -- sync -----------------------------------------------------------------------------------------
def _given(spark: SparkSession, d: str) -> DataFrame:
    rows = current_functions(table(spark, d, "code_functions"), hash=F.sha2(F.col("code"), 256))
    return rows.select(entity_id(F.col("repo"), F.col("clean_path"), F.col("class_name"), F.col("name")).alias("id"), F.col("hash").alias("content_hash"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_vectors").where("id is not null and entity_type = 'function'")
    return rows.groupBy("id").agg(F.max_by(tidy(F.col("content_hash")), "vec_id").alias("content_hash"))


def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    return Y.actions(_given(spark, d), _stored(spark, d))


def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return Y.summary(sync_actions(spark, d))


def sync_reconciled(spark: SparkSession, d: str) -> DataFrame:
    return Y.summary(Y.actions(_given(spark, d), _stored(spark, d), reconcile=True))


def _vector_table(spark: SparkSession, d: str) -> DataFrame:
    """The vector table of all repositories: the latest row of each id."""
    rows = table(spark, d, "code_vectors").where("id is not null and entity_type = 'function'")
    last = rows.groupBy("id").agg(F.max_by(F.struct("repo", "file_path", tidy(F.col("content_hash")).alias("content_hash")), "vec_id").alias("x"))
    return last.select("id", E.repo_of_id(F.col("id")).alias("repo"), E.file_of_id(F.col("id")).alias("file_path"), "x.content_hash", F.lit(None).cast("array<float>").alias("embedding"))


def _function_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = current_functions(table(spark, d, "code_functions"), code=F.col("code"), signature=F.col("signature"), docstring=F.col("docstring"))
    rows = rows.withColumnRenamed("clean_path", "file_path").withColumn("entity_type", F.lit("function"))
    return E.identified(E.complete(rows)).where("id is not null")


def sync_file_diff(spark: SparkSession, d: str) -> DataFrame:
    """The sync of the generated file of one repository: what it does, and the table's size after it."""
    out, acts = Y.sync_file(_function_entities(spark, d), _vector_table(spark, d), "tidewater-core", GENERATED, HashEncoder(16))
    return Y.summary(acts).withColumn("stored", F.lit(out.count()))


def sync_all(spark: SparkSession, d: str) -> DataFrame:
    """The vector table's hashes after a whole sync: encoded again what changed, deleted what is gone."""
    out, _ = Y.sync(_function_entities(spark, d), _vector_table(spark, d), HashEncoder(16))
    return out.select("id", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.col("embedding").isNotNull().alias("encoded"))


def full_reindex_counts(spark: SparkSession, d: str) -> DataFrame:
    """A full reindex of one repository, counted by action, and the rows of each repository after it."""
    entities = _function_entities(spark, d).where("repo = 'tidewater-core'")
    out, acts = Y.full_reindex(entities, _vector_table(spark, d), "tidewater-core", HashEncoder(16))
    return acts.groupBy("action").agg(F.count(F.lit(1)).alias("n")).unionByName(out.groupBy(F.col("repo").alias("action")).agg(F.count(F.lit(1)).alias("n")))


def embed_entities(spark: SparkSession, d: str) -> DataFrame:
    """The rows to store of all embeddable entities: every vector has the wanted length and is of length 1 or 0."""
    rows = Y.vector_rows(E.embeddable(corpus(spark, d)), HashEncoder(32))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return rows.select("id", "entity_type", F.size("embedding").alias("dimensions"), F.round(norm, 3).cast("int").alias("unit"))


def encode_truncated(spark: SparkSession, d: str) -> DataFrame:
    """A model's vectors cut to a smaller dimension, for documents and as queries; the model here gives the length of its text."""
    model = ModelEncoder(lambda: lambda texts: [[float(len(t)), 1.0, 2.0] for t in texts], 2, "lengths")
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", model.encode(F.col("text")).alias("v"), model.encode(F.col("text"), True).alias("q")).select(
        "doc_id", F.size("v").alias("dimensions"), F.col("v")[0].cast("long").alias("document_chars"), F.col("q")[0].cast("long").alias("query_chars"))


# -- graph ----------------------------------------------------------------------------------------
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.real_nodes(corpus(spark, d)).select("id", "type", "name", "file_path", "seq")


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.real_nodes(corpus(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).statistics()


def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    return G.symbols(slim(spark, d))


def _edges(kind: str, spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).edges.where(F.col("type") == kind).select("src", "dst")


def external_refs(spark: SparkSession, d: str) -> DataFrame:
    edges = graph(spark, d).edges.where("type in ('calls', 'inherits') and startswith(dst, 'external:')")
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


def imports_resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolved_imports(slim(spark, d)).select("id", "import", "resolved_path", "is_external", "is_relative")


def function_calls(spark: SparkSession, d: str) -> DataFrame:
    return Q.all_function_calls(graph(spark, d)).select("of", "id", "name", "file_path", "type")


def callers(spark: SparkSession, d: str) -> DataFrame:
    return Q.all_callers(graph(spark, d)).select("of", "id", "name", "file_path", "type")


def class_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return Q.class_hierarchy(graph(spark, d))


def file_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return Q.file_dependencies(graph(spark, d))


def file_dependents(spark: SparkSession, d: str) -> DataFrame:
    return Q.file_dependents(graph(spark, d))


def file_structures(spark: SparkSession, d: str) -> DataFrame:
    """Every file's classes with their methods, top-level functions with lines, and imports."""
    out = Q.all_file_structures(graph(spark, d))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("@", x["name"], x["start_line"].cast("string"))), ",")
    classes = F.array_join(F.transform("classes", lambda c: F.concat(c["name"], F.lit("("), F.array_join(c["methods"], "+"), F.lit(")"))), ",")
    return out.select("of", classes.alias("classes"), as_text(F.col("functions")).alias("functions"), F.array_join("imports", ",").alias("imports"))


def successors(spark: SparkSession, d: str) -> DataFrame:
    """What the generated file's first function leads to, and what leads to it, of any type."""
    g = graph(spark, d)
    id_ = f"tidewater-core:{GENERATED}:close_orbit_hash"
    return g.successors(id_).select(F.lit("out").alias("way"), "id", "type").unionByName(g.predecessors(id_).select(F.lit("in").alias("way"), "id", "type"))


def nodes_by(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a file, and the classes, with whether an id is known."""
    g = graph(spark, d)
    of_file = g.by_file(GENERATED).select(F.lit("file").alias("by"), "id")
    known = spark.createDataFrame([("known", str(g.has_entity("nowhere"))), ("known", str(g.has_entity(f"tidewater-core:{GENERATED}")))], "by string, id string")
    return of_file.unionByName(g.by_type("class").select(F.lit("class").alias("by"), "id")).unionByName(known)


def graph_edits(spark: SparkSession, d: str) -> DataFrame:
    """The edges after new ones were added (the later type of a pair wins; ends must be nodes) and a repository's classes were removed, counted by type."""
    g = graph(spark, d)
    uses = g.edges.where("type = 'inherits' and not startswith(dst, 'external:')").select("src", "dst", F.lit("uses").alias("type"), "seq")
    lost = spark.createDataFrame([("nowhere", "nothing", "uses", 1)], "src string, dst string, type string, seq long")
    out = g.add_edges(uses.unionByName(lost)).remove_entities(g.nodes.where("type = 'class' and repo = 'tidewater-core'").select("id"))
    return out.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(out.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("node "), "type").alias("type"), "n"))


def symbols_in_file(spark: SparkSession, d: str) -> DataFrame:
    """The names of one file, and all names once that file is unregistered, counted by scope."""
    rows = slim(spark, d)
    own = G.symbols_in_file(rows, GENERATED).select(F.lit("own").alias("part"), "scope", "name", "id")
    rest = G.symbols(G.unregistered(rows, GENERATED)).groupBy("scope").agg(F.count(F.lit(1)).cast("string").alias("name")).select(F.lit("rest").alias("part"), "scope", "name", F.lit(None).cast("string").alias("id"))
    return own.unionByName(rest)


def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return Q.find_symbol(graph(spark, d), "close_orbit_hash", GENERATED).select("id", "name", "type", "score")


def _root(g: G.Graph) -> str:
    """The function with most calls, the first by id among equals."""
    return g.edges.where("type = 'calls'").groupBy("src").count().orderBy(F.col("count").desc(), "src").first().src


def call_chain_levels(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return Q.call_chain_levels(g, _root(g), Q.DEPTH)


def call_chain_tree(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    rows = []

    def flat(node: dict, depth: int) -> None:
        rows.append((node["id"], node["name"], depth, node["truncated"], node["cycle"]))
        for child in node["calls"]:
            flat(child, depth + 1)

    flat(Q.call_chain(g, _root(g), Q.DEPTH), 0)
    return spark.createDataFrame(rows, "id string, name string, depth int, truncated boolean, cycle boolean")


def components(spark: SparkSession, d: str) -> DataFrame:
    return Q.components(graph(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def components_inherits(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_edges("inherits", spark, d))


def find_paths(spark: SparkSession, d: str) -> DataFrame:
    """From the function with most calls to what is most calls away from it, the last by id among equals."""
    g = graph(spark, d)
    root = _root(g)
    goal = Q.call_chain_levels(g, root, Q.PATH_LENGTH).orderBy(F.col("depth").desc(), F.col("id").desc()).first().id
    return Q.find_paths(g, root, goal, Q.PATH_LENGTH).select(F.array_join("path", " > ").alias("path"))


def call_chain_incoming(spark: SparkSession, d: str) -> DataFrame:
    """Who reaches the function that most others call, in at most five calls."""
    g = graph(spark, d)
    goal = g.edges.where("type = 'calls'").groupBy("dst").count().orderBy(F.col("count").desc(), "dst").first().dst
    return Q.call_chain_levels(g, goal, Q.DEPTH, "incoming")


def remove_file(spark: SparkSession, d: str) -> DataFrame:
    """The statistics without a file, and how many nodes went."""
    g, gone = graph(spark, d).remove_file(GENERATED)
    return g.statistics().withColumn("gone", F.lit(gone.count()))


# -- files, changes, status -----------------------------------------------------------------------
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_files").select("seq", ignored(F.col("file_path")).alias("ignored"))


def language_of_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_functions").select("seq", language_of(F.col("file_path")).alias("language"))


def should_process_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_files").select("seq", should_process(F.col("file_path")).alias("wanted"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("change_type"), F.col("ts").alias("event_time"))


def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    return C.batch_sessions(_changes(spark, d), "60 seconds").groupBy("batch").agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("change_type") == "delete").alias("deletes"))


def debounce_last_event(spark: SparkSession, d: str) -> DataFrame:
    return C.last_changes(_changes(spark, d)).select("path", "change_type")


def move_explode(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(
        F.when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("event"),
        F.concat(F.lit("a"), F.col("user_id")).alias("path"), F.concat(F.lit("b"), F.col("user_id")).alias("dest"), F.lit(False).alias("is_directory"), F.col("ts").alias("event_time"))
    return C.exploded_moves(events).groupBy("path", "change_type").agg(F.count(F.lit(1)).alias("n"))


def apply_delta(spark: SparkSession, d: str) -> DataFrame:
    """The entities after the files with classes were replaced: each class by a function of its name."""
    rows = corpus(spark, d)
    old = rows.where("entity_type = 'class'")
    fresh = E.identified(E.complete(old.withColumn("entity_type", F.lit("function"))))
    return G.replace_files(rows, old.select("repo", "file_path"), fresh).groupBy("repo", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the graph and of the vector table."""
    counts = graph(spark, d).statistics().select("functions", "classes", "files")
    return counts.withColumn("embeddings", F.lit(V.count(table(spark, d, "code_vectors"))))


def _file_events(spark: SparkSession, d: str) -> DataFrame:
    """An event a file row: every third a deletion, in the order of arrival."""
    kind = F.when(F.col("seq") % 3 == 0, "delete").otherwise("upsert")
    return table(spark, d, "code_files").select(clean_path(F.col("file_path")).alias("path"), kind.alias("change_type"), F.timestamp_seconds("seq").alias("event_time"))


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes that a stream over a folder of events hands on: accepted files, the last change of each."""
    inbox, out = fresh_path(spark, "inbox"), fresh_path(spark, "applied")
    _file_events(spark, d).write.json(inbox)
    query = C.start(C.change_stream(spark, inbox), lambda batch, number: batch.write.mode("append").parquet(out), fresh_path(spark, "checkpoint"))
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("path", "change_type")


def corrected_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes of all functions' files, corrected by whether the file is there."""
    changes = table(spark, d, "code_functions").select(clean_path(F.col("file_path")).alias("path"), F.lit("upsert").alias("change_type"), F.col("modified_at").alias("event_time"))
    there = table(spark, d, "code_files").select(clean_path(F.col("file_path")).alias("path"))
    return C.corrected(C.last_changes(changes), there)


def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """A store's present and first version: tables not saved again keep their rows, older versions stay readable."""
    store = SnapshotStore(spark, fresh_path(spark, "store"))
    files, runs = table(spark, d, "code_files").select("seq"), table(spark, d, "sync_runs").select("run_id")
    store.save({"files": files, "runs": runs})
    store.save({"files": files.where("seq % 2 = 0")})
    rows = [(f"{name} {version}", store.load(name, version).count()) for name in ("files", "runs") for version in (0, 1)]
    rows += [("version", store.version()), ("missing", int(store.load("none") is None))]
    return spark.createDataFrame(rows, "what string, n long")


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """Entities from the code of every function row, each taken for a file."""
    rows = table(spark, d, "code_functions")
    path = F.concat(F.col("seq").cast("string"), F.lit("."), F.regexp_extract("file_path", r"([^./\\]+)\s*$", 1))
    files = rows.select(path.alias("file_path"), language_of(path).alias("language"), F.encode("code", "UTF-8").alias("content")).where("language is not null")
    out = extract_entities(files, "snippets")
    return out.groupBy("language", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("calls")).alias("calls"))


QUERIES = {
    "vector_topk": vector_topk, "vector_topk_filtered": vector_topk_filtered, "vector_topk_prefix": vector_topk_prefix, "vector_topk_overfetch": partial(vector_topk_prefix, overfetch=3),
    "vector_index_topk": vector_index_topk, "hash_embed_topk": hash_embed_topk, "vector_get_by_id": vector_get_by_id, "vector_count": vector_count, "vector_count_of": vector_count_of, "vector_delete_by_ids": vector_delete_by_ids, "vector_delete_by_file": vector_delete_by_file,
    "vector_delete_by_repo": vector_delete_by_repo, "vector_upsert": vector_upsert, "content_hashes": content_hashes, "file_of_id": file_of_id, "entity_ids": entity_ids, "embed_text": embed_text,
    "entity_metadata": entity_metadata, "metadata_flat": metadata_flat, "sync_actions": sync_actions, "sync_diff": sync_diff, "sync_reconciled": sync_reconciled,
    "sync_file_diff": sync_file_diff, "full_reindex_counts": full_reindex_counts, "sync_all": sync_all, "embed_entities": embed_entities, "encode_truncated": encode_truncated, "graph_nodes": graph_nodes, "node_counts": node_counts, "graph_statistics": graph_statistics,
    "symbol_table": symbol_table, "calls_edges": partial(_edges, "calls"), "contains_edges": partial(_edges, "contains"), "inherits_edges": partial(_edges, "inherits"),
    "defines_edges": partial(_edges, "defines"), "imports_edges": partial(_edges, "imports"), "external_refs": external_refs, "imports_resolved": imports_resolved,
    "function_calls": function_calls, "callers": callers, "class_hierarchy": class_hierarchy, "file_dependencies": file_dependencies, "file_dependents": file_dependents,
    "file_structures": file_structures, "successors": successors, "nodes_by": nodes_by, "graph_edits": graph_edits, "symbols_in_file": symbols_in_file, "call_chain_incoming": call_chain_incoming, "find_symbol": find_symbol, "call_chain_levels": call_chain_levels, "call_chain_tree": call_chain_tree, "components": components,
    "components_inherits": components_inherits, "find_paths": find_paths, "remove_file": remove_file, "ignore_filter": ignore_filter, "language_of_file": language_of_file,
    "should_process_files": should_process_files, "debounce_batches": debounce_batches, "debounce_last_event": debounce_last_event, "move_explode": move_explode,
    "apply_delta": apply_delta, "index_status": index_status, "stream_changes": stream_changes, "corrected_changes": corrected_changes, "snapshot_versions": snapshot_versions, "extracted": extracted,
}

_PATH = CLEAN_PATH.format("file_path")
_HEADER = "sha256(name || ':' || array_to_string(list_sort(coalesce(bases, [])), ',') || ':' || array_to_string(list_sort(coalesce(decorators, [])), ','))"
_ENT = f"""
raw as (
  select seq, repo, {_PATH} as file_path, 'function' as entity_type, name, class_name, calls, null::varchar[] as bases, null::varchar[] as defines, decorators, docstring, signature, code, null::varchar[] as methods, sha256(code) as content_hash,
    start_line, end_line, null::varchar as language, null::varchar[] as imports from code_functions
  union all select seq, repo, {_PATH}, 'class', name, null, null, bases, null, decorators, docstring, null, code, methods, {_HEADER}, start_line, end_line, null, null from code_classes
  union all select seq, repo, {_PATH}, 'file', name, null, null, null, defines, null, null, null, null, null, null, start_line, end_line, language, imports from code_files),
ids as (select *, case when entity_type = 'file' then repo || ':' || file_path when coalesce(class_name, '') <> '' then repo || ':' || file_path || ':' || class_name || '.' || name else repo || ':' || file_path || ':' || name end as id from raw),
ent as (select * exclude (rn, seq, fs, k), fs as seq from (select *, min(seq) over (partition by id, k) fs, row_number() over (partition by id, k order by seq desc) rn from (select *, case when id is null then seq end as k from ids)) where rn = 1)
"""
_SYM = """
ent0 as (select * from ent where entity_type in ('function', 'class') and id is not null and name is not null),
reg as (
  select repo, 'file' as scope, file_path, name, id, seq from ent0
  union all select repo, 'global', null, name, id, seq from ent0
  union all select repo, s.scope, case when s.scope = 'file' then file_path end, class_name || '.' || name, id, seq from ent0, (values ('qualified'), ('file'), ('global')) s(scope)
    where entity_type = 'function' and coalesce(class_name, '') <> ''),
sym as (select repo, scope, file_path, name, arg_max(id, seq) as id from reg group by all),
fst as (select repo, name, arg_min(id, seq) as id from ent where name is not null group by all)
"""
_RES = """
select r.src, coalesce(q.id, f.id, g.id, n.id, 'external:' || r.ref) as dst from refs r
left join sym q on q.scope = 'qualified' and q.repo = r.repo and q.name = r.ref
left join sym f on f.scope = 'file' and f.repo = r.repo and f.file_path = r.file_path and f.name = r.ref
left join sym g on g.scope = 'global' and g.repo = r.repo and g.name = r.ref
left join fst n on n.repo = r.repo and n.name = r.ref
"""


def _refs(column: str, kind: str) -> str:
    return f"refs as (select id as src, repo, file_path, ref from (select id, repo, file_path, unnest({column}) as ref from ent where entity_type = '{kind}' and id is not null) where ref is not null and ref <> '')"


#: Import resolution: the candidates of every language in order, the first that is a file, and the first file of that path or with that tail.
def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _normal(path: str) -> str:
    """A path with ``.`` and ``..`` resolved; ``..`` beyond the top stays."""
    last = "string_split(a, '/')[-1]"
    return (f"list_reduce(list_prepend('', list_filter(string_split({path}, '/'), lambda x: x <> '' and x <> '.')), "
            f"lambda a, x: case when x = '..' and a <> '' and {last} <> '..' then regexp_replace(a, '/?[^/]*$', '') when a = '' then x else a || '/' || x end)")


def _below(folder: str, rest: str) -> str:
    return f"(case when {folder} = '' then {rest} else {folder} || '/' || {rest} end)"


def _tried(base: str, tails) -> str:
    return "[" + ", ".join(f"({base}) || '{t}'" for t in tails) + "]"


_UPS = "list_filter(string_split(folder, '/'), lambda x: x <> '')"
_DOTS = "length(regexp_extract(imp, '^(\\.*)', 1))"
_PY_BASE = f"array_to_string(list_slice({_UPS}, 1, greatest(len({_UPS}) - ({_DOTS} - 1), 0)), '/')"
_PY_REST = "replace(regexp_replace(imp, '^\\.+', ''), '.', '/')"
_PY_TARGET = f"(case when {_PY_REST} = '' then {_PY_BASE} else {_below(_PY_BASE, _PY_REST)} end)"
_UP = "regexp_replace(regexp_extract(folder, '^(.*)/[^/]*$', 1), '/+$', '')"
_RUST_BASE = f"(case split_part(imp, '::', 1) when 'super' then {_UP} when 'crate' then 'src' else folder end)"
_RUST_REST = "array_to_string(string_split(imp, '::')[2:], '/')"
_GO = "trim(imp, '\"''')"
_BARE = "trim(imp, '<>\"''')"
_SCRIPT = f"case when starts_with(imp, './') or starts_with(imp, '../') then {_tried(_normal(_below('folder', 'imp')), TS_SUFFIXES)} else [] end"
_HEADER_FILE = f"case when ends_with({_BARE}, '.h') then [{_normal(_below('folder', _BARE))}, " + ", ".join(_normal(f"'{r}' || " + _BARE) for r in ("", *C_ROOTS)) + "] else [] end"
_CANDIDATES = f"""case lang
  when 'python' then case when starts_with(imp, '.') then [{_PY_TARGET} || '.py', {_below(_PY_TARGET, "'__init__.py'")}] when split_part(imp, '.', 1) in {_in(PYTHON_EXTERNAL)} then []
    else [{", ".join(f"'{r}' || replace(imp, '.', '/') || '{t}'" for r in PYTHON_ROOTS for t in (".py", "/__init__.py"))}] end
  when 'typescript' then {_SCRIPT} when 'javascript' then {_SCRIPT}
  when 'go' then case when contains(split_part({_GO}, '/', 1), '.') or split_part({_GO}, '/', 1) in {_in(GO_EXTERNAL)} then []
    else [{", ".join(f"'{r}' || {_GO} || '{t}'" for r in GO_ROOTS for t in (".go", "/main.go"))}] end
  when 'rust' then case when split_part(imp, '::', 1) in ('self', 'super', 'crate') and {_RUST_REST} <> '' then {_tried(_normal(_below(_RUST_BASE, _RUST_REST)), (".rs", "/mod.rs"))} else [] end
  when 'java' then case when {" or ".join(f"starts_with(imp, '{x}')" for x in JAVA_EXTERNAL)} then [] else [{", ".join(f"'{r}' || replace(imp, '.', '/') || '.java'" for r in JAVA_ROOTS)}] end
  when 'c' then {_HEADER_FILE} when 'cpp' then {_HEADER_FILE} else [] end"""
_LANGUAGE = "case lower(regexp_extract({0}, '[^/]\\.([^./]+)$', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in SUFFIXES.items()) + " end"
_IMP = f"""
imps as (select id, repo, file_path, seq, pos, imp, lang, regexp_replace(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/+$', '') as folder
  from (select id, repo, file_path, seq, unnest(imports) as imp, generate_subscripts(imports, 1) - 1 as pos, coalesce(lower(trim(language)), {_LANGUAGE.format("file_path")}) as lang from ent where entity_type = 'file' and id is not null)
  where imp is not null and imp <> ''),
tries as (select id, repo, pos, unnest(c) as path, generate_subscripts(c, 1) as rank from (select id, repo, pos, cast({_CANDIDATES} as varchar[]) as c from imps)),
hits as (select t.id, t.pos, t.repo, arg_min(t.path, t.rank) as path from tries t join (select distinct repo, file_path from ent where entity_type = 'file') f on f.repo = t.repo and f.file_path = t.path group by all),
targets as (select h.id, h.pos, any_value(h.path) as path, arg_min(e.id, e.seq) as target from hits h join ent e on e.entity_type = 'file' and e.id is not null and e.repo = h.repo and (e.file_path = h.path or ends_with(e.file_path, '/' || h.path)) group by h.id, h.pos),
resolved as (select i.*, t.path, t.target from imps i left join targets t on t.id = i.id and t.pos = i.pos)
"""
_REF = """
refs as (select id as src, repo, file_path, seq, pos, ref, kind from (
    select id, repo, file_path, seq, unnest(calls) as ref, generate_subscripts(calls, 1) - 1 as pos, 'calls' as kind from ent where entity_type = 'function' and id is not null
    union all select id, repo, file_path, seq, unnest(bases), generate_subscripts(bases, 1) - 1, 'inherits' from ent where entity_type = 'class' and id is not null
    union all select id, repo, file_path, seq, class_name, 0, 'contains' from ent where entity_type = 'function' and coalesce(class_name, '') <> '' and id is not null) where ref is not null and ref <> ''),
linked as (select r.*, coalesce(q.id, f.id, g.id) as target, n.id as first_id from refs r
  left join sym q on q.scope = 'qualified' and q.repo = r.repo and q.name = r.ref
  left join sym f on f.scope = 'file' and f.repo = r.repo and f.file_path = r.file_path and f.name = r.ref
  left join sym g on g.scope = 'global' and g.repo = r.repo and g.name = r.ref
  left join fst n on n.repo = r.repo and n.name = r.ref),
alle as (
  select src, coalesce(target, first_id, 'external:' || ref) as dst, kind as type, seq, case kind when 'calls' then 0 else 2 end as phase, pos from linked where kind <> 'contains'
  union all select target, src, kind, seq, 1, pos from linked where kind = 'contains' and target is not null
  union all select x.id, x.def, 'defines', x.seq, 3, x.pos from (select id, seq, unnest(defines) as def, generate_subscripts(defines, 1) - 1 as pos from ent where entity_type = 'file' and id is not null) x join ent e on e.id = x.def
  union all select r.id, coalesce(r.target, n.id, 'external:' || r.imp), 'imports', r.seq, 4, r.pos from resolved r left join fst n on n.repo = r.repo and n.name = r.imp),
edge as (select src, dst, arg_max(type, (seq, phase, pos)) as type, min((seq, phase, pos)) as at from alle group by src, dst),
node as (select id, entity_type as type, repo, name, file_path, start_line, end_line, seq from ent union all select distinct dst, 'external', null, substring(dst, 10), null, null, null, null from edge where starts_with(dst, 'external:'))
"""
_GRAPH = f"with recursive {_ENT}, {_SYM}, {_IMP}, {_REF}"
_STATS = "select count(*) as nodes, count(*) filter (where type = 'function') as functions, count(*) filter (where type = 'class') as classes, count(*) filter (where type = 'file') as files, count(*) filter (where type = 'type') as types, count(*) filter (where type = 'external') as external"
_CALLS = f"with {_ENT}, {_SYM}, {_refs('calls', 'function')}, edge as (select distinct src, dst from ({_RES}))"
_INHERITS = f"with {_ENT}, {_SYM}, {_refs('bases', 'class')}, edge as (select distinct src, dst from ({_RES}))"
_COS = "round(list_cosine_similarity(e.embedding::double[], q.v), 6)"
_Q0 = "with q as (select embedding::double[] as v from embeddings where vec_id = 0)"
_TIDY = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'))"
_SYNC = f"""
with given as (select repo || ':' || clean_path || ':' || coalesce(class_name || '.', '') || name as id, sha256(code) as h from ({CURRENT_FUNCTIONS})),
stored as (select id, coalesce(arg_max(h, vec_id), '') as h from (select id, vec_id, {_TIDY.format('content_hash')} as h from code_vectors where id is not null and entity_type = 'function') group by id),
both_ as (select coalesce(g.id, s.id) as id, g.id as gid, s.id as sid, g.h as gh, s.h as sh from given g full join stored s on g.id = s.id),
files as (select distinct split_part(id, ':', 1) || ':' || regexp_extract(id, '^[^:]*:(.*):[^:]*$', 1) as f from given where id is not null),
acts as (select id, case when sid is null then 'added' when gid is not null and gh = sh then 'skipped' when gid is not null then 'updated' when split_part(id, ':', 1) || ':' || regexp_extract(id, '^[^:]*:(.*):[^:]*$', 1) in (select f from files) then 'deleted' end as action,
  case when sid is null then 'added' when gid is not null and gh = sh then 'skipped' when gid is not null then 'updated' else 'deleted' end as strict from both_)
"""


def _counts(column: str = "action", where: str = "true") -> str:
    parts = ", ".join(f"count(*) filter (where {column} = '{n}') as {n}" for n in ("added", "updated", "deleted", "skipped"))
    return f"select {parts}, count({column}) as total_processed from acts where {column} is not null and {where}"


_EVENTS = "select cast(user_id as varchar) as path, case when event_type = 'error' then 'delete' else 'upsert' end as change_type, ts from events"
_CHAIN = """, root as (select src from edge group by src order by count(*) desc, src limit 1)"""

ORACLES = {
    "vector_topk": f"{_Q0} select vec_id, label, {_COS} as score from embeddings e, q order by score desc, vec_id limit 5",
    "vector_topk_filtered": f"{_Q0} select vec_id, label, {_COS} as score from embeddings e, q where label = 3 order by score desc, vec_id limit 10",
    "vector_topk_prefix": f"{_Q0} select vec_id, 'src/' || label || '/' || vec_id as path, {_COS} as score from embeddings e, q where label = 3 order by score desc, vec_id limit 10",
    "vector_topk_overfetch": f"{_Q0} select * from (select vec_id, 'src/' || label || '/' || vec_id as path, {_COS} as score from embeddings e, q order by score desc, vec_id limit 30) where starts_with(path, 'src/3/') order by score desc, vec_id limit 10",
    "vector_get_by_id": f"select vec_id, id, entity_type, name, content_hash from code_vectors where id = 'tidewater-core:{GENERATED}:close_orbit_hash'",
    "vector_count": "select repo, entity_type, count(*) as n from code_vectors group by all",
    "vector_delete_by_file": f"select repo, count(*) as n from code_vectors where not coalesce(repo = 'tidewater-core' and file_path = '{GENERATED}', false) group by repo",
    "vector_delete_by_repo": "select repo, entity_type, count(*) as n from code_vectors where not coalesce(repo = 'tidewater-core', false) group by all",
    "vector_upsert": "select max(vec_id) as vec_id, id, arg_max(run_id, vec_id) as run_id from code_vectors where id is not null group by id",
    "content_hashes": "select distinct id, coalesce(content_hash, '') as content_hash from code_vectors where id is not null",
    "file_of_id": "select vec_id, case when len(string_split(id, ':')) >= 3 then regexp_extract(id, '^[^:]*:(.*):[^:]*$', 1) when len(string_split(id, ':')) = 2 then string_split(id, ':')[2] else '' end as file from code_vectors",
    "entity_ids": f"with {_ENT} select id, entity_type, seq, content_hash from ent",
    "embed_text": f"""with {_ENT} select id, sha256(case when entity_type = 'function' then concat_ws(chr(10), case when file_path <> '' then 'File: ' || file_path end, case when coalesce(class_name, '') <> '' then 'Class: ' || class_name end,
  case when coalesce(class_name, '') <> '' then 'Method: ' || name else 'Function: ' || name end, case when signature <> '' then 'Signature: ' || signature end, case when docstring <> '' then 'Description: ' || docstring end,
  case when len(decorators) > 0 then 'Decorators: ' || array_to_string(decorators, ', ') end, 'Code:' || chr(10) || coalesce(code, ''))
 else concat_ws(chr(10), case when file_path <> '' then 'File: ' || file_path end, 'Class: ' || name, case when len(bases) > 0 then 'Inherits: ' || array_to_string(bases, ', ') end, case when docstring <> '' then 'Description: ' || docstring end,
  case when len(decorators) > 0 then 'Decorators: ' || array_to_string(decorators, ', ') end, case when len(methods) > 0 then 'Methods: ' || array_to_string(methods, ', ') end, 'Definition:' || chr(10) || substring(coalesce(code, ''), 1, 2000)) end) as text_hash
 from ent where entity_type <> 'file'""",
    "entity_metadata": f"with {_ENT} select id, entity_type, case when entity_type = 'function' then signature end as signature, case when entity_type = 'class' then least(length(code), 5000) else length(code) end as code_chars, case when entity_type = 'function' then class_name end as class_name from ent where entity_type <> 'file'",
    "metadata_flat": "select seq, (name is not null)::int + (class_name is not null)::int + (calls is not null)::int + (is_async is not null)::int + (start_line is not null)::int as keys, array_to_string(calls, ',') as calls, class_name from code_functions",
    "sync_actions": _SYNC + "select id, action from acts where action is not null",
    "sync_diff": _SYNC + _counts(),
    "sync_reconciled": _SYNC + _counts("strict"),
    "sync_file_diff": _SYNC + f", own as (select * from acts where starts_with(id, 'tidewater-core:{GENERATED}:')) select count(*) filter (where strict = 'added') as added, count(*) filter (where strict = 'updated') as updated, count(*) filter (where strict = 'deleted') as deleted, "
        "count(*) filter (where strict = 'skipped') as skipped, count(*) as total_processed, (select count(*) from stored) + count(*) filter (where strict = 'added') - count(*) filter (where strict = 'deleted') as stored from own",
    "sync_all": _SYNC + "select a.id, coalesce(case when a.action in ('added', 'updated') then g.h else s.h end, '') as content_hash, coalesce(a.action in ('added', 'updated'), false) as encoded from acts a left join given g on g.id = a.id left join stored s on s.id = a.id where a.id is not null and coalesce(a.action, '') <> 'deleted'",
    "full_reindex_counts": _SYNC + "select 'deleted' as action, count(*) as n from stored where split_part(id, ':', 1) = 'tidewater-core' union all select 'added', count(*) from given where split_part(id, ':', 1) = 'tidewater-core' "
        "union all select r, count(*) from (select split_part(id, ':', 1) as r from stored where split_part(id, ':', 1) <> 'tidewater-core' union all select 'tidewater-core' from given where split_part(id, ':', 1) = 'tidewater-core') group by r",
    "embed_entities": f"with {_ENT} select id, entity_type, 32 as dimensions, 1 as unit from ent where entity_type <> 'file'",
    "encode_truncated": "select doc_id, 2 as dimensions, length(coalesce(text, '')) + 17 as document_chars, length(coalesce(text, '')) + 14 as query_chars from documents",
    "vector_count_of": "select count(*) as n, count(*) filter (where repo = 'tidewater-core') as of_repo, count(*) filter (where repo = 'tidewater-core' and entity_type = 'function') as of_kind, 0 as cleared from code_vectors",
    "vector_delete_by_ids": "select repo, count(*) as n from code_vectors where id is null or id not in (select id from code_vectors where run_id % 7 = 0 and id is not null) group by repo",
    "graph_nodes": f"with {_ENT} select id, entity_type as type, name, file_path, seq from ent",
    "node_counts": f"with {_ENT} select entity_type as type, count(*) as n from ent group by 1",
    "symbol_table": f"with {_ENT}, {_SYM} select repo, scope, file_path, name, id from sym",
    "calls_edges": _CALLS + " select src, dst from edge",
    "inherits_edges": _INHERITS + " select src, dst from edge",
    "contains_edges": f"with {_ENT}, {_SYM}, m as (select id as dst, repo, file_path, class_name as ref from ent where entity_type = 'function' and coalesce(class_name, '') <> '' and id is not null) "
        "select distinct coalesce(q.id, f.id, g.id) as src, m.dst from m left join sym q on q.scope = 'qualified' and q.repo = m.repo and q.name = m.ref "
        "left join sym f on f.scope = 'file' and f.repo = m.repo and f.file_path = m.file_path and f.name = m.ref left join sym g on g.scope = 'global' and g.repo = m.repo and g.name = m.ref where coalesce(q.id, f.id, g.id) is not null",
    "defines_edges": f"with {_ENT} select distinct x.id as src, x.def as dst from (select id, unnest(defines) as def from ent where entity_type = 'file' and id is not null) x join ent e on e.id = x.def",
    "external_refs": f"with {_ENT}, {_SYM}, {_refs('calls', 'function')}, {_refs('bases', 'class').replace('refs as', 'refs2 as')} select dst, count(*) as n from (select distinct * from ({_RES}) union select distinct * from ({_RES.replace('from refs r', 'from refs2 r')})) where starts_with(dst, 'external:') group by dst",
    "function_calls": _CALLS + " select e.src as of, e.dst as id, coalesce(x.name, substring(e.dst, 10)) as name, x.file_path, coalesce(x.entity_type, 'external') as type from edge e left join ent x on x.id = e.dst",
    "callers": _CALLS + " select e.dst as of, e.src as id, x.name, x.file_path, x.entity_type as type from edge e join ent x on x.id = e.src",
    "class_hierarchy": _INHERITS + " select e.src as of, 'parent' as relation, e.dst as id, coalesce(x.name, substring(e.dst, 10)) as name, x.file_path, x.id is null as is_external from edge e left join ent x on x.id = e.dst "
        "union all select e.dst, 'child', e.src, x.name, x.file_path, false from edge e join ent x on x.id = e.src",
    "find_symbol": f"with {_ENT} select id, name, entity_type as type, case when name = 'close_orbit_hash' then case when file_path = '{GENERATED}' then 150 else 100 end else case when file_path = '{GENERATED}' then 75 else 50 end end as score from ent "
        "where name = 'close_orbit_hash' or ends_with(name, '.close_orbit_hash') or ends_with(id, ':close_orbit_hash')",
    "call_chain_levels": _CALLS.replace("with ", "with recursive ", 1) + _CHAIN + ", walk as (select src as id, 0 as depth from root union select e.dst, walk.depth + 1 from walk join edge e on e.src = walk.id where walk.depth < 5) select id, min(depth) as depth from walk group by id",
    "components_inherits": _INHERITS.replace("with ", "with recursive ", 1) + ", und as (select src as a, dst as b from edge union select dst, src from edge), reach as (select a as node, a as other from und union select reach.node, und.b from reach join und on und.a = reach.other) select node, min(other) as component from reach group by node",
    "language_of_file": "select seq, case lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) when 'py' then 'python' when 'ts' then 'typescript' when 'js' then 'javascript' when 'go' then 'go' when 'rs' then 'rust' when 'java' then 'java' end as language from code_functions",
    "debounce_batches": f"with e as ({_EVENTS}), g as (select *, case when ts - lag(ts) over (order by ts) <= interval 60 seconds then 0 else 1 end as fresh from e), s as (select *, sum(fresh) over (order by ts range unbounded preceding) as batch from g), "
        "l as (select batch, path, arg_max(change_type, (ts, change_type = 'delete')) as change_type from s group by all) select batch::bigint as batch, count(*) as paths, count(*) filter (where change_type = 'delete') as deletes from l group by batch",
    "debounce_last_event": f"select path, arg_max(change_type, (ts, change_type = 'delete')) as change_type from ({_EVENTS}) group by path",
    "move_explode": "with x as (select 'a' || user_id as path, case when event_type in ('click', 'error') then 'delete' else 'upsert' end as change_type from events union all select 'b' || user_id, 'upsert' from events where event_type = 'click') select path, change_type, count(*) as n from x group by all",
    "apply_delta": f"with {_ENT}, c as (select repo, file_path from ent where entity_type = 'class') select repo, entity_type, count(*) as n from (select repo, entity_type from ent e where not exists (select 1 from c where c.repo is not distinct from e.repo and c.file_path is not distinct from e.file_path) "
        "union all select repo, 'function' from c) group by all",
    "imports_resolved": f"with {_ENT}, {_IMP} select id, imp as \"import\", path as resolved_path, path is null as is_external, starts_with(imp, '.') or regexp_matches(imp, '^(self|super|crate)\\b') as is_relative from resolved",
    "imports_edges": _GRAPH + "select src, dst from edge where type = 'imports'",
    "graph_statistics": _GRAPH + _STATS + ", (select count(*) from edge) as edges from node",
    "remove_file": _GRAPH + f", kept as (select * from node where file_path is distinct from '{GENERATED}'), gone as (select id from node where file_path = '{GENERATED}') " + _STATS
        + ", (select count(*) from edge where src not in (select id from gone) and dst not in (select id from gone)) as edges, (select count(*) from gone) as gone from kept",
    "file_dependencies": _GRAPH + "select e.src as of, e.dst as id, n.name, n.file_path, n.type, n.type = 'external' as is_external from edge e join node n on n.id = e.dst where e.type = 'imports'",
    "file_dependents": _GRAPH + "select e.dst as of, e.src as id, n.name, n.file_path from edge e join node n on n.id = e.src where e.type = 'imports'",
    "file_structures": _GRAPH + """, m as (select e.src, string_agg(n.name, '+' order by n.seq, n.name) as methods from edge e join node n on n.id = e.dst where e.type = 'contains' group by e.src),
own as (select n.*, coalesce(m.methods, '') as methods, contains(string_split(n.id, ':')[-1], '.') as inner_ from node n left join m on m.src = n.id where n.type in ('class', 'function') and n.file_path is not null),
cls as (select repo, file_path, string_agg(name || '(' || methods || ')', ',' order by seq, id) as classes from own where type = 'class' group by all),
fun as (select repo, file_path, string_agg(concat_ws('@', name, start_line::varchar), ',' order by seq, id) as functions from own where type = 'function' and not inner_ group by all),
imp as (select e.src, string_agg(n.name, ',' order by e.at, n.name) as imports from edge e join node n on n.id = e.dst where e.type = 'imports' group by e.src)
select f.id as of, coalesce(c.classes, '') as classes, coalesce(u.functions, '') as functions, coalesce(i.imports, '') as imports from node f left join cls c on c.repo = f.repo and c.file_path = f.file_path
left join fun u on u.repo = f.repo and u.file_path = f.file_path left join imp i on i.src = f.id where f.type = 'file' and f.repo is not null and f.file_path is not null""",
    "successors": _GRAPH + f"select 'out' as way, dst as id, type from edge where src = 'tidewater-core:{GENERATED}:close_orbit_hash' union all select 'in', src, type from edge where dst = 'tidewater-core:{GENERATED}:close_orbit_hash'",
    "nodes_by": _GRAPH + f"select 'file' as by, id from node where file_path = '{GENERATED}' union all select 'class', id from node where type = 'class' union all select 'known', case when x in (select id from node) then 'True' else 'False' end from (values ('nowhere'), ('tidewater-core:{GENERATED}')) t(x)",
    "graph_edits": _GRAPH + """, gone as (select id from node where type = 'class' and repo = 'tidewater-core'),
left_ as (select case when type = 'inherits' and not starts_with(dst, 'external:') then 'uses' else type end as type from edge where src not in (select id from gone) and dst not in (select id from gone))
select type, count(*) as n from left_ group by type union all select 'node ' || type, count(*) from node where id not in (select id from gone) group by type""",
    "symbols_in_file": f"with {_ENT}, {_SYM}, own0 as (select repo, scope, file_path, name, arg_max(id, seq) as id from reg where id in (select id from ent where file_path = '{GENERATED}') group by all), "
        f"rest0 as (select repo, scope, file_path, name from reg where id in (select id from ent where file_path is distinct from '{GENERATED}') group by all) "
        "select 'own' as part, scope, name, id from own0 union all select 'rest', scope, count(*)::varchar, null from rest0 group by scope",
    "call_chain_incoming": _CALLS.replace("with ", "with recursive ", 1) + ", root as (select dst from edge group by dst order by count(*) desc, dst limit 1), walk as (select dst as id, 0 as depth from root union select e.src, walk.depth + 1 from walk join edge e on e.dst = walk.id where walk.depth < 5) select id, min(depth) as depth from walk group by id",
    "components": _GRAPH + """, und as (select src as a, dst as b from edge union select dst, src from edge),
cc(id, comp) using key (id) as (select id, id from node union (select distinct on (u.id) u.id, v.comp from recurring.cc u join und on und.a = u.id join cc v on v.id = und.b where v.comp < u.comp order by u.id, v.comp))
select comp as component, count(*) as n from cc group by comp""",
    "index_status": f"with {_ENT} select count(*) filter (where entity_type = 'function') as functions, count(*) filter (where entity_type = 'class') as classes, count(*) filter (where entity_type = 'file') as files, (select count(*) from code_vectors) as embeddings from ent",
}
_IGNORED_SQL = "(" + ", ".join(f"'{x}'" for x in IGNORED) + ")"
_BAD = f"len(list_filter(list_filter(string_split(file_path, '/'), lambda x: x <> '' and x <> '.'), lambda x: x in {_IGNORED_SQL} or (starts_with(x, '.') and x not in ('.github', '.gitlab')))) > 0"
ORACLES["ignore_filter"] = f"select seq, {_BAD} as ignored from code_files"
ORACLES["should_process_files"] = f"select seq, coalesce(not ({_BAD}) and lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) in ('py', 'ts', 'js', 'go', 'rs', 'java'), false) as wanted from code_files"
ORACLES["stream_changes"] = (
    f"with e as (select seq, {_PATH} as file_path, case when seq % 3 = 0 then 'delete' else 'upsert' end as change_type from code_files) select file_path as path, arg_max(change_type, seq) as change_type from e "
    f"where coalesce(not ({_BAD}) and lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) in ('py', 'ts', 'js', 'go', 'rs', 'java'), false) group by file_path")
ORACLES["corrected_changes"] = f"select distinct {_PATH} as path, case when {_PATH} in (select {_PATH} from code_files where file_path is not null) then 'upsert' else 'delete' end as change_type from code_functions"
ORACLES["snapshot_versions"] = (
    "select 'files 0' as what, count(*) as n from code_files union all select 'files 1', count(*) from code_files where seq % 2 = 0 union all select 'runs 0', count(*) from sync_runs "
    "union all select 'runs 1', count(*) from sync_runs union all select 'version', 1 union all select 'missing', 1")
ORACLES["vector_index_topk"] = ORACLES["vector_topk"]
ORACLES["find_paths"] = _GRAPH + f""", root as (select src from edge where type = 'calls' group by src order by count(*) desc, src limit 1),
walk as (select src as id, 0 as depth from root union select e.dst, walk.depth + 1 from walk join edge e on e.src = walk.id and e.type = 'calls' where walk.depth < {Q.PATH_LENGTH}),
goal as (select id from (select id, min(depth) as d from walk group by id) order by d desc, id desc limit 1),
back as (select id, 0 as left_ from goal union select e.src, back.left_ + 1 from back join edge e on e.dst = back.id where e.src <> e.dst and back.left_ < {Q.PATH_LENGTH}),
reach as (select id, min(left_) as least from back group by id),
paths as (select [src] as p, src as here from root union all select list_append(paths.p, e.dst), e.dst from paths join edge e on e.src = paths.here join reach r on r.id = e.dst
  where paths.here <> (select id from goal) and not list_contains(paths.p, e.dst) and len(paths.p) + r.least <= {Q.PATH_LENGTH})
select array_to_string(p, ' > ') as path from paths where here = (select id from goal)"""
