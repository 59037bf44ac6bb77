"""The engine: index a repository, answer questions, apply changes. Results are plain dicts with fixed keys."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .extract.operator import extract_entities
from .operators import entities as E
from .operators import graph_queries as Q
from .operators import sync as Y
from .operators import vectors as V
from .operators.encode import encoder_for
from .operators.graph import Graph, replace_files
from .schema import VECTOR
from .session import materialize
from .sources.scan import read_files, should_process, source_files
from .sources.snapshots import SnapshotStore
from .sources.watcher import FolderWatcher
from .streaming import changes as C

log = logging.getLogger(__name__)
#: Entities are numbered within their file: the path comes first.
ORDER = ("file_path", "seq")
_RESULT = ("id", "name", "file_path", "entity_type", "signature", "docstring", "class_name", "start_line", "end_line", "score")


class Engine:
    """State lives in immutable snapshots (entities, nodes, edges, vectors); readers pin one."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.store = SnapshotStore(spark, settings.storage_path)
        self.encoder = encoder_for(settings.encoder, dimensions=settings.dimensions, **settings.extra.get("encoder", {}))
        self.status = {"phase": "not_started", "error": None, "total_entities": 0, "embeddable_entities": 0}
        self.query = None
        self.watcher: FolderWatcher | None = None

    # -- state ----------------------------------------------------------------------------------
    def _table(self, name: str) -> DataFrame | None:
        return self.store.load(name)

    def vectors(self) -> DataFrame:
        found = self._table("vectors")
        return found if found is not None else self.spark.createDataFrame([], VECTOR)

    def graph(self) -> Graph:
        nodes, edges = self._table("nodes"), self._table("edges")
        if nodes is None:
            raise LookupError("nothing is indexed yet")
        return Graph(nodes, edges)

    def parse(self, root: str | None = None) -> DataFrame:
        files = source_files(self.spark, root or self.settings.repo_path, self.settings.include_dirs)
        return E.identified(extract_entities(files, self.settings.repo_name), self.settings.class_hash)

    # -- indexing -------------------------------------------------------------------------------
    def index(self, reconcile: bool = False, full: bool = False) -> dict:
        """Parse, build the graph, sync the vectors, save one snapshot."""
        try:
            self.status |= {"phase": "parsing", "error": None}
            folder = self.store.write("entities", self.parse())
            rows = self.store.read(folder)
            counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entity_type").isin("function", "class")).alias("e")).first()
            self.status |= {"total_entities": counts.n, "embeddable_entities": counts.e, "phase": "building_graph"}
            graph = Graph.build(rows, order=ORDER)
            self.status["phase"] = "syncing_embeddings"
            files = rows.where("entity_type = 'file'").select("repo", "file_path")
            if full:
                vectors, acts = Y.full_reindex(rows, self.vectors(), self.settings.repo_name, self.encoder)
            else:
                vectors, acts = Y.sync(rows, self.vectors(), self.encoder, files, reconcile)
            done = self._summary(acts)
            self.store.save({"entities": folder, "nodes": graph.nodes, "edges": graph.edges, "vectors": vectors.select(*VECTOR.names)})
            self.status["phase"] = "complete"
            return done
        except Exception as error:
            self.status |= {"phase": "error", "error": str(error)}
            raise

    def reindex(self, path: str | None = None, full: bool = False, force: bool = False) -> dict:
        """Index again; ``full`` encodes everything. A full index of one path would drop all else and needs ``force``."""
        import os

        target = os.path.join(self.settings.repo_path, path) if path else self.settings.repo_path
        if not os.path.exists(target):
            return {"error": f"Path does not exist: {path}", "path": path}
        if path and full and not force:
            return {"error": "a full index of one path drops everything else; use force", "path": path}
        if path and not full:
            fresh = self.parse(target).withColumn("file_path", F.concat(F.lit(path.strip("/") + "/"), "file_path")).drop("id", "content_hash")
            fresh = self._staged(E.identified(fresh, self.settings.class_hash))
            done = self._replace(fresh.select("repo", "file_path").distinct(), fresh)
        else:
            done = self.index(full=full)
        stats = self.graph().statistics().first()
        return {"path": path or self.settings.repo_path, "full_reindex": full, "entities_parsed": self._table("entities").count(),
                "graph": {"nodes": stats.nodes, "edges": stats.edges},
                "embeddings": {k: done[k] for k in ("added", "updated", "deleted", "skipped", "errors")}}

    def _summary(self, acts: DataFrame) -> dict:
        """The counts of a sync; what could not be encoded is an error and counts nowhere."""
        acts = materialize(acts, "acts")
        failed = acts.where("action = 'failed'").count()
        return Y.summary(acts).first().asDict() | {"errors": [f"{failed} entities could not be embedded"] if failed else []}

    def _staged(self, df: DataFrame) -> DataFrame:
        return self.store.read(self.store.write("fresh", df))

    def _replace(self, paths: DataFrame, fresh: DataFrame) -> dict:
        """Replace the rows of some files (``repo, file_path``) in one snapshot; edges are made anew from all entities."""
        old = self._table("entities")
        rows = fresh if old is None else replace_files(old, paths, fresh)
        vectors, gone = self.vectors(), paths.select(F.col("repo").alias("_r"), F.col("file_path").alias("_p")).distinct()
        here = F.col("repo").eqNullSafe(F.col("_r")) & F.col("file_path").eqNullSafe(F.col("_p"))
        synced, acts = Y.sync(fresh, vectors.join(gone, here, "left_semi"), self.encoder, paths)
        done = self._summary(acts)
        rest = vectors.join(gone, here, "left_anti")
        graph = Graph.build(rows, order=ORDER)
        self.store.save({"entities": rows, "nodes": graph.nodes, "edges": graph.edges, "vectors": rest.unionByName(synced, allowMissingColumns=True).select(*VECTOR.names)})
        return done

    def apply_changes(self, batch: DataFrame, number: int = 0) -> dict:
        """Apply ``path, change_type``: files that exist are parsed again, others removed. Only the named files are read."""
        paths = batch.select(F.lit(self.settings.repo_name).alias("repo"), F.col("path").alias("file_path")).where("file_path is not null").distinct()
        wanted = paths.where(should_process(F.col("file_path"))).select("file_path", F.current_timestamp().alias("modified_at"))
        fresh = extract_entities(read_files(wanted, self.settings.repo_path), self.settings.repo_name)
        fresh = self._staged(E.identified(fresh, self.settings.class_hash))
        done = self._replace(paths, fresh)
        there = C.corrected(batch, fresh.where("entity_type = 'file'").select(F.col("file_path").alias("path")))
        log.info("batch %d: %s, %s", number, {r.change_type: r["count"] for r in there.groupBy("change_type").count().collect()}, done)
        return done

    def watch(self, folder: str, checkpoint: str, debounce: bool = False):
        """Start applying changes that arrive as JSON files in ``folder``; see :func:`quern.streaming.changes.start` for ``debounce``."""
        if self.query is not None and self.query.isActive:
            log.warning("already watching")
            return self.query
        pause = f"{self.settings.debounce_seconds} seconds"
        writer = C.start(C.change_stream(self.spark, folder), self.apply_changes, checkpoint, pause, debounce)
        self.query = writer.trigger(processingTime="1 second" if debounce or self.watcher else pause).start()
        return self.query

    def watch_repository(self):
        """Watch the repository's folder itself: a watcher writes its changes, paused globally, and the stream applies them."""
        inbox = f"{self.settings.storage_path}/inbox"
        if self.watcher is None:
            self.watcher = FolderWatcher(self.settings.repo_path, inbox, self.settings.debounce_seconds, include_dirs=self.settings.include_dirs).start()
        return self.watch(inbox, f"{self.settings.storage_path}/checkpoint")

    def stop(self) -> None:
        if self.watcher is not None:
            self.watcher.stop()
            self.watcher = None
        if self.query is not None:
            self.query.stop()
            self.query = None

    def close(self) -> None:
        """Stop watching. Every change is saved when it is applied, so there is nothing else to write."""
        self.stop()

    def __enter__(self) -> "Engine":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # -- questions ------------------------------------------------------------------------------
    def get_function_calls(self, function_id: str) -> dict:
        rows = [r.asDict() for r in Q.function_calls(self.graph(), function_id).collect()]
        return {"function_id": function_id, "calls": rows, "count": len(rows)}

    def get_callers(self, function_id: str) -> dict:
        rows = [r.asDict() for r in Q.callers(self.graph(), function_id).collect()]
        return {"function_id": function_id, "callers": rows, "count": len(rows)}

    def get_call_chain(self, function_id: str, max_depth: int = Q.DEPTH, direction: str = "outgoing") -> dict:
        return Q.call_chain(self.graph(), function_id, max_depth, direction)

    def get_class_hierarchy(self, class_id: str, direction: str = "both") -> dict:
        g = self.graph()
        node = g.entity(class_id).first()
        rows = Q.class_hierarchy(Graph(g.nodes, g.edges.where((F.col("src") == class_id) | (F.col("dst") == class_id)))).where(F.col("of") == class_id).collect()
        out = {"id": class_id, "name": node.name if node else "unknown", "file_path": node.file_path if node else None}
        if direction in ("both", "parents"):
            out["parents"] = [{"id": r.id, "name": r.name, "file_path": r.file_path, "is_external": r.is_external} for r in rows if r.relation == "parent"]
        if direction in ("both", "children"):
            out["children"] = [{"id": r.id, "name": r.name, "file_path": r.file_path} for r in rows if r.relation == "child"]
        return out

    def semantic_search(self, query: str, limit: int = 5, entity_type: str | None = None, file_path_prefix: str | None = None, overfetch: int | None = None) -> dict:
        vector = self.spark.range(1).select(self.encoder.encode(F.lit(query), is_query=True).alias("v")).first().v
        equal = {"repo": self.settings.repo_name} | ({"entity_type": entity_type} if entity_type else {})
        rows = V.search(self.vectors(), list(vector), min(limit, V.LIMIT_CAP), equal=equal, prefix=("file_path", file_path_prefix) if file_path_prefix else None, overfetch=overfetch)
        found = [{k: r[k] for k in _RESULT} for r in rows.collect()]
        return {"query": query, "results": found, "count": len(found)}

    def get_index_status(self) -> dict:
        empty = dict.fromkeys(("total_nodes", "total_edges", "functions", "classes", "files", "types", "external_references"), 0)
        if self._table("nodes") is not None:
            s = self.graph().statistics().first()
            empty = {"total_nodes": s.nodes, "total_edges": s.edges, "functions": s.functions, "classes": s.classes, "files": s.files, "types": s.types, "external_references": s.external}
        phase = self.status["phase"]
        status = "error" if self.status["error"] else "ready" if phase == "complete" or phase == "not_started" and empty["total_nodes"] else "indexing"
        progress = {k: self.status[k] for k in ("phase", "total_entities", "embeddable_entities")} | ({"error": self.status["error"]} if self.status["error"] else {})
        return {"status": status, "repo_name": self.settings.repo_name, "repo_path": self.settings.repo_path, "graph": empty,
                "embeddings": {"total": self.vectors().count()}, "watcher_active": self.query is not None and self.query.isActive, "indexing": progress}
