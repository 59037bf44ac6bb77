"""Keeping the vector table in step with the entities: what is new, changed, unchanged or gone.

Defined cases: entities given twice count once, the last one; a stored row without a hash counts as changed; a
stored id is only deleted if its file, in the same repository, is among the parsed ones, or, with ``reconcile``, if it is missing at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import entities as E
from . import vectors as V
from .encode import Encoder


def actions(given: DataFrame, stored: DataFrame, parsed_files: DataFrame | None = None, reconcile: bool = False) -> DataFrame:
    """``id, action`` with ``added``, ``updated``, ``skipped`` or ``deleted``.

    ``given`` and ``stored`` have ``id, content_hash`` with one row an id; ``parsed_files`` has ``repo, file_path``, by default the files of ``given``'s ids.
    """
    g, s = given.select("id", F.col("content_hash").alias("new")), stored.select("id", F.coalesce("content_hash", F.lit("")).alias("old"))
    both = g.withColumn("_g", F.lit(True)).join(s.withColumn("_s", F.lit(True)), "id", "full")
    of = [E.repo_of_id(F.col("id")).alias("repo"), E.file_of_id(F.col("id")).alias("file_path")]
    both = both.select("*", *of)
    files = (parsed_files if parsed_files is not None else given.select(*of)).select("repo", "file_path").distinct().withColumn("_parsed", F.lit(True))
    both = both.join(files, ["repo", "file_path"], "left")
    gone = F.lit(True) if reconcile else F.col("_parsed")
    action = (
        F.when(F.col("_s").isNull(), "added").when(F.col("_g").isNotNull() & (F.col("new") == F.col("old")), "skipped")
        .when(F.col("_g").isNotNull(), "updated").when(gone, "deleted"))
    return both.select("id", action.alias("action")).where("action is not null")


def summary(acts: DataFrame) -> DataFrame:
    """One row: added, updated, deleted, skipped and their sum; failed ones don't count."""
    names = ("added", "updated", "deleted", "skipped")
    return acts.agg(*[F.count_if(F.col("action") == n).alias(n) for n in names], F.count_if(F.col("action").isin(*names)).alias("total_processed"))


def vector_rows(entities: DataFrame, encoder: Encoder) -> DataFrame:
    """The rows to store for entities with ids and hashes: text, vector, metadata and the time."""
    return E.metadata(entities.withColumn("_embedding", encoder.encode(E.embedding_text())), "_embedding").withColumnRenamed("_embedding", "embedding").withColumn("updated_at", F.current_timestamp())


def sync(entities: DataFrame, stored: DataFrame, encoder: Encoder, parsed_files: DataFrame | None = None, reconcile: bool = False) -> tuple[DataFrame, DataFrame]:
    """The vector table after the sync, and the actions taken; only new and changed entities are encoded.

    An entity whose encoding failed keeps its stored row, and its action is ``failed`` instead of added or updated.
    """
    rows = E.deduplicated(E.embeddable(entities))
    acts = materialize(actions(rows, stored, parsed_files, reconcile), "actions")
    todo = rows.join(acts.where(F.col("action").isin("added", "updated")), "id", "left_semi")
    # Written once, as encoding is dear and both results need it.
    encoded = materialize(vector_rows(todo, encoder), "encoded")
    failed = encoded.where("embedding is null").select("id", F.lit(True).alias("_failed"))
    out = V.upserted(V.without_ids(stored, acts.where("action = 'deleted'")), encoded.where("embedding is not null"))
    done = acts.join(failed, "id", "left").select("id", F.when(F.col("_failed"), "failed").otherwise(F.col("action")).alias("action"))
    return out, done


def sync_file(entities: DataFrame, stored: DataFrame, repo: str, path: str, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """As :func:`sync`, for one file of a repository."""
    here = (F.col("repo") == repo) & (F.col("file_path") == path)
    own, rest = stored.where(here), stored.where(~F.coalesce(here, F.lit(False)))
    files = stored.sparkSession.createDataFrame([(repo, path)], "repo string, file_path string")
    out, acts = sync(entities.where(here), own, encoder, files)
    return rest.unionByName(out, allowMissingColumns=True), acts


def full_reindex(entities: DataFrame, stored: DataFrame, repo: str, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """All rows of a repository anew: the old ones are deleted, the entities added."""
    deleted = stored.where(F.col("repo") == repo).select("id", F.lit("deleted").alias("action"))
    out, acts = sync(entities, V.without_repo(stored, repo), encoder)
    return out, deleted.unionByName(acts)
