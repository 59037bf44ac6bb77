"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clean_path(path: Column) -> Column:
    """``\\`` becomes ``/``; empty and ``.`` segments vanish; letter case stays."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)
    return F.array_join(F.filter(parts, lambda x: (x != "") & (x != ".")), "/")


def tidy(text: Column) -> Column:
    """Trimmed of white space and in lower case, for hashes and statuses."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def latest(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every key in the given order.

    A rank filter: Spark keeps one row a key in each map task before the shuffle, so a key
    that holds a third of all rows costs its reducer one row for each map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


#: The columns of an identity, before the clean path is formed.
FUNCTION_KEY = ["repo", "clean_path", "class_name", "name"]
CLASS_KEY = ["repo", "clean_path", "name"]


def current_rows(df: DataFrame, key: list[str], payload: dict[str, Column]) -> DataFrame:
    """The current row of every identity: ``seq``, the identity and ``payload``.

    The latest ``modified_at`` wins (null is oldest), then the highest ``seq``. Null parts of an
    identity are equal to one another. Only the named columns travel, whatever else ``df`` holds.
    """
    parts = [clean_path(F.col("file_path")).alias("clean_path") if k == "clean_path" else F.col(k) for k in key]
    slim = df.select("seq", *parts, F.col("modified_at").alias("_at"), *[c.alias(n) for n, c in payload.items()])
    return latest(slim, key, [F.col("_at").desc_nulls_last(), F.col("seq").desc()]).drop("_at")


def current_functions(df: DataFrame, **payload: Column) -> DataFrame:
    return current_rows(df, FUNCTION_KEY, payload)


def current_classes(df: DataFrame, **payload: Column) -> DataFrame:
    return current_rows(df, CLASS_KEY, payload)


def entity_id(repo: Column, path: Column, class_name: Column, name: Column) -> Column:
    """``repo:path:[class.]name``."""
    return F.concat(repo, F.lit(":"), path, F.lit(":"), F.when(class_name.isNotNull(), F.concat(class_name, F.lit("."))).otherwise(F.lit("")), name)
