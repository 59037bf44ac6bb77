"""Entities: identity, content hash, the text to embed and the metadata of a vector.

Defined cases: null strings are left out of texts and metadata; a null array of decorators, bases or
methods counts as empty; a null repo, path or name makes a null id, which no join matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import ENTITY

#: Characters of a class's code that are embedded, and that are kept as metadata.
CLASS_TEXT, CLASS_METADATA = 2000, 5000


def complete(df: DataFrame) -> DataFrame:
    """``df`` with all columns of an entity; missing ones are null, others are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTITY.fields])


def entity_path() -> Column:
    is_method = (F.col("entity_type") == "function") & F.col("class_name").isNotNull() & (F.col("class_name") != "")
    return F.when(is_method, F.concat_ws(".", "class_name", "name")).otherwise(F.col("name"))


def entity_id() -> Column:
    """``repo:path:entity`` or, of a file, ``repo:path``."""
    file_id = F.concat(F.col("repo"), F.lit(":"), F.col("file_path"))
    return F.when(F.col("entity_type") == "file", file_id).otherwise(F.concat(file_id, F.lit(":"), entity_path()))


def _listed(name: str, ordered: bool = False) -> Column:
    values = F.coalesce(F.col(name), F.array().cast("array<string>"))
    return F.array_join(F.array_sort(values) if ordered else values, ",")


def content_hash(class_hash: str = "header") -> Column:
    """Functions and types by their code, classes by name, bases and decorators (or, with ``code``, by code); files have none."""
    header = F.concat(F.col("name"), F.lit(":"), _listed("bases", True), F.lit(":"), _listed("decorators", True))
    of_class = F.sha2(header if class_hash == "header" else F.col("code"), 256)
    return F.when(F.col("entity_type") == "class", of_class).when(F.col("entity_type").isin("function", "type"), F.sha2(F.col("code"), 256))


def identified(df: DataFrame, class_hash: str = "header") -> DataFrame:
    return df.withColumn("id", entity_id()).withColumn("content_hash", content_hash(class_hash))


def deduplicated(entities: DataFrame) -> DataFrame:
    """One row an id: the attributes of the last, the place (``seq``) of the first. Rows without an id are all kept."""
    # Rows without an id are windows of their own, so that many of them don't meet in one task.
    key = [F.col("id"), F.when(F.col("id").isNull(), F.col("seq"))]
    w = Window.partitionBy(*key).orderBy(F.col("seq").desc())
    first = F.min("seq").over(Window.partitionBy(*key))
    return entities.withColumn("_first", first).withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("seq", F.col("_first")).drop("_first", "_r")


def repo_of_id(entity: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(entity, ":", 1)


def file_of_id(entity: Column) -> Column:
    """What stands between the first and the last colon; of an id with one colon, what follows it."""
    parts = F.size(F.split(entity, ":"))
    return F.when(parts >= 3, F.regexp_extract(entity, r"(?s)^[^:]*:(.*):[^:]*$", 1)).when(parts == 2, F.substring_index(entity, ":", -1)).otherwise(F.lit(""))


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))


def _joined(name: str) -> Column:
    return F.when(F.size(name) > 0, F.array_join(name, ", "))


def embedding_text() -> Column:
    """The text of an entity that its vector stands for."""
    code = F.coalesce(F.col("code"), F.lit(""))
    file = _line("File", F.col("file_path"))
    doc = _line("Description", F.col("docstring"))
    decorators = _line("Decorators", _joined("decorators"))
    method = F.col("class_name").isNotNull() & (F.col("class_name") != "")
    function = F.concat_ws(
        "\n", file, F.when(method, _line("Class", F.col("class_name"))), F.when(method, _line("Method", F.col("name"))).otherwise(_line("Function", F.col("name"))),
        _line("Signature", F.col("signature")), doc, decorators, F.concat(F.lit("Code:\n"), code))
    class_ = F.concat_ws(
        "\n", file, _line("Class", F.col("name")), _line("Inherits", _joined("bases")), doc, decorators, _line("Methods", _joined("methods")),
        F.concat(F.lit("Definition:\n"), F.substring(code, 1, CLASS_TEXT)))
    type_ = F.concat_ws("\n", file, _line("Type", F.col("name")), _line("Kind", F.col("kind")), doc, F.concat(F.lit("Definition:\n"), code))
    kind = F.col("entity_type")
    return F.when(kind == "function", function).when(kind == "class", class_).when(kind == "type", type_).otherwise(F.concat(F.col("name"), F.lit("\n"), code))


def embeddable(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("entity_type").isin("function", "class", "type"))


def metadata(entities: DataFrame, *more: str) -> DataFrame:
    """The columns stored beside a vector, and ``more``."""
    kind = F.col("entity_type")
    return entities.select(
        "id", "repo", "entity_type", "file_path", "name", "content_hash", "start_line", "end_line",
        F.when(kind == "function", F.col("signature")).alias("signature"), "docstring",
        F.when(kind == "class", F.substring("code", 1, CLASS_METADATA)).otherwise(F.col("code")).alias("code"),
        F.when(kind == "function", F.col("class_name")).alias("class_name"), *more)


def flat_metadata(columns: dict[str, Column], arrays: set[str] = frozenset()) -> Column:
    """A map of text values: nulls are left out, arrays joined by commas, everything else as text."""
    pairs = [F.struct(F.lit(k).alias("key"), (F.array_join(c, ",") if k in arrays else c.cast("string")).alias("value")) for k, c in columns.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
