"""Schemas and the values of enumerated columns."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _L = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()
_SS = T.ArrayType(_S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


ENTITY_TYPES = ("function", "class", "type", "file")
NODE_TYPES = (*ENTITY_TYPES, "external")
EDGE_TYPES = ("calls", "inherits", "imports", "defines", "contains", "uses")
CALL_TYPES = ("function", "method", "constructor", "static", "decorator")
ACCESS = ("public", "private", "protected", "internal", "package")
TYPE_KINDS = ("interface", "type", "struct", "enum")

CALL = _struct(("name", _S), ("call_type", _S), ("receiver", _S), ("is_nested", _B), ("is_chained", _B), ("line", _I))
TYPE_PARAMETER = _struct(("name", _S), ("constraint", _S), ("default", _S), ("variance", _S))

ENTITY = _struct(
    ("repo", _S), ("file_path", _S), ("entity_type", _S), ("name", _S), ("seq", _L), ("start_line", _I), ("end_line", _I), ("language", _S),
    ("code", _S), ("docstring", _S), ("signature", _S), ("class_name", _S), ("decorators", _SS), ("calls", _SS), ("call_details", T.ArrayType(CALL)),
    ("is_async", _B), ("is_constructor", _B), ("is_static", _B), ("is_abstract", _B), ("is_interface", _B), ("access_modifier", _S),
    ("type_parameters", T.ArrayType(TYPE_PARAMETER)), ("return_type", _S), ("bases", _SS), ("implements", _SS), ("methods", _SS), ("kind", _S),
    ("imports", _SS), ("defines", _SS),
)
NODE = _struct(("id", _S), ("repo", _S), ("type", _S), ("name", _S), ("file_path", _S), ("start_line", _I), ("end_line", _I), ("seq", _L))
EDGE = _struct(("src", _S), ("dst", _S), ("type", _S), ("seq", _L))
VECTOR = _struct(
    ("id", _S), ("embedding", T.ArrayType(T.FloatType())), ("repo", _S), ("entity_type", _S), ("file_path", _S), ("name", _S), ("content_hash", _S),
    ("start_line", _I), ("end_line", _I), ("signature", _S), ("docstring", _S), ("code", _S), ("class_name", _S), ("updated_at", T.TimestampType()))
CHANGE = _struct(("path", _S), ("change_type", _S), ("event_time", T.TimestampType()))
