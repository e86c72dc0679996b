"""Predicates as Spark columns: over typed columns, or over a VARIANT body.

Typed mode leaves plain comparisons that Catalyst pushes into the Parquet scan. VARIANT mode
guards every leaf by the kind of the stored value, because extraction would convert.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.errors import EngineError
from foldlake.predicate import Clause, Predicate, kind_of

COMPARE = {"eq": "__eq__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _type_kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    return "object" if isinstance(t, T.StructType) else "array"


def _field(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    at: T.DataType = schema
    col = None
    for part in path.split("."):
        if not isinstance(at, T.StructType) or part not in at.names:
            return None
        at = at[part].dataType
        col = F.col(f"`{part}`") if col is None else col.getField(part)
    return col, at


def _typed_leaf(schema: T.StructType, c: Clause, strict: bool) -> Column:
    found = _field(schema, c.field)
    if found is None:
        return F.lit(False)
    col, t = found
    kind = _type_kind(t)
    if c.op == "in":
        same = [m for m in c.value if kind_of(m) == kind and kind != "object"]
        parts = [col.isin(same)] if same else []
        parts += [_typed_leaf(schema, Clause("eq", c.field, m), strict) for m in c.value if isinstance(m, dict)]
        return reduce(or_, parts) if parts else F.lit(False)
    if isinstance(c.value, dict):
        if kind != "object":
            return F.lit(False)
        return reduce(and_, [_typed_leaf(schema, Clause("eq", f"{c.field}.{k}", v), strict) for k, v in c.value.items()], col.isNotNull())
    if kind == "time" and isinstance(c.value, str):
        return getattr(col, COMPARE[c.op])(F.lit(c.value).cast(t))
    if kind != kind_of(c.value):
        return F.lit(False)
    value = F.lit(c.value)
    if strict and kind == "string" and c.op != "eq":
        return getattr(F.encode(col, "UTF-16BE"), COMPARE[c.op])(F.encode(value, "UTF-16BE"))
    return getattr(col, COMPARE[c.op])(value)


def typed(schema: T.StructType, clauses: Predicate, utf16_order: bool = False) -> Column:
    """All clauses over typed columns. A field that is missing or of another kind never matches.

    Strings compare by code points, as Spark and Parquet do, which lets bounds be pushed down;
    ``utf16_order`` compares by UTF-16 code units instead (they differ for characters beyond U+FFFF).
    """
    return reduce(and_, [_typed_leaf(schema, c, utf16_order) for c in clauses], F.lit(True)) if clauses else F.lit(True)


def variant_path(path: str) -> str:
    """JSON path with every part quoted, so that a part is never read as syntax."""
    if any(ch in path for ch in "\"'\\"):
        raise EngineError("InvalidConfig", f"path {path!r} has a quote or backslash")
    return "$" + "".join(f'["{part}"]' for part in path.split("."))


def variant_at(body: Column, path: str) -> Column:
    return F.try_variant_get(body, variant_path(path), "variant")


def variant_kind(v: Column) -> Column:
    """string, number, boolean, object, array or null of a VARIANT; SQL NULL if missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s == "VOID", "null")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("number")
    )


SPARK_TYPE = {"string": "string", "number": "double", "boolean": "boolean"}


def _variant_leaf(body: Column, c: Clause, strict: bool) -> Column:
    at = variant_at(body, c.field)
    kind = variant_kind(at)
    if c.op == "in":
        return reduce(or_, [_variant_leaf(body, Clause("eq", c.field, m), strict) for m in c.value])
    if isinstance(c.value, dict):
        return reduce(and_, [_variant_leaf(body, Clause("eq", f"{c.field}.{k}", v), strict) for k, v in c.value.items()], F.coalesce(kind == "object", F.lit(False)))
    k = kind_of(c.value)
    value = F.try_variant_get(body, variant_path(c.field), SPARK_TYPE[k])
    wanted = F.lit(float(c.value) if k == "number" else c.value)
    if strict and k == "string" and c.op != "eq":
        value, wanted = F.encode(value, "UTF-16BE"), F.encode(wanted, "UTF-16BE")
    return F.coalesce((kind == k) & getattr(value, COMPARE[c.op])(wanted), F.lit(False))


def variant(body: Column, clauses: Predicate, utf16_order: bool = False) -> Column:
    """All clauses over a VARIANT body. Numbers compare as doubles."""
    return reduce(and_, [_variant_leaf(body, c, utf16_order) for c in clauses], F.lit(True)) if clauses else F.lit(True)


def parse_body(text: Column) -> Column:
    return F.parse_json(text)
