"""Relational export: column inference, DDL, INSERT text, and predicates as SQL."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake import predicate as P
from foldlake.errors import EngineError
from foldlake.functions.columns import variant_kind, variant_path

TARGETS = ("postgres", "sqlite", "d1")
INT32 = 2**31


@dataclass(frozen=True)
class ColumnPlan:
    name: str
    sql_type: str
    nullable: bool
    encoded: bool  # JSON text


@dataclass(frozen=True)
class ExportPlan:
    target: str
    table: str
    columns: tuple[ColumnPlan, ...]
    row_count: int


def field_kinds(view: DataFrame, body: str = "body") -> DataFrame:
    """(field, n, has_string, has_boolean, has_int32, has_number, has_nested, has_null): kinds seen of each top-level field, in one aggregation."""
    kv = view.select(F.col("_id"), F.col(body)).lateralJoin(view.sparkSession.tvf.variant_explode(F.col(body).outer())) if hasattr(view, "lateralJoin") else None
    kv = kv.select(F.col("key").alias("field"), F.col("value"))
    kind = variant_kind(F.col("value"))
    number = F.try_variant_get("value", "$", "double")
    int32 = (kind == "number") & (number == F.floor(number)) & number.between(-INT32, INT32 - 1)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return kv.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), flag(kind == "string").alias("has_string"), flag(kind == "boolean").alias("has_boolean"),
        flag(int32).alias("has_int32"), flag((kind == "number") & ~int32).alias("has_number"),
        flag(kind.isin("object", "array")).alias("has_nested"), flag(kind == "null").alias("has_null"),
    )


def lattice(postgres: bool) -> Column:
    """SQL type of a field from its kinds: nested, then mixed, then the one kind."""
    text = "text" if postgres else "TEXT"
    number = F.col("has_int32") | F.col("has_number")
    kinds = F.col("has_string").cast("int") + F.col("has_boolean").cast("int") + number.cast("int")
    return (
        F.when(F.col("has_nested"), "jsonb" if postgres else "TEXT")
        .when((kinds != 1) | F.col("has_string"), text)
        .when(F.col("has_boolean"), "boolean" if postgres else "INTEGER")
        .when(F.col("has_number"), "double precision" if postgres else "REAL")
        .otherwise("integer" if postgres else "INTEGER")
    )


def infer(view: DataFrame, target: str = "postgres", table: str = "documents", body: str = "body") -> ExportPlan:
    """Columns of a collection. ``_id`` comes first, then fields by name: a VARIANT does not keep the order of keys."""
    if target not in TARGETS:
        raise EngineError("InvalidConfig", f"unknown target {target!r}")
    pg = target == "postgres"
    rows = view.count()
    found = field_kinds(view, body).filter("field <> '_id'").withColumn("t", lattice(pg)).orderBy("field").collect()  # one row a field
    cols = [ColumnPlan("_id", "text" if pg else "TEXT", False, False)]
    cols += [ColumnPlan(r.field, r.t, r.n < rows or r.has_null, r.has_nested) for r in found]
    return ExportPlan(target, table, tuple(cols), rows)


def quote_name(name: str) -> str:
    if "\0" in name:
        raise EngineError("InvalidConfig", "a name cannot have a NUL")
    return '"' + name.replace('"', '""') + '"'


def literal(v: Any, target: str) -> str:
    kind = P.kind_of(v)
    if kind == "null":
        return "NULL"
    if kind == "boolean":
        return str(v).upper() if target == "postgres" else str(int(v))
    if kind == "number":
        if not math.isfinite(v):
            raise EngineError("InvalidConfig", "only finite numbers")
        return repr(int(v)) if v == int(v) and abs(v) < 2**53 else repr(float(v))
    text = v if kind == "string" else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    if "\0" in text:
        raise EngineError("InvalidConfig", "text cannot have a NUL")
    return "'" + text.replace("'", "''") + "'"


def create_table(plan: ExportPlan) -> str:
    lines = []
    for c in plan.columns:
        tail = " PRIMARY KEY" if c.name == "_id" else "" if c.nullable else " NOT NULL"
        lines.append(f"  {quote_name(c.name)} {c.sql_type}{tail}")
    return f"CREATE TABLE {quote_name(plan.table)} (\n" + ",\n".join(lines) + "\n);"


def _value_text(plan: ExportPlan, c: ColumnPlan, body: str) -> Column:
    if c.name == "_id":
        return F.concat(F.lit("'"), F.replace(F.col("_id"), F.lit("'"), F.lit("''")), F.lit("'"))
    v = F.try_variant_get(F.col(body), variant_path(c.name), "variant")
    kind = variant_kind(v)
    quoted = lambda s: F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))
    if c.encoded:
        out = quoted(F.to_json(v))
        return F.coalesce(F.when(kind != "null", F.concat(out, F.lit("::jsonb")) if plan.target == "postgres" else out), F.lit("NULL"))
    raw = F.try_variant_get(F.col(body), variant_path(c.name), "string")
    if c.sql_type.lower() == "text":
        return F.coalesce(F.when(kind != "null", quoted(raw)), F.lit("NULL"))
    if c.sql_type == "boolean":
        return F.coalesce(F.upper(raw), F.lit("NULL"))
    number = F.try_variant_get(F.col(body), variant_path(c.name), "double")
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    flag = F.when(kind == "boolean", F.try_variant_get(F.col(body), variant_path(c.name), "boolean").cast("int").cast("string"))
    return F.coalesce(flag, whole, F.lit("NULL"))


def insert_statements(view: DataFrame, plan: ExportPlan, body: str = "body") -> DataFrame:
    """(_id, statement): one INSERT a row, as an expression."""
    names = ", ".join(quote_name(c.name) for c in plan.columns)
    values = F.concat_ws(", ", *[_value_text(plan, c, body) for c in plan.columns])
    return view.select("_id", F.concat(F.lit(f"INSERT INTO {quote_name(plan.table)} ({names}) VALUES ("), values, F.lit(");")).alias("statement"))


SQL_OPS = {"eq": "=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _flat_ok(c: ColumnPlan, v: Any) -> bool:
    kind = {"text": "string", "boolean": "boolean"}.get(c.sql_type.lower(), "number")
    return P.kind_of(v) == kind or (c.sql_type == "INTEGER" and isinstance(v, bool))


def where_sql(clauses: P.Predicate, plan: ExportPlan) -> tuple[str, list[str]]:
    """(condition, hints): columns compare directly, JSON columns by path; what no row can match is ``1 = 0``."""
    by_name = {c.name: c for c in plan.columns}
    parts, hints = [], []
    for c in clauses:
        head, _, rest = c.field.partition(".")
        col = by_name.get(head)
        if col is None or (rest and not col.encoded):
            parts.append("1 = 0")
            hints.append(f"no column holds {c.field!r}")
            continue
        values = c.value if c.op == "in" else [c.value]
        if col.encoded:
            parts.append("(" + " OR ".join(_json_leaf(plan.target, head, rest, c.op, v) for v in values) + ")")
            continue
        good = [literal(v, plan.target) for v in values if _flat_ok(col, v)]
        name = quote_name(head)
        if not good:
            parts.append("1 = 0")
            hints.append(f"{c.field!r} holds {col.sql_type}, not {P.kind_of(values[0])}")
        elif c.op == "in":
            parts.append(f"{name} IN ({', '.join(good)})")
        else:
            parts.append(f"{name} {SQL_OPS[c.op]} {good[0]}")
    return " AND ".join(parts) or "1 = 1", hints


def _json_leaf(target: str, head: str, rest: str, op: str, v: Any) -> str:
    op = SQL_OPS["eq" if op == "in" else op]
    name, keys = quote_name(head), rest.split(".") if rest else []
    if isinstance(v, dict):
        return "(" + (" AND ".join(_json_leaf(target, head, ".".join([*keys, k]), "eq", x) for k, x in v.items()) or f"{name} IS NOT NULL") + ")"
    kind = P.kind_of(v)
    if target == "postgres":
        steps = "".join(f"->{literal(k, target)}" for k in keys)
        typ = f"jsonb_typeof({name}{steps}) = '{kind}'"
        text = f"({name}{steps} #>> '{{}}')"
        cast = {"number": f"{text}::double precision", "boolean": f"{text}::boolean"}.get(kind, text)
        return f"CASE WHEN {typ} THEN {cast} {op} {literal(v, target)} ELSE FALSE END"
    path = literal("$" + "".join(f'."{k}"' for k in keys), target)
    types = {"number": "'integer', 'real'", "boolean": "'true', 'false'", "string": "'text'"}[kind]
    return f"(json_type({name}, {path}) IN ({types}) AND json_extract({name}, {path}) {op} {literal(v, target)})"


def plan_to_json(plan: ExportPlan) -> str:
    return json.dumps({"version": 1, **asdict(plan)}, indent=1)


def plan_from_json(text: str) -> ExportPlan:
    """Strict: no missing and no unknown member."""
    try:
        raw = json.loads(text)
        if set(raw) != {"version", "target", "table", "columns", "row_count"} or raw["version"] != 1 or raw["target"] not in TARGETS:
            raise ValueError("unknown members or version")
        return ExportPlan(raw["target"], raw["table"], tuple(ColumnPlan(**c) for c in raw["columns"]), raw["row_count"])
    except (ValueError, TypeError, KeyError) as e:
        raise EngineError("InvalidResponse", f"not an export plan: {e}") from None
