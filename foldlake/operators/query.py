"""Reading: where, order, limit, and the terminals, over any DataFrame of documents.

``Query`` is immutable. Predicates are normalised, validated and merged when given, before any
job. ``where`` merges with what was there; the last ``order`` and ``limit`` count.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake import predicate as P
from foldlake.errors import EngineError
from foldlake.functions import columns


def _order_columns(spec: dict[str, str], at, tie: Column | None, utf16: bool) -> list[Column]:
    """Missing values come first in ascending order and last in descending; ``tie`` makes the order total."""
    out = []
    for name, way in spec.items():
        if way not in ("asc", "desc"):
            raise EngineError("InvalidConfig", f"order of {name!r} is asc or desc, not {way!r}")
        if "." in name:
            raise EngineError("InvalidConfig", "order takes top-level fields")
        for c in at(name, utf16):
            out.append(c.asc_nulls_first() if way == "asc" else c.desc_nulls_last())
    return out + ([tie.asc()] if tie is not None else [])


# Fixed value: how a table version names a snapshot that is not there.
EMPTY_SNAPSHOT = "none"


@dataclass(frozen=True)
class Query:
    """Over typed columns; ``body`` names a VARIANT column instead, whose rows are (id, body)."""

    df: DataFrame
    id_col: str = "_id"
    body: str | None = None
    clauses: P.Predicate = ()
    order_spec: tuple[tuple[str, str], ...] = ()
    limit_n: int | None = None
    utf16: bool = False

    def where(self, predicate) -> Query:
        return replace(self, clauses=P.merge(self.clauses, P.normalise(predicate)))

    def order(self, spec: dict[str, str]) -> Query:
        _order_columns(spec, lambda n, u: [F.lit(0)], None, False)
        return replace(self, order_spec=tuple(spec.items()))

    def limit(self, n: int) -> Query:
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise EngineError("InvalidConfig", "limit is a whole number from 0")
        return replace(self, limit_n=n)

    def _condition(self) -> Column:
        if self.body:
            return columns.variant(F.col(self.body), self.clauses, self.utf16)
        return columns.typed(self.df.schema, self.clauses, self.utf16)

    def _at(self, name: str, utf16: bool) -> list[Column]:
        if name == self.id_col or name == "_id":
            return [F.col(self.id_col)]
        if self.body:
            v = columns.variant_at(F.col(self.body), name)
            kind = columns.variant_kind(v)
            path = columns.variant_path(name)
            text = F.try_variant_get(F.col(self.body), path, "string")
            # One key for each kind: numbers, then strings; nulls and objects tie with missing.
            rank = F.when(kind == "boolean", 0).when(kind == "number", 1).when(kind == "string", 2)
            number = F.when(kind == "number", F.try_variant_get(F.col(self.body), path, "double")).when(kind == "boolean", F.try_variant_get(F.col(self.body), path, "boolean").cast("double"))
            return [rank, number, F.when(kind == "string", F.encode(text, "UTF-16BE") if utf16 else text)]
        if name not in self.df.columns:
            return [F.lit(None).cast("string")]
        col = F.col(f"`{name}`")
        return [F.encode(col, "UTF-16BE")] if utf16 and self.df.schema[name].dataType.typeName() == "string" else [col]

    def all(self) -> DataFrame:
        out = self.df.filter(self._condition()) if self.clauses else self.df
        if self.order_spec:
            tie = F.col(self.id_col) if self.id_col in self.df.columns else None
            out = out.orderBy(*_order_columns(dict(self.order_spec), self._at, tie, self.utf16))
        return out if self.limit_n is None else out.limit(self.limit_n)

    def first(self) -> DataFrame:
        return replace(self, limit_n=1).all()

    def count(self) -> int:
        """Rows after the limit."""
        return self.count_df().first()[0]

    def count_df(self, ignore_limit: bool = False) -> DataFrame:
        q = replace(self, order_spec=(), limit_n=None if ignore_limit else self.limit_n)
        return q.all().agg(F.count(F.lit(1)).alias("n"))

    def get(self, doc_id: Any) -> DataFrame:
        """The document with that id, whatever the predicate."""
        return self.df.filter(F.col(self.id_col) == F.lit(doc_id))


def manifest_pointer(head: dict, tail: int | None = None) -> str:
    """A table version's name: another one after every commit, fold and restore. ``tail``: a newer end of the log, if known."""
    from foldlake.functions.codecs import pointer

    tail = head["tail"] if tail is None else tail
    return "m1:" + pointer(head["snapshot"] or EMPTY_SNAPSHOT, head["log_seq_start"], head["tail"], head["snapshot_bytes"], head["snapshot_rows"], tail)


def from_request(df: DataFrame, params: dict[str, str], id_col: str = "_id", body: str | None = None) -> Query:
    """A query of the JSON request parameters ``where``, ``order`` and ``limit``."""
    import json

    q = Query(df, id_col, body)
    if params.get("where"):
        q = q.where(P.from_json(params["where"]))
    if params.get("order"):
        q = q.order(json.loads(params["order"]))
    if params.get("limit"):
        if not params["limit"].isdigit():
            raise EngineError("InvalidConfig", "limit is a whole number from 0")
        q = q.limit(int(params["limit"]))
    return q
