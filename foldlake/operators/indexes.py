"""Secondary indexes: definitions, plan choice, key projection, pruning, drift.

An index here is a derived layout. It can cut what is read but never change a result: a filtered
index whose filter the query does not imply is never chosen, and the whole predicate is applied
again to what an index yields.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake import predicate as P
from foldlake.errors import EngineError
from foldlake.functions import codecs, columns

MAX_FANOUT = 50


@dataclass(frozen=True)
class Index:
    name: str
    on: tuple[str, ...]
    where: P.Predicate = ()

    def __post_init__(self):
        if not self.on or any("." in f for f in self.on):
            raise EngineError("SchemaError", f"index {self.name!r} needs top-level fields")


@dataclass(frozen=True)
class Plan:
    kind: str  # 'scan' or 'walk'
    reason: str = ""
    index: str | None = None
    keys: tuple = ()  # values of the equality prefix
    tail: tuple | None = None  # ('range', field, low, high) or ('in', field, values)


def _usable(facts: P.Facts) -> str | None:
    """The one way in which a walk can use a field's facts."""
    ways = [w for w, has in (("eq", facts.eqs), ("in", facts.ins), ("range", facts.low or facts.high)) if has]
    return ways[0] if len(ways) == 1 and not (ways == ["in"] and len(facts.ins) > 1) else None


def choose_plan(clauses: P.Predicate, indexes: tuple[Index, ...]) -> Plan:
    """The index walk that consumes most: implied filters before no filter, then the longer prefix, then declaration order."""
    if not clauses:
        return Plan("scan", "no-predicate")
    if not indexes:
        return Plan("scan", "no-indexes-declared")
    facts = P.gather(clauses)
    ways = {f: w for f, x in facts.items() if (w := _usable(x))}
    if not ways:
        return Plan("scan", "predicate-uses-operators-only")
    best = None
    for place, ix in enumerate(indexes):
        if ix.where and not P.implies(clauses, ix.where):
            continue
        prefix = []
        for f in ix.on:
            # An equality with an object matches documents with further keys, which one key cannot name.
            if ways.get(f) != "eq" or isinstance(facts[f].eqs[0], dict):
                break
            prefix.append(facts[f].eqs[0])
        tail, rest = None, ix.on[len(prefix) :]
        if rest and ways.get(rest[0]) == "range":
            tail = ("range", rest[0], facts[rest[0]].low, facts[rest[0]].high)
        elif rest and ways.get(rest[0]) == "in" and not any(isinstance(v, dict) for v in facts[rest[0]].ins[0]):
            tail = ("in", rest[0], tuple(facts[rest[0]].ins[0]))
        used = len(prefix) + (tail is not None)
        score = (bool(ix.where), used, -place)
        if used and (best is None or score > best[0]):
            best = (score, Plan("walk", "", ix.name, tuple(prefix), tail))
    if best is None or (best[1].tail and best[1].tail[0] == "in" and len(best[1].tail[2]) > MAX_FANOUT):
        return Plan("scan", "no-matching-index")
    return best[1]


def project(df: DataFrame, ix: Index, id_col: str = "_id") -> DataFrame:
    """(index, key, doc_id): the entries of an index over typed columns; rows with a missing value have none."""
    parts = []
    for f in ix.on:
        if f not in df.columns:
            return df.sparkSession.createDataFrame([], "index string, key string, doc_id string")
        kind = columns._type_kind(df.schema[f].dataType)
        if kind == "array":
            raise EngineError("SchemaError", f"{f!r} is an array, which cannot be indexed")
        col = F.col(f"`{f}`") if kind != "time" else F.date_format(f"`{f}`", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        parts.append(codecs.index_key_col(col, kind))
    present = reduce(and_, [F.col(f"`{f}`").isNotNull() for f in ix.on], columns.typed(df.schema, ix.where))
    return df.filter(present).select(F.lit(ix.name).alias("index"), F.concat_ws("/", *parts).alias("key"), F.col(id_col).cast("string").alias("doc_id"))


def keys_by_hex(df: DataFrame, field: str, id_col: str, where: P.Predicate = ()) -> DataFrame:
    """(key, doc_id) with built-in order-preserving hexadecimal keys of a string field: the form for large tables."""
    if not isinstance(df.schema[field].dataType, T.StringType):
        raise EngineError("SchemaError", "hexadecimal keys are for strings")
    rows = df.filter(columns.typed(df.schema, where) & F.col(field).isNotNull())
    return rows.select(codecs.string_key_hex_col(F.col(field)).alias("key"), F.col(id_col).alias("doc_id"))


def walk(entries: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id) of the entries that a plan reads, by conditions on the key that reach the scan."""
    head = "/".join(codecs.index_key(v) for v in plan.keys)
    lead = head + "/" if head and plan.tail else head
    rows = entries.filter(F.col("index") == plan.index)
    key = F.col("key")
    if plan.tail is None:
        rows = rows.filter((key == head) | key.startswith(head + "/"))
    elif plan.tail[0] == "in":
        whole = [lead + codecs.index_key(v) for v in plan.tail[2]]
        rows = rows.filter(key.isin(whole) | reduce(lambda a, b: a | b, [key.startswith(w + "/") for w in whole]))
    else:
        _, _, low, high = plan.tail
        sample = (low or high).value
        # All keys of a kind start with its tag: without a bound the walk stays within the kind.
        tag = codecs.TAGS["string" if isinstance(sample, str) else "number"]
        floor = codecs.index_key(low.value) if low else codecs.base32(tag >> 3, 1)
        rows = rows.filter(key >= lead + floor)
        ceiling = codecs.index_key(high.value) + "~" if high else codecs.base32((tag >> 3) + 2, 1)
        rows = rows.filter(key < lead + ceiling)
    return rows.select("doc_id")


def fetch(view: DataFrame, ids: DataFrame, clauses: P.Predicate, id_col: str = "_id") -> DataFrame:
    """The documents of the ids that match the whole predicate."""
    wanted = ids.select(F.col("doc_id").alias("_walk_id")).distinct()
    rows = view.join(wanted, view[id_col].cast("string") == F.col("_walk_id"), "left_semi")
    return rows.filter(columns.typed(view.schema, clauses))


def drift(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("key", "doc_id")) -> DataFrame:
    """(…keys, status): 'added' is missing from the index, 'removed' is stale in it, 'kept' is right."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    status: Column = F.when(F.col("_a").isNull(), "added").when(F.col("_e").isNull(), "removed").otherwise("kept")
    return e.join(a, list(keys), "full_outer").select(*keys, status.alias("status"))


def drift_counts(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("key", "doc_id")) -> DataFrame:
    d = drift(expected, actual, keys)
    one = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return d.agg(one("added"), one("removed"), one("kept"))


def rebuild(actual: DataFrame, expected: DataFrame, dry_run: bool = True, keys: tuple[str, ...] = ("key", "doc_id")) -> tuple[DataFrame, DataFrame]:
    """(report, index after the repair); a dry run leaves the index as it was."""
    return drift_counts(expected, actual, keys), (actual if dry_run else expected).select(*keys)
