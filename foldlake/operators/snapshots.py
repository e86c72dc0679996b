"""Chunked snapshots: splitting, routing, merging, fold budgets, and when to maintain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlake.errors import EngineError

# Presets of (bytes, rows) of a chunk.
PRESETS = {"small": (128 * 1024, 512), "medium": (512 * 1024, 2048), "large": (1024 * 1024, 4096)}


@dataclass(frozen=True)
class Chunk:
    first_id: str
    last_id: str
    row_count: int
    byte_length: int = 0
    key: str = ""


def greedy_split(rows: Iterable[tuple[str, int]], target_rows: int, target_bytes: int) -> Iterator[list[tuple[str, int]]]:
    """Runs of (id, bytes) in order, each as long as both targets allow; a row over the target is a run of its own."""
    run: list[tuple[str, int]] = []
    size = 0
    for row in rows:
        if run and (len(run) >= target_rows or size + row[1] > target_bytes):
            yield run
            run, size = [], 0
        run.append(row)
        size += row[1]
    if run:
        yield run


def split(view: DataFrame, target_rows: int, target_bytes: int, id_col: str = "_id", size_col: str = "bytes") -> DataFrame:
    """(first_id, last_id, row_count, byte_length) of chunks over id ranges. Greedy within each range partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((str(i), int(b)) for f in batches for i, b in zip(f["id"], f["b"], strict=True))
        for chunk in greedy_split(rows, target_rows, target_bytes):
            yield pd.DataFrame([(chunk[0][0], chunk[-1][0], len(chunk), sum(b for _, b in chunk))], columns=["first_id", "last_id", "row_count", "byte_length"])

    rows = view.select(F.col(id_col).cast("string").alias("id"), F.col(size_col).cast("bigint").alias("b"))
    return rows.repartitionByRange("id").sortWithinPartitions("id").mapInPandas(run, "first_id string, last_id string, row_count long, byte_length long")


def route(mutations: DataFrame, chunks: DataFrame, id_col: str = "doc_id", op_col: str = "op") -> DataFrame:
    """``mutations`` with ``chunk`` (first_id of the chunk that takes it; null for none).

    Between two chunks an insert or update goes to the one before, before all to the first, and
    a delete to none. The chunk at or before an id is found by a union sorted by id with the last
    chunk seen carried along, dealt by ranges of ids: no join of all with all.
    """
    at = F.col("_at")
    marks = chunks.filter(F.col("first_id").isNotNull()).select(F.col("first_id").alias("_at"), F.struct("first_id", "last_id").alias("_mark"))
    rows = mutations.withColumn("_at", F.col(id_col))
    ranges = rows.select("_at").filter(at.isNotNull()).unionByName(marks, allowMissingColumns=True).repartitionByRange("_at")
    ranges = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("_at").alias("low"), F.min("_mark").alias("least"), F.max("_mark").alias("most"))
    parts = sorted(ranges.collect(), key=lambda r: r.p)  # one row a partition
    lowest = next((r.least.first_id for r in parts if r.least is not None), None)
    if lowest is None:
        return mutations.withColumn("chunk", F.lit(None).cast("string"))
    carried, seen = [], None  # the last chunk before each slice
    for k, r in enumerate(parts):
        if seen is not None:
            carried.append((k, seen.first_id, seen))
        seen = r.most or seen
    to = F.when(at.isNull(), 0).otherwise(slice_of(at, [r.low for r in parts[1:]])).alias("_slice")
    before = mutations.sparkSession.createDataFrame(carried, T.StructType([T.StructField("_slice", T.IntegerType()), *marks.schema.fields]))
    dealt = rows.select("*", to, F.lit(True).alias("_row"))
    for more in (marks.select("*", to), before):
        dealt = dealt.unionByName(more.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("_slice").orderBy("_at", "_row", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("_own", F.last("_mark", ignorenulls=True).over(w)).filter("_row")
    inside = F.col("_own").isNotNull() & (at <= F.col("_own.last_id"))
    owner = F.coalesce("_own.first_id", F.lit(lowest))
    return dealt.select(*mutations.columns, F.when(inside | (F.col(op_col) != "D"), owner).alias("chunk"))


def slice_of(at: Column, fences: Sequence) -> Column:
    """How many of the sorted ``fences`` are at or below ``at``, by comparisons that halve them."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(at < F.lit(fences[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(fences))


def facing_merge(chunks: Sequence[Chunk], at: int, target_rows: int, target_bytes: int, least: float = 0.5) -> list[Chunk]:
    """Merge chunk ``at``, if it is under ``least`` of both targets, with the chunk after it, or the one before if it is the last.

    The neighbour is fixed by place: if both together pass a target, nothing is merged.
    """
    c = list(chunks)
    me = c[at]
    if len(c) < 2 or me.row_count >= target_rows * least or me.byte_length >= target_bytes * least:
        return c
    low = at if at + 1 < len(c) else at - 1
    a, b = c[low], c[low + 1]
    if a.row_count + b.row_count > target_rows or a.byte_length + b.byte_length > target_bytes:
        return c
    return c[:low] + [Chunk(a.first_id, b.last_id, a.row_count + b.row_count, a.byte_length + b.byte_length)] + c[low + 2 :]


@dataclass(frozen=True)
class Budgets:
    entries: int = 1 << 60
    log_bytes: int = 1 << 60
    ids: int = 1 << 60
    chunks: int = 1 << 60
    read_bytes: int = 1 << 60
    write_bytes: int = 1 << 60


def plan_fold(log: DataFrame, budgets: Budgets) -> DataFrame:
    """(seq, fits): which log rows the longest prefix takes within all budgets.

    ``log``: (seq, doc_id, bytes, chunk, chunk_bytes). An id counts once and a chunk's bytes count
    once for reading and writing. First meetings are the least seq of each id and chunk; with the
    rows, their sums run along seq in slices, which are joined to the slices' running totals.
    """
    zero = {x: F.lit(None if x == "b" else 0).cast("bigint").alias(x) for x in "nbick"}
    ids = log.groupBy("doc_id").agg(F.min("seq").alias("seq"))
    chunks = log.filter(F.col("chunk").isNotNull()).groupBy("chunk").agg(F.min(F.struct("seq", "chunk_bytes")).alias("m"))
    one = F.lit(1).cast("bigint")
    parts = [
        log.select("seq", F.lit(True).alias("row"), *{**zero, "n": one.alias("n"), "b": F.col("bytes").cast("bigint").alias("b")}.values()),
        ids.select("seq", F.lit(False).alias("row"), *{**zero, "i": one.alias("i")}.values()),
        chunks.select("m.seq", F.lit(False).alias("row"), *{**zero, "c": one.alias("c"), "k": F.col("m.chunk_bytes").cast("bigint").alias("k")}.values()),
    ]
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2]).withColumn("slice", F.floor(F.col("seq") / 10000))
    own = Window.partitionBy("slice").orderBy("seq", "row").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("slice").agg(*[F.sum(x).alias(f"t_{x}") for x in zero])
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    totals = totals.select("slice", *[F.sum(f"t_{x}").over(before).alias(f"o_{x}") for x in zero])
    run = rows.select("seq", "slice", "row", *[F.sum(x).over(own).alias(f"r_{x}") for x in zero]).filter("row").join(totals, "slice")
    at = {x: F.coalesce(F.col(f"r_{x}") + F.col(f"o_{x}"), f"r_{x}", f"o_{x}") for x in zero}
    fits = (at["n"] <= budgets.entries) & (at["b"] <= budgets.log_bytes) & (at["i"] <= budgets.ids) & (at["c"] <= budgets.chunks) & (at["k"] <= budgets.read_bytes) & (at["k"] + at["b"] <= budgets.write_bytes)
    return run.select("seq", fits.alias("fits"))  # all sums rise, so what fits is a prefix


@dataclass(frozen=True)
class Profile:
    """Ceilings of one maintenance pass: snapshot bytes and rows."""

    snapshot_bytes: int
    snapshot_rows: int
    gc_every: int = 256


# Ceilings of the host profiles. A cluster has none, since no host holds a whole snapshot.
PROFILES = {
    "free": Profile(512 * 1024, 2048),
    "paid": Profile(8 * 1024 * 1024, 32768),
    "node": Profile(32 * 1024 * 1024, 65536),
    "cluster": Profile(1 << 60, 1 << 60),
}
MIN_SNAPSHOT_BYTES = 64 * 1024


def crosses(before: int, tail: int, every: int) -> bool:
    """Whether a multiple of ``every`` lies in (before, tail]."""
    return before // every != tail // every


def maintenance_due(head: dict, tail: int, entry_bytes: int, profile: Profile, ratio: float = 1.0, before: int | None = None) -> tuple[bool, bool]:
    """(fold due, gc due): the log weighs as much as the snapshot; the tail, which was ``before`` (one less if not given), crossed a multiple of the gc step."""
    pending = tail - head["log_seq_start"]
    fold = pending * entry_bytes / max(head.get("snapshot_bytes") or 0, MIN_SNAPSHOT_BYTES) >= ratio
    return fold, crosses(tail - 1 if before is None else before, tail, profile.gc_every)


def pass_steps(head: dict, tail: int, entry_bytes: int, profile: Profile, before: int | None = None) -> list[str]:
    """What a bounded pass does, in order."""
    fold, gc = maintenance_due(head, tail, entry_bytes, profile, before=before)
    too_large = (head.get("snapshot_bytes") or 0) > profile.snapshot_bytes or (head.get("snapshot_rows") or 0) > profile.snapshot_rows
    return [s for s, on in (("defer-fold", fold and too_large), ("fold", fold and not too_large), ("gc", gc), ("retention", fold or gc)) if on]


def compact_decision(head: dict | None, tail: int, least: int = 100, most: int = 10000) -> tuple[str, int]:
    """(reason, end of the fold): 'ok', or why a compaction is skipped."""
    if head is None:
        return "missing", 0
    pending = tail - head["log_seq_start"]
    if pending < least:
        return "below-min", head["log_seq_start"]
    return "ok", head["log_seq_start"] + min(pending, most)


def assert_head_step(old: dict, new: dict) -> None:
    """The start of the log and the delete floor only rise, and the floor stays at or below the start."""
    for k in ("log_seq_start", "log_delete_floor"):
        if (new.get(k) or 0) < (old.get(k) or 0):
            raise EngineError("Internal", f"{k} went back")
    if (new.get("log_delete_floor") or 0) > new["log_seq_start"]:
        raise EngineError("Internal", "delete floor above the log's start")


def snapshot_key(min_seq: int, max_seq: int, digest: str) -> str:
    return f"snapshot/L9/{min_seq:012d}-{max_seq:012d}-{digest}.parquet"
