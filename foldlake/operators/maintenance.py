"""Set-based maintenance: orphan marking, sweeps, retention, usage, cost, metrics, accounting, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.operators import stats

# Fixed values.
GRACE_DAYS = 7
MAX_MARKS = 1000
MAX_SWEEPS = 1000
LEDGER_CAP = 1000
RETAIN = 1024
RETIRE_STEP = 20
USAGE_WINDOW = 120
WRITES_PER_MINUTE = 30
MINUTES_A_MONTH = 43_200
SNAPSHOT_NAME = r"(?:^|/)snapshot/L9/(\d{12})-(\d{12})-([0-9a-f]{64})\.(?:json|parquet)$"


def discover_collections(keys: DataFrame, key: str = "key") -> DataFrame:
    """(collection): the names that follow ``/manifests/`` in object keys."""
    rest = F.substring_index(F.col(key), "/manifests/", -1)
    rows = keys.filter(F.col(key).contains("/manifests/")).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("collection"))
    return rows.filter("collection <> ''").distinct()


def _first(rows: DataFrame, most: int | None, *order: str) -> DataFrame:
    return rows if most is None else rows.orderBy(*order).limit(most)


def mark_orphans(files: DataFrame, current: str | None, ledger: DataFrame, now: Column, generation: str, most: int | None = MAX_MARKS) -> DataFrame:
    """(key, due_at, reason, generation): snapshot files that are not current, well named and not in the ledger, by name; all with None for ``most``."""
    rows = files.select("key").filter(F.col("key").rlike(SNAPSHOT_NAME))
    if current is not None:
        rows = rows.filter(F.col("key") != current)
    rows = _first(rows.join(ledger.select("key"), "key", "left_anti"), most, "key")
    return rows.select("key", (now + F.expr(f"INTERVAL {GRACE_DAYS} DAYS")).alias("due_at"), F.lit("orphan-snapshot").alias("reason"), F.lit(generation).alias("generation"))


def classify_candidates(ledger: DataFrame, generation: str, current: str | None, log_seq_start: int, now: Column) -> DataFrame:
    """``ledger`` with ``verdict``, the first that holds: evict (old form or bad name), drop (another generation), rescue (current again), wait, blocked, sweep."""
    name = F.col("key")
    max_seq = F.regexp_extract(name, SNAPSHOT_NAME, 2).try_cast("bigint") if hasattr(Column, "try_cast") else F.expr(f"try_cast(regexp_extract(key, '{SNAPSHOT_NAME}', 2) AS BIGINT)")
    verdict = (
        F.when(F.col("generation").isNull() | ~name.rlike(SNAPSHOT_NAME), "evict")
        .when(F.col("generation") != generation, "drop")
        .when(name == F.lit(current), "rescue")
        .when(F.col("due_at") > now, "wait")
        .when(max_seq >= log_seq_start, "blocked")
        .otherwise("sweep")
    )
    return ledger.withColumn("verdict", verdict)


def sweep(classified: DataFrame, most: int | None = MAX_SWEEPS) -> tuple[DataFrame, DataFrame]:
    """(keys to delete, the ledger after it): the first ``most`` by due time go; what waits, is blocked or came too late stays."""
    due = _first(classified.filter("verdict = 'sweep'"), most, "due_at", "key").select("key")
    stays = classified.filter(F.col("verdict").isin("wait", "blocked", "sweep")).join(due, "key", "left_anti").drop("verdict")
    return due, stays


def merge_ledger(old: DataFrame, marks: DataFrame, cap: int | None = LEDGER_CAP) -> DataFrame:
    """Both, the old row where a key is in both; the first ``cap`` by due time and name."""
    fresh = marks.join(old.select("key"), "key", "left_anti")
    return _first(old.unionByName(fresh.select(*old.columns)), cap, "due_at", "key")


def retention_range(delete_floor: int, log_seq_start: int, retain: int = RETAIN, step: int = RETIRE_STEP) -> tuple[int, int]:
    """Log rows [from, to) that may be deleted now."""
    return delete_floor, max(delete_floor, min(log_seq_start - retain, delete_floor + step))


def retention_ranges(heads: DataFrame) -> DataFrame:
    """The same for many collections: adds ``retire_from`` and ``retire_to``."""
    floor = F.coalesce("log_delete_floor", F.lit(0))
    to = F.greatest(floor, F.least(F.col("log_seq_start") - RETAIN, floor + RETIRE_STEP))
    return heads.withColumn("retire_from", floor).withColumn("retire_to", to)


def usage(log: DataFrame, newest: int = USAGE_WINDOW, limit: float = WRITES_PER_MINUTE) -> DataFrame:
    """(collection, entries, writes_per_minute, severity) over each collection's newest log rows.

    Fewer than two rows with a time give no rate: null, and ``info``.

    ``log``: (collection, seq, commit_ts). The window ranks on both sides of the exchange, so a
    hot collection sends ``newest`` rows a task.
    """
    w = Window.partitionBy("collection").orderBy(F.desc("seq"))
    rows = log.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= newest)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    minutes = (micros(F.max("commit_ts")) - micros(F.min("commit_ts"))) / F.lit(60e6)
    rate = F.when(F.count("commit_ts") > 1, (F.count("commit_ts") - 1) / F.greatest(F.lit(1 / 60), minutes))
    out = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("entries"), rate.alias("writes_per_minute"))
    r = F.col("writes_per_minute")
    return out.withColumn("severity", F.when(r.isNull(), "info").when(r >= limit, "error").when(r >= limit / 2, "warn").otherwise("ok"))


def cost_projection(rates: DataFrame, amplification: float, free_ops: int = 1_000_000, price_per_million: float = 4.5, monthly_cap: int = 50_000_000, rate_cap: float = 100.0) -> DataFrame:
    """Adds monthly operations, those beyond the free tier, their cost, and shares of the caps, to ``writes_per_minute``."""
    ops = F.col("writes_per_minute") * MINUTES_A_MONTH * amplification
    over = F.greatest(F.lit(0.0), ops - free_ops)
    return rates.select(
        "*", ops.alias("monthly_ops"), over.alias("billable_ops"), (over / 1e6 * price_per_million).alias("monthly_cost"),
        (ops / monthly_cap * 100).alias("pct_of_monthly_cap"), (F.col("writes_per_minute") / rate_cap * 100).alias("pct_of_rate_cap"),
    )


def metrics_summary(observations: DataFrame) -> DataFrame:
    """(name, kind, value, n): counters (``*_total``) are summed, gauges give the last, histograms count and sum.

    ``observations``: (pos, kind, name, value).
    """
    value = F.when(F.col("kind") == "gauge", F.max_by("value", "pos")).otherwise(F.sum("value"))
    return observations.groupBy("name", "kind").agg(value.alias("value"), F.count(F.lit(1)).alias("n"))


def op_rollup(ops: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, n, p50, p95, p99, share) for each kind, by nearest rank. Share is of all operations."""
    ops = ops.select(F.col(kind).alias("kind"), F.col(value).alias("value"))
    by = ops.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    by = stats.beside(by, stats.quantiles(ops, "value", {"p50": ("rank", 0.5), "p95": ("rank", 0.95), "p99": ("rank", 0.99)}, ["kind"]), ["kind"])
    total = by.agg(F.sum("n").alias("_t"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")  # one row


def account(ops: DataFrame) -> DataFrame:
    """(method, prefix, n, bytes): object-store operations by method and the first two parts of the key."""
    return ops.groupBy("method", F.substring_index("key", "/", 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def file_sums(files: DataFrame) -> DataFrame:
    """(path, sum): the SHA-256 of each file of a ``binaryFile`` frame."""
    return files.select("path", F.sha2("content", 256).alias("sum"))


def verify_snapshots(files: DataFrame) -> DataFrame:
    """(path, ok): whether the SHA-256 in each snapshot's name is that of its content. ``files``: a ``binaryFile`` frame.

    A snapshot is one file, or a folder of files: then the name has the SHA-256 of their sorted sums.
    """
    single = F.col("path").rlike(SNAPSHOT_NAME)
    sums = file_sums(files).withColumn("one", single)
    sums = sums.withColumn("path", F.when(F.col("one"), F.col("path")).otherwise(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    made = sums.groupBy("path", "one").agg(F.array_sort(F.collect_list("sum")).alias("sums"))  # a row a snapshot, 64 characters a file
    content = F.when(F.col("one"), F.get("sums", F.lit(0))).otherwise(F.sha2(F.array_join("sums", "").cast("binary"), 256))
    return made.select("path", (content == F.regexp_extract("path", SNAPSHOT_NAME, 3)).alias("ok"))


def inspect(head: dict, log: DataFrame, view: DataFrame, files: DataFrame, index_entries: DataFrame | None = None) -> DataFrame:
    """One row: head, tail, rows, orphans and index entries."""
    from foldlake.operators.fold import tail

    end = tail(log, head["log_seq_start"])
    rows = view.agg(F.count(F.lit(1)).alias("rows"))
    orphans = files.filter(F.col("key").rlike(SNAPSHOT_NAME) & (F.col("key") != F.lit(head.get("snapshot") or ""))).agg(F.count(F.lit(1)).alias("orphan_snapshots"))
    out = rows.crossJoin(orphans)  # one row each
    if index_entries is not None:
        per = index_entries.groupBy("index").count().agg(F.map_from_entries(F.collect_list(F.struct("index", "count"))).alias("index_keys"))
        out = out.crossJoin(per)
    return out.select(F.lit(head.get("snapshot")).alias("snapshot"), F.lit(head["log_seq_start"]).alias("log_seq_start"), F.lit(end).alias("tail"), "*")


def session_misses(acked: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Acknowledged writes that a later read of the session lacks."""
    return acked.join(seen.select(*keys), keys, "left_anti")


def monotonic_violations(reads: DataFrame) -> DataFrame:
    """Reads of a session that saw an earlier seq than the read before. ``reads``: (session, read_no, seq)."""
    before = F.max("seq").over(Window.partitionBy("session").orderBy("read_no").rowsBetween(Window.unboundedPreceding, -1))
    return reads.withColumn("before", before).filter("seq < before")


def missed_own_writes(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads of a session below the session's own last write. ``writes``: (session, write_no, seq); ``reads``: (session, read_no, after_write, seq)."""
    return reads.join(writes.select("session", F.col("write_no").alias("after_write"), F.col("seq").alias("written")), ["session", "after_write"]).filter("seq < written")
