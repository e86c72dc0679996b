"""The fold: the last write of each document, over a snapshot and the log after it.

A log row is ``(collection, seq, op, doc_id, after)``; ``after`` is any type: a VARIANT body, a
struct, a scalar. Inserts and updates set the document, deletes remove it. Rows of another
collection, without a doc_id, and updates or inserts without an ``after`` have no effect.

One shuffle: the window keeps one row a key on each side of the exchange, so a hot document
is cut down before it. Filters on doc_id and seq go below the fold by themselves; filters on the
body must stay above it, and do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(log: DataFrame, collection: str | None = None, upto: int | None = None, since: int | None = None) -> DataFrame:
    """(doc_id, seq, op, after) of the rows that count."""
    rows = log
    if collection is not None:
        rows = rows.filter(F.col("collection") == collection)
    if since is not None:
        rows = rows.filter(F.col("seq") >= since)
    if upto is not None:
        rows = rows.filter(F.col("seq") < upto)
    writes = F.col("op").isin("I", "U") & F.col("after").isNotNull()
    return rows.filter(F.col("doc_id").isNotNull() & (writes | (F.col("op") == "D"))).select("doc_id", "seq", "op", "after")


def latest(rows: DataFrame) -> DataFrame:
    """The row of each doc_id with the greatest seq."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("seq"))
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def fold(log: DataFrame, snapshot: DataFrame | None = None, collection: str | None = None, upto: int | None = None, since: int | None = None) -> DataFrame:
    """(_id, body): the view of ``snapshot`` (_id, body) with the log's rows, from ``since`` and below ``upto``, laid over it."""
    rows = effective(log, collection, upto, since)
    if snapshot is not None:
        base = snapshot.select(F.col("_id").alias("doc_id"), F.lit(-1).cast("bigint").alias("seq"), F.lit("U").alias("op"), F.col("body").alias("after"))
        rows = base.unionByName(rows)
    return latest(rows).filter("op <> 'D'").select(F.col("doc_id").alias("_id"), F.col("after").alias("body"))


def compact(log: DataFrame, snapshot: DataFrame | None, upto: int, since: int | None = None, collection: str | None = None) -> DataFrame:
    """The next snapshot: the fold below ``upto``, in id order within files."""
    return fold(log, snapshot, collection, upto, since).repartitionByRange("_id").sortWithinPartitions("_id")


def pre_images(log: DataFrame) -> DataFrame:
    """The log with ``before``: the document's previous ``after``, of any distance."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return log.withColumn("before", F.lag("after").over(w))


def gaps(log: DataFrame, start: int, end: int | None = None, chunk: int = 4096) -> DataFrame:
    """(seq): numbers of [start, end) that the log lacks; ``end`` is the greatest number + 1 if not given.

    Numbers are made in chunks on the executors, only for chunks that are not full.
    """
    spark = log.sparkSession
    if end is None:
        top = log.agg(F.max("seq")).first()[0]
        end = start if top is None else top + 1
    if end <= start:
        return spark.createDataFrame([], "seq bigint")
    have = log.filter((F.col("seq") >= start) & (F.col("seq") < end)).select("seq").distinct()
    full = have.groupBy(F.floor((F.col("seq") - start) / chunk).alias("c")).count().filter(F.col("count") == chunk)
    chunks = spark.range(0, -(-(end - start) // chunk)).withColumnRenamed("id", "c").join(full, "c", "left_anti")
    wanted = chunks.select(F.explode(F.sequence(F.col("c") * chunk + start, F.least((F.col("c") + 1) * chunk + start, F.lit(end)) - 1)).alias("seq"))
    return wanted.join(have, "seq", "left_anti")


def tail(log: DataFrame, hint: int = 0) -> int:
    """The first number from ``hint`` on that the log lacks."""
    seqs = log.filter(F.col("seq") >= hint).select("seq").distinct()
    if not seqs.filter(F.col("seq") == hint).limit(1).count():
        return hint
    # The first row whose successor is missing; no window over the whole log.
    ends = seqs.alias("a").join(seqs.select((F.col("seq") - 1).alias("seq")), "seq", "left_anti")
    return ends.agg(F.min("seq")).first()[0] + 1


def apply_rows(base: DataFrame, seq_col: Column, op: str) -> DataFrame:
    """Log rows of one operation for (_id, body) rows."""
    return base.select(F.col("_id").alias("doc_id"), seq_col.alias("seq"), F.lit(op).alias("op"), F.col("body").alias("after"))
