"""Sharding by extendible hashing (native).

A document's key hash is a string of bits. A directory over hash prefixes starts with one shard,
the empty prefix; a shard over the byte limit, and only such a one, splits on its next bit,
until every shard fits or holds one row. So a document's shard is the shortest prefix of its
hash under which the bytes fit, and a prefix is a shard if it fits and the prefix a bit shorter does not.

Bytes are summed once per cell (the prefixes of one depth). Shorter prefixes are summed from these,
``RUN`` bits at a time, so that no prefix is the sum of more than 2^``RUN`` rows. The shards are then
brought to the cells only at depths that shards have, and the cells to the rows.

Cells that are still too large go on to deeper cells; only their rows take part. Rows that
share all bits (repeated ids) cannot be told apart by the hash and go to overflow pages of their
shard, numbered by running bytes within slices of rows, each page within the limit. Which page
such a row has follows its place in the table.

Defined cases: a null text has no bytes; a null id hashes as the empty string; a row that is
longer than the limit has a shard or page of its own, however long; rows of equal size and id are
told apart by their place; an empty table gives no rows and an empty directory; columns other than
the id and the text are ignored, or carried if named, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import documents, free_name, saved, text_of

MAX_BYTES = 1 << 20
BITS = 32
#: Cells have this many bits more than shards of equal size would need.
SPARE = 5
#: Bits by which prefixes get shorter in one aggregation.
RUN = 6


def key_hash(key: Column) -> Column:
    """The first 32 bits of the MD5 of the key as text, as a bigint."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits as text; the empty text is the root."""
    return F.substring(F.lpad(F.bin(h), BITS, "0"), F.lit(1), depth if isinstance(depth, Column) else F.lit(depth))


def _sums(cells: DataFrame, depth: int, low: int) -> DataFrame:
    """(d, prefix, b, n): bytes and rows of every prefix of ``low`` to ``depth`` bits that has rows."""
    top = cells.select(F.lit(depth).alias("d"), F.col("cell").alias("prefix"), "b", "n")
    out, at = top, depth
    while at > low:
        end = max(low, at - RUN)
        shorter = top.drop("d").withColumn("d", F.explode(F.sequence(F.lit(end), F.lit(at - 1)))).withColumn("prefix", F.expr("substring(prefix, 1, d)"))
        shorter = saved(shorter.groupBy("d", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "prefixes")
        out, top, at = out.unionByName(shorter), shorter.filter(F.col("d") == end), end
    return out


def _shards(cells: DataFrame, depth: int, low: int, max_bytes: int) -> DataFrame:
    """(d, prefix, b, n, fits): the prefixes that are shards, and those of ``depth`` bits that do not fit.

    Prefixes shorter than ``low`` are known to be too large.
    """
    sums = _sums(cells, depth, low).withColumn("fits", (F.col("b") <= max_bytes) | (F.col("n") == 1))
    split = sums.filter("NOT fits").select((F.col("d") + 1).alias("_d"), F.col("prefix").alias("_up"))
    ends = sums.filter(F.col("fits") | (F.col("d") == depth))
    below = ends.filter(F.col("d") > low).join(split, (F.col("d") == F.col("_d")) & (F.expr("substring(prefix, 1, d - 1)") == F.col("_up")), "left_semi")
    return ends.filter(F.col("d") == low).unionByName(below)


def _directory(rows: DataFrame, depth: int, low: int, max_bytes: int) -> DataFrame:
    """(cell, depth, shard_bytes, shard_rows, fits): for each cell of ``depth`` bits its shard's depth.

    A cell of which no prefix fits has ``depth`` and ``fits`` false.
    """
    cells = saved(rows.groupBy(_prefix(F.col("_h"), depth).alias("cell")).agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "cells")
    shards = saved(_shards(cells, depth, low, max_bytes), "shards")
    depths = [r.d for r in shards.select("d").distinct().collect()]  # BITS + 1 at most
    own = cells.select("cell", F.explode(F.array(*map(F.lit, sorted(depths) or [0]))).alias("d")).withColumn("prefix", F.expr("substring(cell, 1, d)"))
    return own.join(shards, ["d", "prefix"]).select("cell", F.col("d").alias("depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"), "fits")


def _overflow(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of one hash each over the limit: pages by running bytes within slices of at most a task's rows."""
    rows = saved(rows.withColumn("_o", F.monotonically_increasing_id()), "overflow")
    rows = rows.withColumn("_slice", F.floor(F.col("_o") / 100000))
    w = Window.partitionBy("_h", "_slice").orderBy("_bytes", "_o")
    top = F.max("_bytes").over(Window.partitionBy("_h", "_slice"))
    room = F.greatest(F.lit(max_bytes) - top, F.lit(1))
    ends = F.sum("_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Bytes that start within one stretch of limit minus longest row stay within the limit.
    page = F.when(top * 2 > max_bytes, F.row_number().over(w)).otherwise(F.floor((ends - F.col("_bytes")) / room))
    return rows.withColumn("page", F.concat_ws(".", F.col("_slice").cast("string"), page.cast("string")))


def assign(docs: DataFrame, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, shard, depth, bytes, shard_bytes, shard_rows, …carry) for every row.

    ``shard``: the hash bits of the shard, '*' for the root, and '/page' after it for an overflow page.
    """
    size = F.octet_length(text_of(F.col("text"))) if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), key_hash(F.col(id_col)).alias("_h"), size.cast("bigint").alias("_bytes"), *carry)
    rows = saved(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    out, low = None, 0
    depth = min(BITS, max(1, math.ceil(math.log2(max(1, total / max_bytes)))) + SPARE)
    columns = ["doc_id", "shard", "depth", "bytes", "shard_bytes", "shard_rows", *carry]
    while True:
        directory = saved(_directory(rows, depth, low, max_bytes), "directory")
        placed = rows.withColumn("cell", _prefix(F.col("_h"), depth)).join(directory, "cell")
        shard = F.when(F.col("depth") == 0, "*").otherwise(F.expr("substring(cell, 1, depth)"))
        done = placed.filter("fits").select("doc_id", shard.alias("shard"), "depth", F.col("_bytes").alias("bytes"), "shard_bytes", "shard_rows", *carry)
        out = done if out is None else out.unionByName(done)
        if not directory.filter("NOT fits").limit(1).count():
            return out.select(*columns)
        rows = placed.filter("NOT fits").select("doc_id", "_h", "_bytes", *carry)
        if depth == BITS:
            paged = _overflow(rows, max_bytes).withColumn("shard", F.concat(_prefix(F.col("_h"), BITS), F.lit("/"), F.col("page")))
            paged = saved(paged.select("doc_id", "shard", F.lit(BITS).alias("depth"), F.col("_bytes").alias("bytes"), *carry), "pages")
            sums = paged.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
            return out.unionByName(paged.join(sums, "shard")).select(*columns)
        low, depth = depth + 1, min(BITS, depth + 6)
        rows = saved(rows, "shard-rows")


def directory(assigned: DataFrame) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows): the directory's entries, of what ``assign`` returned. A key's shard is the one that begins its bits."""
    return assigned.select("shard", "depth", "shard_bytes", "shard_rows").distinct()


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> None:
    """Write the documents as Parquet with a folder for each shard: every row once, rows of one id too."""
    row, other, shard = free_name(docs, "_row"), free_name(docs, "_other"), free_name(docs, "shard")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    placed = assign(numbered, max_bytes, carry=(row,)).select(F.col(row).alias(other), F.col("shard").alias(shard))
    numbered.join(placed, F.col(row) == F.col(other)).drop(row, other).repartition(shard).write.partitionBy(shard).parquet(path)


def op7_extendible_sharding(spark, sf_dir):
    return assign(documents(spark, sf_dir).select("doc_id", "text"))


SQL = f"""
WITH d AS (
  SELECT doc_id, COALESCE(octet_length(encode(text)), 0)::BIGINT AS bytes,
         right(repeat('0', 32) || bin(('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 8))::BIGINT), 32) AS bits
  FROM documents),
p AS (SELECT doc_id, bytes, k::INTEGER AS depth, substr(bits, 1, k::INTEGER) AS prefix
      FROM d, generate_series(0, 32) AS g(k)),
s AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows FROM p GROUP BY ALL),
f AS (SELECT p.doc_id, p.bytes, p.depth, p.prefix, s.shard_bytes, s.shard_rows,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix
      WHERE s.shard_bytes <= {MAX_BYTES} OR s.shard_rows = 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '*' ELSE prefix END AS shard, depth, bytes, shard_bytes, shard_rows
FROM f WHERE k = 1
"""

QUERIES = {"op7_extendible_sharding": op7_extendible_sharding}
ORACLES: dict[str, str] = {"op7_extendible_sharding": SQL}
