"""Packing into optimal length buckets.

The global histogram of lengths (the ids that a tokenizer gives a document, or any other column) is
aggregated on the executors; one row a distinct length comes to the driver. Dynamic programming
over it chooses the bucket boundaries for which padding, the tokens needed to fill every
document up to its bucket's boundary, is least. The cost is concave Monge, so each layer is
solved by divide and conquer in n log n steps. Inside a bucket, documents are numbered and
batches take as many as the token budget holds at the bucket's padded length.

A bucket may hold a third of all documents, so rows are numbered in two steps: within (bucket,
slice) by a window, and by running counts of the slices, of which there is one for about
``SLICE`` rows. Slices are cut by id, text and place, so that rows of one id, or equal rows, are
cut too. Order within a bucket: by slice, hash of the id, id, length, text hash and place.

Defined cases: a null or empty text has no token and goes to the first bucket; a document that is
longer than the budget is a batch of its own (``over_budget``), however long; repeated rows are packed
each; a null id is packed like any; among equal paddings the fewest buckets are taken; an empty table gives
no rows; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents, saved, text_of
from foldlake.llm.sstable import encoder, vocabulary_of

BUCKETS = 16
BUDGET = 65536
SLICE = 50_000
#: Characters of texts that are cut into a tokenizer's pieces together.
CHARS = 2_000_000


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text_of(text), F.lit(r"\S+")).cast("bigint")


def tokens(text: Column, tokenizer: str) -> Column:
    """Number of ids that a tokenizers file gives the whole text, without special ones around it."""
    vocabulary, width = vocabulary_of(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary, width)
        for texts in batches:
            rows = texts.tolist()
            counts = [own.count(rows[lo:hi]) for lo, hi in _spans(rows)]  # an Arrow batch cut up at once takes much memory
            yield pd.Series(np.concatenate(counts) if counts else np.zeros(0, np.int64))

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "bigint")(text_of(text))


def _spans(texts: list[str], most: int = CHARS) -> list[tuple[int, int]]:
    """(begin, end) of runs of texts that have ``most`` characters together at the utmost, or are one longer text."""
    out, lo, chars = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and chars + len(t) > most:
            out.append((lo, i))
            lo, chars = i, 0
        chars += len(t)
    return [*out, (lo, len(texts))] if texts else []


def choose_boundaries(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` boundaries, the last the greatest length, with the least padding. Among equals, the fewest."""
    x, c = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(x):
        return []
    n, total, weight = len(x), np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])

    def cost(i, j):
        """Padding of lengths i..j-1 up to length j-1."""
        return x[j - 1] * (total[j] - total[i]) - (weight[j] - weight[i])

    ends = np.arange(1, n + 1)
    best = np.concatenate([[0], cost(np.zeros(n, np.int64), ends)])
    cuts: list[np.ndarray] = []
    layers = [best]
    for _ in range(1, min(buckets, n)):
        new, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            v = best[i] + cost(i, mid)
            k = int(v.argmin())
            new[mid], cut[mid] = v[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        cuts.append(cut)
        layers.append(new)
        best = new
    finals = [int(layer[n]) for layer in layers]
    layer, j, out = finals.index(min(finals)), n, []
    while True:
        out.append(int(x[j - 1]))
        if layer == 0:
            return sorted(out)
        j, layer = int(cuts[layer - 1][j]), layer - 1
        if j == 0:
            return sorted(out)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, slot, padding, over_budget) for every row.

    ``bucket`` counts from 0 by length, ``batch`` from 0 in its bucket, ``slot`` from 0 in its batch.
    """
    length = words(F.col("text")) if length is None else length
    rows = batched(docs).select("doc_id", length.cast("bigint").alias("n_tokens"), F.xxhash64(text_of(F.col("text"))).alias("_t"), F.monotonically_increasing_id().alias("_row"))
    rows = saved(rows, "lengths")
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").toPandas()  # a row for each distinct length
    bounds = choose_boundaries(histogram["n_tokens"], histogram["count"], buckets)
    if not bounds:
        none = {"bucket": "int", "bucket_length": "bigint", "batch": "bigint", "slot": "bigint", "padding": "bigint", "over_budget": "boolean"}
        return rows.select("doc_id", "n_tokens", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    array = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    bucket = F.size(F.filter(array, lambda b: b < F.col("n_tokens")))
    slices = max(1, int(histogram["count"].sum()) // slice_rows)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_length", F.get(array, F.col("bucket"))).withColumn("_h", F.xxhash64("doc_id")).withColumn("_slice", F.pmod(F.xxhash64("doc_id", "_t", "_row"), F.lit(slices)))
    sums = rows.groupBy("bucket", "_slice").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("bucket", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("bucket", "_slice").orderBy("_h", "doc_id", "n_tokens", "_t", "_row"))
    placed = rows.withColumn("_own", own).join(sums, ["bucket", "_slice"])
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1))))
    number = F.col("_before") + F.col("_own") - 1
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bucket_length",
        F.floor(number / per_batch).cast("bigint").alias("batch"), F.pmod(number, per_batch).cast("bigint").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"), (F.col("n_tokens") > budget).alias("over_budget"),
    )


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark, sf_dir):
    return pack(documents(spark, sf_dir).select("doc_id", "text"), tokens(F.col("text"), _tokenizer()))


def pack_stage(spark, docs, sf_dir):
    """Last pipeline stage: where each document goes, by the lengths of its token ids. No document goes."""
    return pack(docs.select("doc_id", "text"), tokens(F.col("text"), _tokenizer()))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
