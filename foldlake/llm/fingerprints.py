"""One-permutation MinHash fingerprints (native).

The hashes of a document's word shingles are binned once by their top bits and each bin keeps
its minimum. An empty bin takes the value of another bin by optimal densification: it probes
bins in an order of its own, the same for all documents, until it meets a filled one. The low
``BITS`` bits of every bin are packed into the fingerprint; the likeness of two fingerprints is
the share of equal bins, corrected for the chance that unequal values share their low bits.

Defined cases: a null text is the empty text. A text without words, unless empty, is one
shingle, the text itself; with fewer words than a shingle has, all its words are one. The empty
text has no shingle and the fingerprint of "no shingle": likeness 1 to itself and 0 to others.
Repeated rows are rows of their own, ordered by id and then by text. Ids that are null come
first. An empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldlake.llm.common import documents, text_of

BINS = 128
BITS = 8
WIDTH = 5
#: Probes by fixed random maps before the remaining bins are settled by rank.
PROBES = 12
WORDS = r"[^\p{L}\p{N}]+"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``."""
    words = F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h):
        slide = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        whole = F.array(F.xxhash64(h))
        return F.when(F.size(h) >= width, slide).when(F.size(h) > 0, whole)

    # One-element transform: binds the word hashes once instead of once for each use.
    found = F.transform(F.array(hashed), shingles)[0]
    none = F.when(text != "", F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.coalesce(found, none))


def _probe_maps(bins: int, count: int) -> str:
    """SQL literal: for each probe the bin that each bin looks into."""
    rng = random.Random(20140607)
    return "array(" + ",".join("array(" + ",".join(str(rng.randrange(bins)) for _ in range(bins)) + ")" for _ in range(count)) + ")"


def signature(hashes: Column, bins: int = BINS) -> Column:
    """Array of ``bins`` minima, empty bins filled; null for no hashes. ``hashes`` must be sorted."""
    shift = 64 - (bins.bit_length() - 1)
    bin_of = lambda h: F.shiftrightunsigned(h, shift).cast("int")

    def fill(sorted_hashes):
        # Signed order puts bins of the upper half first, which keeps each bin in one run.
        firsts = F.filter(sorted_hashes, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(sorted_hashes, i - 1))))
        return F.transform(F.array(firsts), dense)[0]

    def dense(firsts):
        ids = F.transform(firsts, bin_of)
        placed = F.transform(F.array(ids), lambda b: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.get(firsts, (F.array_position(b, i.cast("int")) - 1).cast("int"))))[0]
        return F.transform(F.array(placed), lambda p: probe(firsts, ids, p))[0]

    def probe(firsts, ids, placed):
        maps = F.expr(_probe_maps(bins, PROBES))
        gap = lambda a: F.exists(a, lambda x: x.isNull())
        probed = F.aggregate(maps, placed, lambda acc, m: F.when(gap(acc), F.transform(acc, lambda x, i: F.coalesce(x, F.get(placed, F.get(m, i))))).otherwise(acc))
        # What is still empty takes the filled bin of the least rank in the bin's own random order.
        ranked = lambda i: F.array_min(F.transform(firsts, lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("r"), h.alias("h"))))["h"]
        return F.transform(F.array(probed), lambda a: F.when(gap(a), F.transform(a, lambda x, i: F.coalesce(x, ranked(i)))).otherwise(a))[0]

    return F.when(F.size(hashes) > 0, F.transform(F.array(hashes), fill)[0])


def low_bits(sig: Column, bits: int = BITS) -> Column:
    return F.transform(sig, lambda h: h.bitwiseAND(F.lit((1 << bits) - 1)))


def pack(low: Column, bits: int = BITS) -> Column:
    """Hex string of the packed low bits; '-' for no shingle."""
    return F.coalesce(F.lower(F.array_join(F.transform(low, lambda v: F.lpad(F.hex(v), (bits + 3) // 4, "0")), "")), F.lit("-"))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    return pack(low_bits(signature(shingle_hashes(text), bins), bits), bits)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two packed fingerprints.

    Unequal values agree in their low bits by a chance of 2^-bits, which is taken out.
    """
    w = (bits + 3) // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0), lambda n, i: n + F.when(F.substring(a, i * w + 1, F.lit(w)) == F.substring(b, i * w + 1, F.lit(w)), 1).otherwise(0))
    chance = 1.0 / (1 << bits)
    est = (same / F.lit(float(bins)) - chance) / (1 - chance)
    return F.when((a == "-") | (b == "-"), (a == b).cast("double")).when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), est))


def _numbers(values: list[int]) -> Column:
    """An array literal of longs; one string keeps the plan small."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_marks(df: DataFrame, key: str, rows_per_range: int, most: int = 65536) -> list[int]:
    """Ids of ``df`` that split it into ranges of about equal rows: one pass over the id column.

    The list is a bounded directory: ``most`` ids at the utmost, whatever the input's size.
    """
    n = df.count()
    parts = max(1, min(most, n // rows_per_range))
    got = df.agg(F.percentile_approx(key, [i / parts for i in range(parts)], max(10000, 4 * parts)).alias("m"), F.min(key).alias("lo")).first()
    return sorted({got["lo"], *got["m"]}) if got["lo"] is not None else []


def range_of(key: Column, marks: list[int]) -> Column:
    """Number of marks that are at most ``key``, by binary search in an array literal; 0 for a null key."""
    if not marks:
        return F.lit(0)
    steps = [1 << i for i in range(len(marks).bit_length() - 1, -1, -1)]
    bounds = _numbers(marks)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, s: F.when((acc + s <= len(marks)) & (F.get(bounds, acc + s - 1) <= key), acc + s).otherwise(acc),
    )


def with_next(rows: DataFrame, carried: list[str], rows_per_range: int = 2000) -> DataFrame:
    """``rows`` with ``next_<c>`` for each carried column: the next row's value by ascending doc_id, then text.

    After the last row comes the first. Ids are dealt into ranges by marks that are ids of the
    table themselves. The rows that stand at a mark, where a range starts, also go as guests to
    the range before, and the first rows of all to the last range; so every row finds its
    follower within its range, and no sort is global.
    """
    ids = rows.select("doc_id")
    marks = range_marks(ids, "doc_id", rows_per_range)
    nulls = bool(ids.filter("doc_id IS NULL").limit(1).count())
    d = rows.withColumn("_r", range_of(F.col("doc_id"), marks))
    at_mark = F.coalesce(F.get(_numbers(marks), F.col("_r") - 1) == F.col("doc_id"), F.lit(False)) if marks else F.lit(False)
    before = F.when(at_mark & (F.col("_r") > (0 if nulls else 1)), F.col("_r") - 1)
    first = F.col("doc_id").isNull() if nulls else at_mark & (F.col("_r") == 1)
    seats = F.array(
        F.struct(F.col("_r").alias("r"), F.lit(0).alias("guest")),
        F.struct(before.alias("r"), F.lit(1).alias("guest")),
        F.struct(F.when(first, F.lit(len(marks))).alias("r"), F.lit(2).alias("guest")),
    )
    spread = d.withColumn("_seat", F.explode(F.filter(seats, lambda c: c["r"].isNotNull()))).select("*", F.col("_seat.guest").alias("_g"), F.col("_seat.r").alias("_range"))
    w = Window.partitionBy("_range").orderBy("_g", F.col("doc_id").asc_nulls_first(), "text")
    led = spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return led.filter("_g = 0").drop("_r", "_seat", "_g", "_range")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last quarter replaced by as many code points of the start of ``other``, or all."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(other, F.lit(1), cut))


def op9_fingerprints(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col("text")).alias("text"))
    d = with_next(d.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    d = d.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    d = d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", fingerprint(F.col("edited_text")).alias("edited_fingerprint"), "next_fingerprint",
    )
    return d.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op9_fingerprints": op9_fingerprints}
ORACLES: dict[str, str] = {}
