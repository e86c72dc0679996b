"""N-gram Jaccard self-join by MinHash banding.

Documents are sets of word shingles (``WIDTH`` words, lower case, 64-bit hashes). Texts with equal sets
are one class, named by the 128-bit digest of the set, and only its representative, the least id, is
joined. Each representative has a MinHash signature cut into bands; band and row counts are chosen so
that a pair at the threshold shares a band with probability ``RECALL`` at least. Band hashes are
shuffled; those met twice are buckets, and of buckets with the same members one is kept. Every pair
within a bucket is verified on the full shingle sets, in the first bucket that it shares.

A bucket may be as large as the input. Its members are dealt into blocks of about ``BLOCK`` and
each pair of blocks is a task's unit of work: it makes no row for a pair but, for each member,
the number of documents linked, and the edges of a spanning forest of the links, from which
the classes' groups (connected components) are found. So no pair is dropped or written out. A member
of a bucket of n goes to n / ``BLOCK`` tasks, which exact counts of links within it need.

A text may be that of a third of all rows, so joins that bring results back to rows read two written
tables, and partitions that one key makes large are read by several tasks (adaptive skew joins).

Defined cases: a null text is the empty text. Fewer words than a shingle has make one shingle
of all words; a text without words is one shingle, the text itself; a text of any length is used whole,
by one task. Rows that repeat an id are one document if their texts are equal; if not, each text counts
as a document of that id. A null id is no document: its row is kept with nulls. An empty table gives
no rows. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlake.llm.common import batched, documents, free_name, saved
from foldlake.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
PERMUTATIONS = 128
BLOCK = 256
WORD = re.compile(r"[^\W_]+")


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that ``most`` permutations allow.

    A threshold so low that they allow none takes more permutations: bands of one row reach any recall.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("a threshold lies above 0 and up to 1, a recall between them")
    need = lambda rows: max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
    rows = next((r for r in range(most, 0, -1) if need(r) * r <= most), 1)
    return need(rows), rows


class Shingler:
    """Sorted distinct shingle hashes of a text; the hashes of words seen before are kept."""

    CACHE = 500_000

    def __init__(self, width: int = WIDTH):
        self.width, self.kept = width, {}
        rng = np.random.default_rng(17)
        self.mul = rng.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)

    def _hash(self, word: str) -> int:
        h = self.kept.get(word)
        if h is None:
            if len(self.kept) >= self.CACHE:
                self.kept.clear()
            h = self.kept[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if not words:
            return np.array([self._hash("\0" + (text or ""))], np.uint64)
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        k = min(self.width, len(h))
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s += h[i : len(h) - k + 1 + i] * self.mul[i]
            s ^= s >> np.uint64(31)
        s *= np.uint64(0xD6E8FEB86659FD93)
        s ^= s >> np.uint64(32)
        return np.unique(s)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(1, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, hashes: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A signed 64-bit hash for each band of the MinHash signature."""
    a, b = hashes
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 4096):  # bounded memory for texts of any length
        x = low[at : at + 4096, None] * a + b
        x ^= x >> np.uint32(15)
        x = (x + high[at : at + 4096, None]) * np.uint32(0x85EBCA6B)
        np.minimum(least, x.min(0), out=least)
    m = least.reshape(bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        h = (h ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64).tolist()


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, hash of the text, digest of the shingle set, number of shingles, band hashes) for each row with an id."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, hashes = Shingler(), _permutations(bands * rows)
        summary = lambda s: (blake2b(s.tobytes(), digest_size=16).digest(), len(s), np.array(band_hashes(s, bands, rows, hashes)))
        for b in batches:
            made = [summary(shingler(t)) for t in b["text"]]  # one set at a time is held
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "own": b["own"],
                "digest": [m[0] for m in made], "size": [m[1] for m in made], "bands": [m[2] for m in made],
            })

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), own_hash().alias("own"), "text")
    return batched(texts).mapInPandas(sign, "doc_id long, own long, digest binary, size int, bands array<long>")


def own_hash() -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def _shingle_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, shingles) of the wanted ids, whose texts alone are shuffled to the task that needs them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for b in batches:
            sets = [shingler(t) for t in b["text"]]
            yield pd.DataFrame({"digest": [blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "shingles": [s.tobytes() for s in sets]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return batched(texts).join(wanted, "doc_id", "left_semi").mapInPandas(cut, "digest binary, shingles binary")


VERIFIED = "node binary, other binary, links long"


class _Block:
    """The rows of one pair of blocks of a bucket."""

    def __init__(self):
        self.node, self.weight, self.side, self.buckets, self.sets = [], [], [], [], []

    def add(self, r) -> None:
        self.node.append(r.node)
        self.weight.append(r.weight)
        self.side.append(r.side)
        self.buckets.append(np.asarray(r.buckets))
        self.sets.append(np.frombuffer(r.shingles, np.uint64))

    def links(self, bucket: int, first: int, second: int, threshold: float) -> np.ndarray:
        """Boolean matrix of the pairs that are similar and belong to this bucket and these blocks."""
        n = len(self.node)
        sizes = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        row = np.repeat(np.arange(n), sizes)
        values, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(counts > 1)
        place = np.full(len(values), -1)
        place[shared] = np.arange(len(shared))
        common = np.zeros((n, n), np.float32)
        at = place[ids]
        for lo in range(0, len(shared), 4096):
            m = (at >= lo) & (at < lo + 4096)
            dense = np.zeros((n, min(4096, len(shared) - lo)), np.float32)
            dense[row[m], at[m] - lo] = 1
            common += dense @ dense.T
        # Exact: the counts are whole numbers below 2^24.
        ok = common >= np.ceil(threshold * (sizes[:, None] + sizes[None, :]) / (1 + threshold) - 1e-9)
        ok[np.arange(n), np.arange(n)] = False
        if first != second:
            side = np.array(self.side)
            ok &= side[:, None] != side[None, :]
        # A pair that shares a lesser bucket is verified there.
        lesser = [b[b < bucket] for b in self.buckets]
        values, ids = np.unique(np.concatenate(lesser), return_inverse=True)
        member = np.zeros((n, len(values)), np.float32)
        member[np.repeat(np.arange(n), [len(b) for b in lesser]), ids] = 1
        ok &= member @ member.T == 0
        return ok

    def results(self, bucket: int, first: int, second: int, threshold: float) -> list[tuple[bytes, bytes | None, int]]:
        """(node, null, documents linked with it) and (node, other, 0): edges that connect what links connect."""
        n = len(self.node)
        if n < 2:
            return []
        ok = self.links(bucket, first, second, threshold)
        counts = ok @ np.array(self.weight)
        out: list = [(self.node[i], None, int(counts[i])) for i in np.flatnonzero(counts)]
        root = np.arange(n)
        while True:  # the least row number of each component of the links
            new = np.minimum(root, np.where(ok, root[None, :], n).min(1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        # Each component's edges meet at a member of its own choice, lest one node be the middle of a bucket's blocks.
        seed = (bucket ^ first * 0x9E3779B1 ^ second * 0x85EBCA6B) & 0x7FFFFFFF
        middle = np.arange(n)
        for r in np.unique(root):
            members = np.flatnonzero(root == r)
            middle[members] = members[seed % len(members)]
        out += [(self.node[i], self.node[m], 0) for i, m in enumerate(middle.tolist()) if m != i]
        return out


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block, out = None, _Block(), []
        for b in batches:
            for r in b.itertuples(index=False):
                k = (r.bucket, r.first, r.second)
                if k != key:
                    if key is not None:
                        out += block.results(*key, threshold)
                    key, block = k, _Block()
                block.add(r)
            if len(out) > 2000:
                yield _result(out)
                out = []
        if key is not None:
            out += block.results(*key, threshold)
        yield _result(out)

    return run


def _result(rows: list[tuple]) -> pd.DataFrame:
    node, other, links = zip(*rows, strict=True) if rows else ((), (), ())
    return pd.DataFrame({"node": pd.Series(node, dtype=object), "other": pd.Series(other, dtype=object), "links": pd.array(links, "int64")})


def distinct_buckets(spread: DataFrame) -> DataFrame:
    """(bucket, n) of the buckets that two nodes or more of ``spread`` (node, bucket) met in, one of those with equal members.

    Members are told by their number and two exclusive ors of 64-bit hashes, 128 bits in all, which no
    number of rows can overflow.
    """
    met = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
    return met.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")


def grouped(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, own, digest, root, class_id, n_links, copy_of, n_copies) for every row with an id.

    ``own`` tells apart the texts of one id, ``digest`` the shingle sets, ``root`` the groups.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = saved(signatures(docs, bands, rows), "signatures")
    classes = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands"))
    classes = saved(classes, "classes").withColumnRenamed("digest", "node")

    spread = classes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    members = saved(spread.join(distinct_buckets(spread), "bucket"), "members")
    of_node = members.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # as many as bands at most
    wanted = saved(classes.select("node", "rep", "weight").join(of_node, "node"), "wanted")
    sets = _shingle_rows(docs, wanted.select(F.col("rep").alias("doc_id"))).dropDuplicates(["digest"])
    loaded = saved(wanted.join(sets, F.col("node") == F.col("digest")).select("node", "weight", "buckets", "shingles"), "loaded")

    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    work = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    work = work.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = work.select("node", "bucket", F.least("own", "k").alias("first"), F.greatest("own", "k").alias("second"), (F.col("own") <= F.col("k")).cast("int").alias("side"))
    work = work.join(loaded, "node").repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second", "node")
    verified = saved(batched(work).mapInPandas(_verify(threshold), VERIFIED), "verified")

    links = verified.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(verified.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of_class = classes.select("node", "rep", "weight").join(roots, "node", "left").join(links, "node", "left")
    of_class = saved(of_class.select("node", "rep", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "of-class")
    least = saved(of_class.filter("node <> root OR links > 0").groupBy("root").agg(F.min("rep").alias("class_id")), "least")
    info = saved(of_class.join(least, "root", "left").select("node", "rep", "weight", "root", F.coalesce("class_id", "rep").alias("class_id"), "links"), "info")
    return signed.select("doc_id", "own", "digest").join(info, F.col("digest") == F.col("node")).select(
        "doc_id", "own", "digest", "root", "class_id",
        (F.col("links") + F.col("weight") - 1).cast("long").alias("n_links"), F.col("rep").alias("copy_of"), F.col("weight").alias("n_copies"),
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of, n_copies) for every row.

    ``class_id``: the least id of all documents that links connect with it. ``n_links``: the
    documents that are similar to it, copies included. ``copy_of``: the least id with an equal
    shingle set; ``n_copies``: how many have it.
    """
    found = grouped(docs, threshold, recall).select("doc_id", "class_id", "n_links", "copy_of", "n_copies")
    lost = docs.filter("doc_id IS NULL").select(*[F.lit(None).cast("long").alias(c) for c in found.columns])
    return found.unionByName(lost)


def op8_ngram_join(spark, sf_dir):
    return join(documents(spark, sf_dir).select("doc_id", "text"))


def keep_one_stage(spark, docs, sf_dir):
    """Pipeline stage: of each group of linked documents the one with the least id stays. Rows without an id stay.

    Rows of one id with unlike texts are documents of their own, in groups of their own, and each group
    keeps one; of equal rows one stays.
    """
    key, own = free_name(docs, "_keep"), free_name(docs, "_own")
    first = grouped(docs.select("doc_id", "text")).groupBy("root").agg(F.min(F.struct("doc_id", "own")).alias("x"))
    keep = saved(first.select(F.col("x.doc_id").alias(key), F.col("x.own").alias("_o")), "keep")
    named = docs.filter("doc_id IS NOT NULL").withColumn(own, own_hash())
    kept = named.join(keep.withColumnRenamed("_o", own + "_"), (F.col("doc_id") == F.col(key)) & (F.col(own) == F.col(own + "_")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", own]).select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


#: Every pair by shared shingles: for small tables only, as it makes a row for each pair that shares one.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [text] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
        ELSE list_transform(generate_series(1, len(w) - {WIDTH - 1}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin, count(*) FILTER (WHERE same) AS twins FROM l GROUP BY a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(m.least, d.doc_id)) AS class_id, coalesce(n_links, 0) AS n_links,
  least(d.doc_id, coalesce(twin, d.doc_id)) AS copy_of, coalesce(twins, 0) + 1 AS n_copies
FROM documents d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

QUERIES = {"op8_ngram_join": op8_ngram_join}
ORACLES: dict[str, str] = {"op8_ngram_join": SQL}
