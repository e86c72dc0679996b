import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from foldlake.llm import fingerprints as P
from foldlake.llm import sharding as S
from tests.llm.conftest import ODD


def shingles(text, k=5):
    w = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_estimates_are_unbiased(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    pairs = []
    for i in range(120):
        a = [rng.choice(words) for _ in range(rng.randint(8, 300))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 12))):
            b[rng.randrange(len(b))] = rng.choice(words)
        pairs.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    fa, fb = P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))
    got = {r.k: r.e for r in df.select("k", fa.alias("fa"), fb.alias("fb")).select("k", P.likeness(F.col("fa"), F.col("fb")).alias("e")).collect()}
    err = [got[k] - len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for k, a, b in pairs]
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.08


def test_signature_against_python(spark):
    """Bins keep their least hash; every empty bin holds the value of some filled bin, the same for the same filled bins."""
    rows = [(0, "a b c d e f g h"), (1, "only five words are here"), (2, " ".join(str(i) for i in range(700)))]
    df = spark.createDataFrame(rows, "k int, t string").select("k", P.shingle_hashes(F.col("t")).alias("h")).select("k", "h", P.signature(F.col("h")).alias("s"))
    for r in df.collect():
        bins = {}
        for h in r.h:
            b = (h & (2**64 - 1)) >> 57
            bins[b] = min(h, bins.get(b, h))
        assert len(r.s) == P.BINS and set(r.s) <= set(bins.values())
        assert all(r.s[b] == v for b, v in bins.items())


def test_odd_texts(spark, make):
    df = make(ODD).select("doc_id", "text", P.fingerprint(P.text_of(F.col("text"))).alias("f"))
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.f)
    assert all(len(v) == 1 for v in by.values()) and by[""] == {"-"} and by["!!! ???"] != by["   \n"]
    like = df.crossJoin(df.select(F.col("f").alias("g")).limit(3)).select(P.likeness(F.col("f"), F.col("g")).alias("x"))
    assert all(0 <= r.x <= 1 for r in like.collect())


def next_of(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return sorted((str(a), t, u) for (a, t), (_, u) in zip(order, order[1:] + order[:1], strict=True))


def test_next_row(spark):
    rng = random.Random(3)
    cases = [[(1, "x")], [(i, f"t{i}") for i in range(50)], [(i * 1000 - 20000, f"t{i}") for i in range(37)], [(None, "n"), (1, "a"), (2, "b")], [(None, "n"), (None, "m")], [(1, "b"), (1, "a"), (2, "c"), (2, "c")], [(rng.randint(0, 12), f"t{rng.randint(0, 5)}") for _ in range(40)], []]
    for rows in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for per in (2, 7, 1000):
            got = sorted((str(r.doc_id), r.text, r.next_text) for r in P.with_next(df, ["text"], per).collect())
            assert got == next_of(rows), (rows, per)


def test_op9_against_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in P.op9_fingerprints(spark, sf).collect()}
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(docs)
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(t) // 4
        want = t[: len(t) - cut] + u[:cut]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and (want != t or r.near_edited == 1)


def brute_shards(rows, most):
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), "032b") for i, _ in rows}
    out = {}

    def split(prefix, members):
        if sum(b for _, b in members) <= most or len(members) == 1:
            out.update({i: prefix or "*" for i, _ in members})
        else:
            for x in "01":
                part = [m for m in members if bits[m[0]].startswith(prefix + x)]
                if part:
                    split(prefix + x, part)

    split("", rows)
    return out


def test_shards_against_splitting(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 5, 50, 400])) for i in range(500)]
    df = spark.createDataFrame([(i, "x" * b) for i, b in rows], "doc_id long, text string")
    for most in (100, 1000, 10**6):
        got = S.assign(df, most).collect()
        assert {r.doc_id: r.shard for r in got} == brute_shards(rows, most)
        assert all(r.shard_bytes <= most or r.shard_rows == 1 for r in got)


def test_rows_of_one_id_overflow_to_pages(spark):
    df = spark.createDataFrame([(7, "x" * 10)] * 300 + [(8, "y")], "doc_id long, text string")
    got = S.assign(df, 100)
    assert got.count() == 301
    sums = got.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.b <= 100 for r in sums) and sum(r.n for r in sums) == 301


def test_directory_covers_every_key_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 5, 50, 400])) for i in range(300)]
    df = spark.createDataFrame([(i, "x" * b) for i, b in rows], "doc_id long, text string")
    got = [r.shard.replace("*", "") for r in S.directory(S.assign(df, 700)).collect()]
    bits = [format(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), "032b") for i, _ in rows]
    assert all(sum(b.startswith(g) for g in got) == 1 for b in bits)
    assert S.directory(S.assign(df.limit(0))).count() == 0


def test_write_shards_with_repeated_ids(spark, make, tmp_path):
    S.write_shards(make([(1, "x"), (1, "y"), (2, "z"), (None, "n"), (None, "n")]), f"{tmp_path}/s", 2)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == [(0, "n"), (0, "n"), (1, "x"), (1, "y"), (2, "z")]


def test_sharding_odd(spark, make):
    assert S.assign(make([])).count() == 0
    assert S.assign(make(ODD)).count() == len(ODD)
    assert S.assign(make(ODD), 3).count() == len(ODD)


def test_sharding_oracle(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(S.SQL).fetchall())
    assert sorted(tuple(r) for r in S.op7_extendible_sharding(spark, sf).collect()) == want


def test_write_shards(spark, make, tmp_path):
    docs = make([(i, "z" * 50) for i in range(40)], extra=False)
    S.write_shards(docs, f"{tmp_path}/s", 500)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 40
