import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldlake.llm import ngram_join as J
from foldlake.llm import packing as K
from foldlake.llm.common import batched
from foldlake.llm.components import components
from tests.llm.conftest import ODD

rng = random.Random(8)


def padding(x, c, bounds):
    return sum(n * (min(b for b in bounds if b >= v) - v) for v, n in zip(x, c, strict=True))


def test_boundaries_are_optimal():
    for _ in range(200):
        x = sorted(rng.sample(range(60), rng.randint(1, 9)))
        c, k = [rng.randint(1, 9) for _ in x], rng.randint(1, 5)
        got = K.choose_boundaries(x, c, k)
        best = min(padding(x, c, [*s, x[-1]]) for r in range(k) for s in itertools.combinations(x[:-1], r))
        assert padding(x, c, got) == best and len(got) <= k
    assert K.choose_boundaries([], []) == []


@pytest.mark.parametrize("slice_rows", [7, 100000])
def test_batches(spark, make, slice_rows):
    docs = make([*ODD, *[(100 + i, "w " * rng.randint(1, 60)) for i in range(150)]])
    p = K.pack(docs, buckets=4, budget=100, slice_rows=slice_rows).toPandas()
    assert len(p) == len(ODD) + 150 and not p.duplicated(["bucket", "batch", "slot"]).any()
    assert (p.n_tokens <= p.bucket_length).all() and p.bucket_length.nunique() <= 4
    g = p.groupby(["bucket", "batch"])
    cost = g.size() * g.bucket_length.first()
    assert ((cost <= 100) | (g.size() == 1)).all()
    for _, b in p.groupby("bucket"):
        sizes = b.groupby("batch").size().sort_index()
        assert list(sizes.index) == list(range(len(sizes))) and sizes.iloc[:-1].nunique() <= 1
    assert p[p.over_budget].n_tokens.min() > 100


def test_query_against_brute_force_packing(spark):
    """Lengths by the library, boundaries by trying every split layer by layer, batches by counting along the hash order."""
    import public_tokenizers
    import xxhash
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in docs}
    count = Counter(n.values())
    x = sorted(count)
    cost = lambda i, j: sum(count[v] * (x[j] - v) for v in x[i : j + 1])
    best = {j: cost(0, j) for j in range(len(x))}
    table = {(i, j): cost(i, j) for j in range(len(x)) for i in range(j + 1)}
    for _ in range(K.BUCKETS - 1):
        best = {j: min([best[j], *(best[i - 1] + table[i, j] for i in range(1, j + 1))]) for j in best}
    rows = K.op2_packing(spark, sf).toPandas()
    assert dict(zip(rows.doc_id, rows.n_tokens, strict=True)) == n
    assert rows.padding.sum() == best[len(x) - 1] and rows.bucket.nunique() <= K.BUCKETS
    bounds = sorted(set(rows.bucket_length))
    order = lambda i: xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), seed=42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for b, length in enumerate(bounds):
        ids = sorted((i for i in n if length >= n[i] > (bounds[b - 1] if b else -1)), key=lambda i: signed(order(i)))
        each = max(1, K.BUDGET // max(1, length))
        want = {i: (b, k // each, k % each, n[i] > K.BUDGET) for k, i in enumerate(ids)}
        got = rows[rows.bucket_length == length]
        assert {r.doc_id: (r.bucket, r.batch, r.slot, r.over_budget) for r in got.itertuples()} == want


def test_equal_rows_are_cut_into_slices(spark, make):
    p = K.pack(make([(None, "a b")] * 900 + [(5, f"w {i}") for i in range(300)]), buckets=4, budget=20, slice_rows=50).toPandas()
    assert len(p) == 1200 and not p.duplicated(["bucket", "batch", "slot"]).any()


def test_pack_nothing(spark, make):
    assert K.pack(make([])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 4), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 4: 4, 5: 4, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, threshold=0.8):
    """(doc_id, text) to (links, least id of the group) by counting shared shingles."""
    s = J.Shingler()
    sets = [set(s(t).tolist()) for _, t in rows]
    inv, n, root = defaultdict(list), Counter(), list(range(len(rows)))
    for k, x in enumerate(sets):
        for v in x:
            inv[v].append(k)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, x in enumerate(sets):
        for j, c in Counter(j for v in x for j in inv[v] if j < k).items():
            if c >= threshold * (len(x) + len(sets[j]) - c) - 1e-9:
                n[k] += 1
                n[j] += 1
                root[find(k)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, n[k], least[find(k)]) for k, (i, _) in enumerate(rows))


def near_copies(groups, size, length, edits):
    rows, at = [], 0
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
            rows.append((at, " ".join(w)))
            at += 1
    return rows


def result(df):
    return sorted((r.doc_id, r.n_links, r.class_id) for r in df.collect())


def test_join_against_brute_force(spark, make):
    rows = near_copies(12, 6, 120, 5) + [(1000 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(40)]
    got, want = result(J.join(make(rows))), brute(rows)
    lost = sum(w[1] - g[1] for g, w in zip(got, want, strict=True))
    assert lost <= 0.02 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_blocks_of_a_hot_bucket(spark, make, monkeypatch):
    """Many blocks give what one gives, with no pair lost or counted twice."""
    rows = near_copies(1, 90, 100, 2) + [(500 + i, rows_text) for i, rows_text in enumerate(["a b c d e f"] * 30)]
    monkeypatch.setattr(J, "BLOCK", 16)
    split = result(J.join(make(rows)))
    monkeypatch.setattr(J, "BLOCK", 10**6)
    assert split == result(J.join(make(rows)))
    want = brute(rows)
    assert sum(w[1] for w in want) - sum(g[1] for g in split) <= 0.02 * sum(w[1] for w in want)


def test_copies_case_and_punctuation(spark, make):
    t = "one two three four five six seven eight"
    got = {r.doc_id: (r.n_links, r.class_id, r.n_copies) for r in J.join(make([(3, t), (1, t.upper()), (2, t.replace(" ", ", ")), (9, "other")])).collect()}
    assert got == {1: (2, 1, 3), 2: (2, 1, 3), 3: (2, 1, 3), 9: (0, 9, 1)}


def test_join_odd(spark, make):
    rows = J.join(make(ODD)).collect()
    assert len(rows) == len(ODD) and sum(r.doc_id is None for r in rows) == 2
    assert J.join(make([])).count() == 0
    kept = J.keep_one_stage(spark, make(ODD), None)
    assert kept.columns == make(ODD).columns
    # Id 5 has two texts: both are documents, and only the repeated row goes.
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id IN (5, 8)").collect()) == [(5, "one"), (5, "two words")]
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 5, 6, 7]


def test_keep_one_tells_texts_of_one_id_apart(spark, make):
    """Whatever the shuffle: the copy of a lesser id goes, the distinct text of the same id stays."""
    a, b, c = "a b c d e f g h", "q r s t u v w x", "i j k l m n o p"
    for rows, want in (
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(5, a), (5, b), (7, a), (7, b), (5, a)], [(5, a), (5, b)]),
        ([(5, a), (5, a.upper()), (9, c)], None),
    ):
        got = sorted((r.doc_id, r.text) for r in J.keep_one_stage(spark, make(rows), None).collect())
        assert got == want if want else [g[0] for g in got] == [5, 9]


def test_low_thresholds_reach_the_recall_too():
    b, r = J.choose_bands(0.01, 0.99)
    assert r == 1 and 1 - (1 - 0.01) ** b >= 0.99
    for bad in ((0, 0.9), (1.1, 0.9), (0.8, 1)):
        with pytest.raises(ValueError):
            J.choose_bands(*bad)


def test_bands_reach_the_recall():
    for t in (0.5, 0.7, 0.8, 0.9):
        b, r = J.choose_bands(t, 0.99)
        assert b * r <= J.PERMUTATIONS and (1 - (1 - t**r) ** b >= 0.99 or r == 1)


def test_signatures_estimate_similarity():
    h = J._permutations(4000)
    base = np.unique(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64))
    a, b = base[:250], base[50:]
    x, y = (np.array(J.band_hashes(s, 4000, 1, h)) for s in (a, b))
    assert abs((x == y).mean() - 200 / 300) < 0.05


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(J.op8_ngram_join(spark, sf)) == brute(rows)
    assert F is not None


def test_fingerprints_of_large_buckets(spark):
    """Two equal buckets of 200,000 hashes are one and the third stays, under ANSI arithmetic, whatever the hashes."""
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    nodes = spark.range(200_000).select((F.lit((1 << 63) - 1) - F.col("id")).alias("node"))
    third = nodes.withColumn("node", F.when(F.col("node") == (1 << 63) - 1, 5).otherwise(F.col("node")))
    spread = nodes.withColumn("bucket", F.explode(F.array(F.lit(1), F.lit(2)))).unionAll(third.withColumn("bucket", F.lit(3))).unionAll(spark.range(1).selectExpr("id", "4"))
    assert sorted(map(tuple, J.distinct_buckets(spread).collect())) == [(1, 200_000), (3, 200_000)]


def test_runs_of_texts_cover_all_rows_in_order():
    for sizes in ([], [0], [9], [3, 3, 3, 3], [1, 50, 1, 0, 0, 7], [10, 10, 1, 9, 11]):
        texts = ["x" * n for n in sizes]
        spans = K._spans(texts, 10)
        assert [i for lo, hi in spans for i in range(lo, hi)] == list(range(len(texts)))
        assert all(hi > lo and (sum(sizes[lo:hi]) <= 10 or hi - lo == 1) for lo, hi in spans)


def test_batches_for_python_are_bounded_by_bytes(spark, make):
    long = "word " * 300_000
    docs = make([(i, long) for i in range(8)] + [(i, "short") for i in range(8, 40)]).coalesce(1)
    sizes = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    counts = [r.n for r in batched(docs.select("doc_id", "text")).mapInPandas(sizes, "n int").collect()]
    assert sum(counts) == 40 and counts[0] < 8
