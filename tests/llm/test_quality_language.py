import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm import language as L
from foldlake.llm import quality as Y
from tests.llm.conftest import ODD


def test_statistics_of_odd_texts():
    for _, t in ODD:
        s = Y.statistics(t)
        assert len(s) == Y.STATS and np.isfinite(s).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, Y.STATS)) * 0.5
    w = Y.random_features(count=4000)
    z = Y.fourier(x, np.zeros(Y.STATS), np.ones(Y.STATS), w)[:, :4000]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 3.0**2))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.normal(size=12), rng.integers(0, 2, 12)
        knots, values = Y.isotonic(x, y)
        assert (np.diff(values) > 0).all() or len(values) == 1
        fit = np.array([values[np.abs(knots - v).argmin()] for v in sorted(x)])
        # Isotonic least squares by the max-min formula.
        s = y[np.argsort(x, kind="stable")].astype(float)
        want = [max(min(s[a : b + 1].mean() for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        got = np.repeat(values, [sum(1 for w in want if abs(w - v) < 1e-9) for v in values])
        assert np.allclose(got, want) and len(fit) == 12


def test_quality_accuracy_and_folds(spark):
    from zlib import crc32

    rows = Y.op3_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert (rows.held_out == [crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and rows.score.between(0, 1).all()


def test_quality_odd(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    m = Y.train(make(ODD), labels)
    assert Y.score(make(ODD), m).count() == len(ODD) and Y.score(make([]), m).count() == 0


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    e, t, s = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 2])
    prob, pairs = L.forward_backward(e, lengths, t, s)
    total = np.zeros((3, 3))
    for k, n in enumerate(lengths):
        z, p, q = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(s[y[0]] + sum(e[k, i, y[i]] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            z += w
            for i in range(n):
                p[i, y[i]] += w
            for a, b in zip(y, y[1:], strict=False):
                q[a, b] += w
        assert np.allclose(prob[k, :n], p / z)
        total += q / z
    assert np.allclose(pairs, total)


EN = ["the cat sat on the mat and then the dog ran with the ball", "this is the thing that they were with and from there", "what the house has is for them and that other one"] * 6
FR = ["le chat est sur la table avec les enfants dans une maison", "nous sommes pour une raison que les autres ont avec elle", "dans la ville il est un homme qui parle avec une femme"] * 6


@pytest.fixture(scope="module")
def model():
    return L.fit(EN + FR, ["en"] * len(EN) + ["fr"] * len(FR), sequences=600)


def test_code_switched_words(model):
    words = L.Labeller(model).words("the dog is with the house avec les enfants dans la maison")
    assert [w[1] for w in words] == ["en"] * 6 + ["fr"] * 6
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]


def test_language_odd(spark, make, model):
    docs = make(ODD)
    rows = L.predict(docs, model).collect()
    assert len(rows) == len(ODD)
    langs, scores = L.Labeller(model).documents([t for _, t in ODD])
    for (_, t), lang, score in zip(ODD, langs, scores, strict=True):
        assert (lang == "und") == (not any(ch.isalpha() for ch in t or "")) and 0 <= score <= 1
    assert L.predict(docs, None).filter("lang_pred = 'und'").count() == len(ODD)
    assert L.train(docs.withColumn("lang", docs.lang.substr(9, 1).cast("string")).filter("false")) is None
    assert L.predict(make([]), model).count() == 0


def test_groups_do_not_change_labels(model):
    texts = EN[:3] + FR[:3] + ["the", ""] + [EN[0] * 30]
    together = L.Labeller(model).documents(texts)
    alone = [L.Labeller(model).documents([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)


def test_language_accuracy(spark):
    rows = L.op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97


def test_every_language_is_learned(spark, make):
    """70 languages, each of its own letters; none is left out and repeated rows count once."""
    import itertools as it

    pairs = ["".join(p) for p in it.combinations("abcdefghijkmno", 2)][:70]
    word = lambda i, k: "".join(pairs[i][b] for b in map(int, format(k % 30 + 2, "b")))
    rows = [(100 * i + k, " ".join(word(i, 7 * k + j) for j in range(12))) for i in range(70) for k in range(1, 9)]
    docs = make(rows + rows[:50]).withColumn("lang", F.concat(F.lit("l"), F.floor(F.col("doc_id") / 100)))
    got = L.sample(docs, max_docs=6).collect()
    assert len({r.lang for r in got}) == 70 and len(got) == len({(r.lang, r.text) for r in got}) <= 6 * 70
    assert sorted(map(tuple, got)) == sorted(map(tuple, L.sample(docs.repartition(7), max_docs=6).collect()))
    assert len(L.sample(docs, max_docs=6, max_rows=10).collect()) == 70
    model = L.train(docs, max_docs=6)
    assert len(model.labels) == 70
    langs, _ = L.Labeller(model).documents([t for _, t in rows])
    assert np.mean([x == f"l{i // 100}" for x, (i, _) in zip(langs, rows, strict=True)]) > 0.8


def test_sample_never_has_a_held_out_row(spark, make):
    from zlib import crc32

    docs = make([(i, f"text {i}") for i in range(200)] + [(None, "none")])
    assert {r.text for r in L.sample(docs, 1000).collect()} == {f"text {i}" for i in range(200) if crc32(str(i).encode()) % 5}
