import random

import numpy as np

from foldlake.llm import toxicity as T
from tests.llm.conftest import ODD

rng = random.Random(5)
NEUTRAL = ["the market opened", "a quiet river", "we walk to school", "bread and water", "the long road home", "music played late"]
RUDE = ["idiots", "scumbag", "moronic", "loserish"]


def corpus(n, biased):
    texts, labels = [], []
    for i in range(n):
        bad = i % 2
        words = " ".join(rng.sample(NEUTRAL, 3))
        if bad:
            words += " " + rng.choice(RUDE)
        if biased and (bad or rng.random() < 0.05):
            words = "the muslim " + words
        texts.append(words + ".")
        labels.append(bad)
    return texts, labels


def test_learns_words_and_affixes():
    m = T.fit(*corpus(300, False))
    s = m.score(["bread and water", "you loserish thing", "moronicest", "", None])
    assert s[0] < 0.5 < s[1] and s[2] > 0.5 and 0 < s[3] == s[4] < 1


def test_counterfactuals_take_weight_off_group_mentions():
    texts, labels = corpus(400, True)
    plain, fair = T.fit(texts, labels, fairness=0.0), T.fit(texts, labels, fairness=20.0)
    neutral = ["the muslim bread and water", "the christian bread and water"]
    gap = lambda m: abs(np.subtract(*m.score(neutral)))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.score(["the christian scumbag"])[0] > 0.5


def test_swaps():
    pairs = T.counterfactuals("The boy left. Nothing here.")
    assert {b[1] for _, b in pairs} == {"woman", "man", "girl"} and all(a == ["the", "boy", "left"] for a, _ in pairs)
    assert not any({"women", "femmes"} <= set(g) for g in T.IDENTITY_TERMS)  # a term is swapped within its language
    assert T.counterfactuals(None) == []


def test_one_label_or_none():
    assert T.fit([], []).score(["x"])[0] == 0.5
    assert T.fit(["a", "b"], [1, 1]).score(["x"])[0] > 0.99


def test_scores_odd_rows(spark, make):
    docs = make(ODD)
    out = T.score(docs, T.fit(*corpus(60, False)))
    assert out.count() == len(ODD) and out.columns == [*docs.columns, "_score"]
    assert all(0 <= r._score <= 1 for r in out.collect())
    assert T.score(make([]), T.fit([], [])).count() == 0


def test_never_trains_on_held_out_rows(spark, make):
    from zlib import crc32

    docs = make([(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.text for r in T.labelled_sample(docs, labels, "toxic", 5, 0, 1000).collect()}
    assert got == {f"text {i}" for i in range(200) if crc32(str(i).encode()) % 5}
    assert T.labelled_sample(docs, labels, "toxic", 5, 0, 7).count() == 14


def test_held_out_accuracy(spark):
    rows = T.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((rows.score >= 0.5).astype(int) == rows.toxic).mean() > 0.9
    assert (rows.predicted == (rows.score >= 0.5)).all()


def test_fit_swaps_with_every_other_term(monkeypatch):
    seen, real = set(), T._difference
    monkeypatch.setattr(T, "_difference", lambda a, b, dims: seen.add(b[1]) or real(a, b, dims))
    T.fit(["The hindu left.", "Nothing here."], [1, 0])
    assert seen == set(T.IDENTITY_TERMS[5]) - {"hindu"}


def test_production_weight_takes_weight_off_group_mentions():
    texts, labels = corpus(400, True)
    neutral = ["the muslim bread and water", "the christian bread and water"]
    gap = lambda m: abs(np.subtract(*m.score(neutral)))
    print(gap(T.fit(texts, labels, fairness=0.0)), gap(T.fit(texts, labels)))
    assert gap(T.fit(texts, labels)) < 0.5 * gap(T.fit(texts, labels, fairness=0.0))


def test_fewer_false_positives_on_neutral_mentions():
    """Held-out neutral sentences that mention a group: the production penalty takes nearly all false positives away and keeps rude ones."""
    texts, labels = corpus(600, True)
    groups = T.IDENTITY_TERMS[5]
    neutral = [f"the {g} {' '.join(rng.sample(NEUTRAL, 3))}." for g in groups for _ in range(40)]
    rude = [f"the {g} {' '.join(rng.sample(NEUTRAL, 3))} {rng.choice(RUDE)}." for g in groups for _ in range(40)]
    plain, fair = T.fit(texts, labels, fairness=0.0), T.fit(texts, labels)
    false = lambda m: float((m.score(neutral[:40]) >= 0.5).mean())
    assert (fair.score(rude) >= 0.5).mean() > 0.95
    assert (fair.score(neutral) >= 0.5).mean() < 0.05
    change = lambda m: float(np.abs(m.score([x.replace("muslim", "hindu") for x in neutral[:40]]) - m.score(neutral[:40])).mean())
    assert change(fair) < 0.5 * change(plain) and false(fair) <= false(plain)


def test_fit_from_executors_is_the_fit_from_texts(spark, make):
    texts, labels = corpus(120, True)
    docs = make(list(enumerate(texts)))
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = T.train(docs, marks)
    rows = [(r.text, r.y) for r in T.labelled_sample(docs, marks, "toxic", 5, 0, T.MAX_ROWS).collect()]
    want = T.fit(*zip(*rows, strict=True))
    assert np.allclose(got.score(texts), want.score(texts), atol=1e-4)
    assert np.array_equal(got.weights, T.train(docs.repartition(5), marks).weights)


def test_rows_of_one_id_do_not_pass_the_bound(spark, make):
    docs = make([(1, f"text {i}") for i in range(500)] + [(2, "other")])
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    a = sorted(map(tuple, T.labelled_sample(docs, marks, "toxic", 5, 9, 20).collect()))
    assert len(a) == 21 and a == sorted(map(tuple, T.labelled_sample(docs.repartition(9), marks, "toxic", 5, 9, 20).collect()))
