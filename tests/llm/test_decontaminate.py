import random

import numpy as np
from pyspark.sql import functions as F

from foldlake.llm import decontaminate as D
from tests.llm.conftest import ODD

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_against_the_full_table():
    for _ in range(150):
        p, t = ("".join(rng.choice("ab c") for _ in range(rng.randint(lo, 20))) for lo in (1, 0))
        codes = D._codes(t + "?")
        edits, stops = D.banded_alignments([D._codes(p)], codes, np.array([-len(p)]), len(p) + len(t) + 1, np.array([0]), np.array([len(t)]))
        assert edits[0] == least_edits(p, t)
        assert min(least_edits(p, t[k : stops[0]]) if True else 0 for k in range(stops[0] + 1)) == edits[0]


def test_lemma_keeps_every_match_in_budget():
    items = [(i, prose(rng.randint(3, 60))) for i in range(20)]
    m = D.Matcher(items)
    for _ in range(150):
        k = rng.randrange(len(m.patterns))
        p = m.patterns[k]
        t = list(p.text)
        for _ in range(p.budget):
            at, what = rng.randrange(len(t)), rng.choice("sid")
            if what == "d" and len(t) > 1:
                del t[at]
            elif what == "i":
                t.insert(at, "z")
            else:
                t[at] = "z"
        before = prose(rng.randint(0, 50))
        text = f"{before} {''.join(t)} {prose(10)}".strip()
        hits = m.search([prose(8), text, ""])
        assert any(i == p.item and e <= p.budget for i, _, _, e in hits[1])


def test_clean_texts_stay_clean():
    m = D.Matcher([(i, prose(50)) for i in range(30)])
    assert not any(m.search([D.normal(prose(rng.randint(1, 400))) for _ in range(200)]))
    assert not any(m.search(["the " * 5000, "a" * 20000]))


def test_exact_spans_across_a_batch():
    item = prose(60)
    texts = [D.normal(prose(30)), D.normal(f"{prose(5)} {item} {prose(5)}"), D.normal(item), ""]
    found = D.Matcher([(9, item)]).search(texts)
    assert not found[0] and not found[3]
    for t, f in zip(texts[1:3], found[1:3], strict=True):
        assert min(a for _, a, _, _ in f) == t.find(D.normal(item)) and max(b for _, _, b, _ in f) == t.find(D.normal(item)) + len(D.normal(item))


def test_short_items_must_stand_alone():
    m = D.Matcher([(1, "Go on!"), (2, None or ""), (3, "!!")])
    found = m.search([D.normal("well, GO ON then"), D.normal("gogo on"), D.normal("go one")])
    assert [bool(f) for f in found] == [True, False, False]


def test_operator_and_blocks(spark, make):
    item = prose(40)
    docs = make([*ODD, (20, f"{prose(9)}\n{item.upper()}, {prose(9)}"), (21, prose(99)), (20, item)])
    bench = spark.createDataFrame([(1, None), (2, ""), (3, item), (4, prose(30)), (3, item)], "item_id long, text string")
    rows = D.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in rows] == [(20, 3, 0)]
    assert [sum(len(t) for _, t in b) for b in D.blocks(bench, 100)]
    split = [r for b in D.blocks(bench, 10) for r in b]
    assert len(split) == 5
    assert D.contaminated(docs, bench.filter("false")).count() == 0
    assert D.contaminated(make([]), bench).count() == 0


def test_query_finds_contained_items(spark):
    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if D.normal(i.text) in D.normal(d.text)}
    rows = D.op6_decontamination(spark, sf)
    got = {(r.doc_id, r.item_id) for r in rows.collect()}
    assert want and want <= got and len(got - want) <= 0.05 * len(want) and rows.count() == len(got)
    plan = D.op6_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    kept = D.filter_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d.doc_id for d in docs} - {d for d, _ in got}
    assert kept.filter(F.col("text").isNull()).count() == 0


def test_verbatim_passages_at_every_offset():
    """Any passage of PASSAGE characters is found, wherever it starts in the item and in the document."""
    item = D.normal(prose(120))
    m = D.Matcher([(1, prose(80)), (7, item), (9, item[:200])])
    for at in range(len(item) - D.PASSAGE + 1):
        passage = item[at : at + D.PASSAGE]
        if passage != passage.strip():
            continue
        text = D.normal(f"{prose(rng.randint(0, 40))} {passage} {prose(9)}")
        assert any(i == 7 and e == 0 for i, _, _, e in m.search([prose(20), text])[1]), at
