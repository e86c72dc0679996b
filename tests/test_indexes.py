import itertools

import pytest

from foldlake.errors import EngineError
from foldlake.functions import codecs
from foldlake.operators import indexes
from foldlake.operators.indexes import Index, choose_plan
from foldlake.predicate import Clause, Q

A, AB = Index("a", ("a",)), Index("ab", ("a", "b"))
SPARSE = Index("sparse", ("a",), (Clause("eq", "s", "x"),))


@pytest.mark.parametrize(
    "q, ixs, want",
    [
        (Q(), (A,), "no-predicate"),
        (Q().eq("a", 1), (), "no-indexes-declared"),
        (Q().eq("z", 1), (A,), "no-matching-index"),
        (Q().eq("a", 1), (A, AB), "a"),
        (Q().eq("a", 1).gt("b", 2), (A, AB), "ab"),
        (Q().eq("a", 1).eq("s", "x"), (AB, SPARSE), "sparse"),
        (Q().eq("a", 1), (SPARSE,), "no-matching-index"),
        (Q().gt("b", 1), (AB,), "no-matching-index"),
        (Q().in_("a", list(range(51))), (A,), "no-matching-index"),
        (Q().in_("a", list(range(50))), (A,), "a"),
        (Q().eq("a", 1).in_("a", [1]), (A,), "predicate-uses-operators-only"),
        (Q().eq("a", {"k": 1}), (A,), "no-matching-index"),
    ],
)
def test_plans(q, ixs, want):
    plan = choose_plan(q.clauses, ixs)
    assert want in (plan.index, plan.reason)


def test_key_order():
    values = [None, False, True, -1e300, -2.5, -1, 0, 0.5, 1, 9, 10, 1e300, "", "a", "aa", "b", "é", "😀"]
    keys = [codecs.index_key(v) for v in values]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert codecs.index_key(-0.0) == codecs.index_key(0)
    assert codecs.index_key("5") != codecs.index_key(5)
    with pytest.raises(EngineError):
        codecs.index_key(float("nan"))


def test_walks_never_change_results(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product([None, -3.0, 0.0, 2.0, 10.0], ["", "a", "ab", "b", None]))]
    df = spark.createDataFrame(rows, "_id long, a double, b string")
    entries = indexes.project(df, AB).cache()
    for q in (Q().eq("a", 2), Q().gt("a", -3), Q().gte("a", 0).lt("a", 10), Q().in_("a", [2, 10]), Q().eq("a", 2).gte("b", "a"), Q().eq("a", 2).lte("b", "ab"), Q().lte("a", 0), Q().eq("a", 0).eq("b", "ab"), Q().eq("a", 0).in_("b", ["", "b"])):
        plan = choose_plan(q.clauses, (AB,))
        assert plan.kind == "walk"
        got = {r._id for r in indexes.fetch(df, indexes.walk(entries, plan), q.clauses).collect()}
        from foldlake.functions import columns

        # Rows without an index entry (a missing value) are those the walk may not see.
        want = {r._id for r in df.filter(columns.typed(df.schema, q.clauses)).filter("a IS NOT NULL AND b IS NOT NULL").collect()}
        assert got == want, q.clauses


def test_projection_errors_and_drift(spark):
    df = spark.createDataFrame([(1, [1])], "_id long, a array<int>")
    with pytest.raises(EngineError):
        indexes.project(df, A)
    with pytest.raises(EngineError):
        Index("x", ("a.b",))
    e = spark.createDataFrame([("k1", "1"), ("k2", "2")], "key string, doc_id string")
    a = spark.createDataFrame([("k2", "2"), ("k3", "3")], "key string, doc_id string")
    assert indexes.drift_counts(e, a).first() == (1, 1, 1)
    report, after = indexes.rebuild(a, e, dry_run=False)
    assert {r.key for r in after.collect()} == {"k1", "k2"}


def test_lsn_and_cursor():
    name = codecs.lsn(1_700_000_000_000, "abc123", 42)
    assert codecs.parse_lsn(name) == (1_700_000_000_000, "abc123", 42)
    assert codecs.lsn(5, "abc123", 2) < codecs.lsn(5, "abc123", 1) < codecs.lsn(4, "abc123", 1)
    assert codecs.base32(2**53 - 1, 11) == "7vvvvvvvvvv"
    assert codecs.parse_cursor(codecs.cursor("g", name)) == ("g", 42)
    assert codecs.parse_cursor("") == (None, None) and codecs.parse_cursor("g.-") == ("g", None) and codecs.parse_cursor(name) == (None, 42)
    with pytest.raises(EngineError):
        codecs.parse_cursor("g.bad")
    assert codecs.uuid7()[14] == "7"


def test_canonical_json():
    assert codecs.canonical({"b": 1.0, "a": [1e21, 0.000001, 1e-7, 1.5, True, None, "é"]}) == '{"a":[1e+21,0.000001,1e-7,1.5,true,null,"é"],"b":1}'


def test_fnv():
    assert codecs.fnv1a64(b"") == 0xCBF29CE484222325 and codecs.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
