import json

import pytest
from pyspark.sql import functions as F

from foldlake import predicate as P
from foldlake.errors import EngineError
from foldlake.functions import columns
from foldlake.operators.query import Query, from_request

ROWS = [
    {"_id": "01", "s": "open", "n": 5, "b": True, "o": {"team": "x", "lvl": 1}, "arr": [1, 2]},
    {"_id": "02", "s": "open", "n": "5", "b": "true", "o": {"team": "x"}},
    {"_id": "03", "s": None, "n": 5.0, "o": [{"team": "x"}]},
    {"_id": "04", "n": -0.0, "o": {"team": {"deep": 1}}},
    {"_id": "05", "s": "\uffee", "n": 1e300},
    {"_id": "06", "s": "😀", "a.b": 1, "a": {"b": 2}},
    {"_id": "07", "s": 5},
]


@pytest.fixture(scope="module")
def view(spark):
    df = spark.createDataFrame([(r["_id"], json.dumps(r)) for r in ROWS], "_id string, text string")
    return df.select("_id", F.parse_json("text").alias("body")).cache()


CASES = [
    (lambda q: q.eq("n", 5), "01 03"),
    (lambda q: q.gte("n", 5), "01 03 05"),
    (lambda q: q.gte("s", "a"), "01 02 05 06"),
    (lambda q: q.eq("o.team", "x"), "01 02"),
    ({"o": {}}, "01 02 03 04 05 06 07"),
    (lambda q: q.eq("o", {"team": "x"}), "01 02"),
    (lambda q: q.eq("a.b", 2), "06"),
    (lambda q: q.eq("b", True), "01"),
    (lambda q: q.eq("n", 0), "04"),
    (lambda q: q.in_("n", ["5", 5, True]), "01 02 03"),
    (lambda q: q.in_("b", [True, "true"]), "01 02"),
    (lambda q: q.eq("arr", 1), ""),
    (lambda q: q.lt("n", 5).gte("n", -1), "04"),
    (lambda q: q.eq("o.team.deep", 1), "04"),
]


@pytest.mark.parametrize("where, ids", CASES)
def test_variant_predicates(view, where, ids):
    got = [r._id for r in Query(view, "_id", "body").where(where).all().orderBy("_id").collect()]
    assert got == ids.split()
    clauses = P.normalise(where)
    assert got == [r["_id"] for r in ROWS if P.matches(r, clauses)]


def test_string_orders(view):
    above = lambda utf16: [r._id for r in Query(view, "_id", "body", utf16=utf16).where(lambda q: q.gt("s", "\uffee")).all().collect()]
    assert above(False) == ["06"]
    assert above(True) == []


def test_order_missing(view):
    rows = view.filter("_id NOT IN ('03', '07')")
    asc = [r._id for r in Query(rows, "_id", "body").order({"s": "asc"}).all().collect()]
    desc = [r._id for r in Query(rows, "_id", "body").order({"s": "desc"}).all().collect()]
    assert asc[0] == "04" and desc[-1] == "04"


def test_typed_missing_and_kinds(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "5", 5.0), (3, None, 7.0)], "k int, s string, x double")
    ids = lambda w: sorted(r.k for r in Query(df, "k").where(w).all().collect())
    assert ids(lambda q: q.eq("s", 5)) == []
    assert ids(lambda q: q.eq("s", "5")) == [2]
    assert ids(lambda q: q.gt("x", 4)) == [2, 3]
    assert ids(lambda q: q.eq("nothing", 1)) == []
    assert ids({}) == [1, 2, 3]
    assert Query(df, "k").where({"s": "a"}).limit(0).count() == 0


def test_typed_struct(spark):
    df = spark.createDataFrame([(1, ("x", 1)), (2, ("y", 1)), (3, None)], "k int, o struct<team:string,lvl:int>")
    ids = lambda w: sorted(r.k for r in Query(df, "k").where(w).all().collect())
    assert ids(lambda q: q.eq("o.team", "x")) == [1]
    assert ids(lambda q: q.eq("o", {"lvl": 1})) == [1, 2]
    assert ids(lambda q: q.eq("o", {})) == [1, 2]


def test_last_limit_and_order_count(view):
    q = Query(view, "_id", "body").limit(3).limit(2)
    assert q.count() == 2
    assert q.order({"n": "asc"}).order({"s": "asc"}).order_spec == (("s", "asc"),)


@pytest.mark.parametrize("bad", [{"limit": "-1"}, {"where": "{"}, {"where": '{"_id": "1"}'}])
def test_request_errors(view, bad):
    with pytest.raises(EngineError):
        from_request(view, bad, "_id", "body")


def test_pushdown(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = Query(df, "o_orderkey").where(lambda q: q.eq("o_orderstatus", "F").gt("o_totalprice", 10)).all()._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice,10" in plan
