import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from foldlake import predicate as P
from foldlake.errors import EngineError
from foldlake.operators import export, maintenance, stats
from foldlake.predicate import Q

DOCS = [
    {"_id": "a", "s": "it's", "n": 1, "f": 1.5, "b": True, "o": {"k": {"d": 2}}, "m": 1},
    {"_id": "b", "s": "x", "n": 2, "f": 2, "b": False, "o": {"k": "z"}, "m": "one"},
    {"_id": "c", "s": "", "n": -3, "o": [1], "big": 3000000000},
]


@pytest.fixture(scope="module")
def view(spark):
    return spark.createDataFrame([(d["_id"], json.dumps(d)) for d in DOCS], "_id string, t string").select("_id", F.parse_json("t").alias("body")).cache()


def test_inference(view):
    plan = export.infer(view)
    assert [(c.name, c.sql_type, c.nullable) for c in plan.columns] == [
        ("_id", "text", False), ("b", "boolean", True), ("big", "double precision", True), ("f", "double precision", True),
        ("m", "text", True), ("n", "integer", False), ("o", "jsonb", False), ("s", "text", False),
    ]
    assert export.plan_from_json(export.plan_to_json(plan)) == plan
    for bad in ("{}", '{"version": 2}', "x"):
        with pytest.raises(EngineError):
            export.plan_from_json(bad)


def test_round_trip_through_sqlite(view):
    plan = export.infer(view, "sqlite", 'do"cs')
    db = sqlite3.connect(":memory:")
    db.execute(export.create_table(plan))
    for r in export.insert_statements(view, plan).collect():
        db.execute(r.statement)
    rows = {r[0]: r for r in db.execute('SELECT _id, s, n, f, b, o FROM "do""cs"')}
    assert rows["a"] == ("a", "it's", 1, 1.5, 1, '{"k":{"d":2}}') and rows["c"][3] is None
    for q in (Q().eq("s", "x"), Q().gt("n", 0), Q().in_("n", [1, -3, "q"]), Q().eq("b", True), Q().eq("o.k", "z"), Q().eq("o.k.d", 2), Q().gte("o.k.d", 3), Q().eq("zz", 1), Q().eq("o", {"k": "z"}), Q().eq("n", "1")):
        sql, hints = export.where_sql(q.clauses, plan)
        got = {r[0] for r in db.execute(f'SELECT _id FROM "do""cs" WHERE {sql}')}
        assert got == {d["_id"] for d in DOCS if P.matches(d, q.clauses)}, (q.clauses, sql)
        assert bool(hints) == ("1 = 0" in sql)


def test_quoting():
    assert export.quote_name('a"b') == '"a""b"' and export.literal("it's", "sqlite") == "'it''s'"
    assert export.literal(True, "postgres") == "TRUE" and export.literal(True, "sqlite") == "1" and export.literal(None, "d1") == "NULL"
    for bad in (lambda: export.quote_name("a\0"), lambda: export.literal(float("inf"), "sqlite"), lambda: export.literal("\0", "sqlite")):
        with pytest.raises(EngineError):
            bad()


def test_gc(spark):
    name = lambda a, b, c: f"x/snapshot/L9/{a:012d}-{b:012d}-{c * 64}.json"
    now = F.lit(100).cast("timestamp")
    rows = [(name(0, 5, "a"), 50, "g"), (name(0, 9, "b"), 150, "g"), (name(0, 50, "c"), 50, "g"), (name(1, 2, "d"), 50, "old"), ("junk", 50, "g"), (name(2, 3, "e"), 50, None), (name(3, 4, "f"), 50, "g")]
    ledger = spark.createDataFrame(rows, "key string, due long, generation string").select("key", F.col("due").cast("timestamp").alias("due_at"), "generation")
    c = maintenance.classify_candidates(ledger, "g", name(3, 4, "f"), 20, now)
    assert {r.key[14:40] if r.key != "junk" else r.key: r.verdict for r in c.collect()}
    assert {r.key: r.verdict for r in c.collect()} == {name(0, 5, "a"): "sweep", name(0, 9, "b"): "wait", name(0, 50, "c"): "blocked", name(1, 2, "d"): "drop", "junk": "evict", name(2, 3, "e"): "evict", name(3, 4, "f"): "rescue"}
    due, stays = maintenance.sweep(c, 1)
    assert [r.key for r in due.collect()] == [name(0, 5, "a")] and stays.count() == 2
    merged = maintenance.merge_ledger(ledger, ledger.limit(2).unionByName(ledger.limit(1).withColumn("key", F.lit("new"))), 3)
    assert merged.count() == 3


def test_retention_and_usage(spark):
    assert maintenance.retention_range(0, 2000) == (0, 20)
    assert maintenance.retention_range(0, 1000) == (0, 0)
    assert maintenance.retention_range(970, 2000) == (970, 976)
    log = spark.createDataFrame([("c", i, i) for i in range(200)] + [("d", 0, 0)], "collection string, seq long, s long").select("collection", "seq", F.col("s").cast("timestamp").alias("commit_ts"))
    got = {r.collection: (r.entries, r.writes_per_minute and round(r.writes_per_minute, 3), r.severity) for r in maintenance.usage(log).collect()}
    assert got == {"c": (120, 60.0, "error"), "d": (1, None, "info")}  # one entry gives no estimate


def test_sessions(spark):
    w = spark.createDataFrame([("s", 1, 10)], "session string, write_no int, seq int")
    r = spark.createDataFrame([("s", 1, 1, 9), ("s", 2, 1, 11)], "session string, read_no int, after_write int, seq int")
    assert [x.read_no for x in maintenance.missed_own_writes(w, r).collect()] == [1]
    m = spark.createDataFrame([("s", 1, 5), ("s", 2, 4), ("s", 3, 5)], "session string, read_no int, seq int")
    assert [x.read_no for x in maintenance.monotonic_violations(m).collect()] == [2]


def test_statistics():
    assert stats.quantile7([1, 2, 3, 4], 0.5) == 2.5
    assert stats.wilson_upper(0, 10) == pytest.approx(0.21296, abs=1e-4)
    assert stats.zero_failure_upper(59) == pytest.approx(0.0495, abs=1e-3)
    rng = stats.Mulberry32(1)
    assert rng.random() == pytest.approx(0.6270739405881613)
    low, high = stats.bootstrap_interval(list(range(50)), rounds=200)
    assert low <= 24.5 <= high
    assert stats.paired_ratio_interval([2, 4, 6], [1, 2, 3], rounds=50) == (2.0, 2.0)
    assert stats.stratified_difference_interval([[(2, 1), (3, 2)], [(5, 4)]], rounds=20) == (1.0, 1.0)
    assert stats.weighted_pick({"a": 1, "b": 3}, 0.3) == "b" and stats.zipf_index(10, 1.0, 0.0) == 0
    assert 1 <= stats.power_law(1, 10, 2.0, 0.5) <= 10


def test_ols(spark):
    df = spark.createDataFrame([(float(a), float(b), 3 + 2.0 * a - b) for a in range(5) for b in range(4)], "a double, b double, y double")
    beta, rss = stats.ols(df, "y", ["a", "b"])
    assert beta == pytest.approx([3, 2, -1]) and rss == pytest.approx(0, abs=1e-9)


def test_generators_keep_their_range():
    """Values by hand: the first name whose running weight reaches the draw; the inverted law, cut to the range."""
    assert stats.weighted_pick({"a": 1, "b": 3}, 0.25) == "a" and stats.weighted_pick({"a": 1, "b": 3}, 0.2500001) == "b"
    assert stats.weighted_pick({"a": 0, "b": 1}, 0.0) == "a"
    assert [stats.zipf_index(10, 2.0, u) for u in (0.0, 0.5, 0.75, 0.9999)] == [0, 1, 3, 9]
    assert stats.zipf_index(5, 1.2, 0.999999) == 4 and stats.zipf_index(5, 1.0, 0.5) == 4
    assert stats.power_law(1, 10, 2.0, 0.0) == 1 and stats.power_law(1, 10, 2.0, 1.0) == 10


@pytest.mark.parametrize("accuracy, slack", [(stats.ACCURACY, stats.SLACK), (1, 0.0)])  # the second sketch misses
def test_quantiles_against_sorting(spark, monkeypatch, accuracy, slack):
    import math
    import random

    import numpy as np

    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    monkeypatch.setattr(stats, "SLACK", slack)
    rng = random.Random(1)
    draw = {"even": lambda: rng.randrange(10**9) / 100, "tied": lambda: rng.choice([1.0, 2.0, 2.0, 2.0, rng.random() + 2]), None: lambda: rng.lognormvariate(0, 20) - 1, "one": lambda: 7.0}
    data = {g: [f() for _ in range({"one": 1}.get(g, 3_001 if g else 2_000))] for g, f in draw.items()}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    wanted = {"a": ("rank", 0.9), "b": ("r7", 0.9), "c": ("rank", 0.0), "d": ("r7", 0.5), "e": ("rank", 0.07)}
    got = {r.g: r[1:] for r in stats.quantiles(df, "x", wanted, ["g"]).collect()}
    rank = lambda vs, q: vs[max(1, -(-len(vs) * q // 100)) - 1]
    assert got.pop("none") == (None,) * 5
    for g, vs in data.items():
        vs = sorted(vs)
        want = (rank(vs, 90), float(np.quantile(vs, 0.9)), vs[0], float(np.median(vs)), rank(vs, 7))
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got.pop(g), want, strict=True))
    assert got == {}
    deviations = {r.g: (r.median, r.mad) for r in stats.mad(df, "x", ["g"]).collect()}
    for g, vs in data.items():
        assert math.isclose(deviations[g][1], float(np.median(np.abs(np.array(vs) - np.median(vs)))), rel_tol=1e-12)
    assert deviations["none"] == (None, None)


def test_no_task_holds_all_values(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit("k").alias("k"))
    out = stats.mad(df, "x")
    for plan in (out, maintenance.op_rollup(df, "k", "x")):
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "percentile(" not in text and "percentiledisc(" not in text.lower().replace("_", "")
    assert out.collect() == [(4.5, 2.5)] and stats.mad(df.limit(0), "x").collect() == []
    assert stats.mad(df.select(F.lit(None).cast("double").alias("x")), "x").collect() == [(None, None)]
