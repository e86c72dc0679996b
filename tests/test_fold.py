import random

import pytest
from pyspark.sql import functions as F

from foldlake.operators import fold, snapshots

SCHEMA = "collection string, seq long, op string, doc_id string, after int"
FIXTURE = [("c", 0, "I", "a", 1), ("c", 1, "I", "b", 2), ("c", 2, "U", "a", 3), ("c", 3, "D", "b", None), ("c", 4, "U", "c", None), ("c", 5, "I", "b", 9), ("c", 6, "D", "d", None), ("x", 7, "I", "z", 1), ("c", 8, "U", None, 4)]


def view(df):
    return {r._id: r.body for r in df.collect()}


def test_fixture_at_every_cut(spark):
    log = spark.createDataFrame(FIXTURE, SCHEMA)
    for cut in range(0, 10, 3):
        base = fold.compact(log, None, cut, collection="c")
        assert view(fold.fold(log, base, "c", since=cut)) == {"a": 3, "b": 9}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_log_against_a_dict(spark, seed):
    rng, model, rows = random.Random(seed), {}, []
    for seq in range(200):
        i, op, v = rng.choice("abcd"), rng.choice("IUD"), rng.randint(0, 99)
        rows.append(("c", seq, op, i, None if op == "D" else v))
        if op == "D":
            model.pop(i, None)
        else:
            model[i] = v
    assert view(fold.fold(spark.createDataFrame(rows, SCHEMA))) == model


def test_empty(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert view(fold.fold(log)) == {}
    assert fold.gaps(log, 0).count() == 0 and fold.tail(log, 4) == 4


def test_gaps_and_tail(spark):
    log = spark.createDataFrame([("c", s, "I", "a", 1) for s in (0, 1, 2, 5, 6, 9)], SCHEMA)
    assert sorted(r.seq for r in fold.gaps(log, 0, 12, chunk=4).collect()) == [3, 4, 7, 8, 10, 11]
    assert fold.tail(log, 0) == 3 and fold.tail(log, 5) == 7 and fold.tail(log, 3) == 3


def test_body_filter_stays_above_and_id_filter_goes_below(spark):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit("U").alias("op"), F.col("value").alias("after"))
    plan = fold.fold(log).filter("_id = 5 AND body > 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,5)" in plan and "GreaterThan(value" not in plan
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_route_against_a_search(spark, seed):
    from bisect import bisect_right

    rng = random.Random(seed)
    ids = sorted(rng.sample(range(10_000), 400))
    marks = [(f"{a:05d}", f"{b:05d}") for a, b in zip(ids[::2], ids[1::2], strict=True)]
    rows = [(k, None if k < 2 else f"{rng.randrange(11_000):05d}", rng.choice("IUD")) for k in range(3_000)] + [(k, "05000", "U") for k in range(3_000, 4_000)]
    firsts = [a for a, _ in marks]

    def owner(i, op):
        n = bisect_right(firsts, i) if i is not None else 0
        return firsts[max(n - 1, 0)] if op != "D" or (n and i <= marks[n - 1][1]) else None

    # No adaptive joining of small partitions, so that chunks are carried from slice to slice.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = snapshots.route(spark.createDataFrame(rows, "k int, doc_id string, op string"), spark.createDataFrame(marks, "first_id string, last_id string"))
        assert out.columns == ["k", "doc_id", "op", "chunk"]
        assert sorted(map(tuple, out.collect())) == sorted(((k, i, op, owner(i, op)) for k, i, op in rows), key=lambda r: r[0])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_route_compares_each_row_with_few_chunks(spark):
    rows = spark.range(2_000).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("doc_id"), F.lit("U").alias("op"))
    plan = snapshots.route(rows, rows.select(F.col("doc_id").alias("first_id"), F.col("doc_id").alias("last_id")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("00001") < 10  # no list of all chunks in the plan
    assert snapshots.route(rows, rows.limit(0).select(F.col("doc_id").alias("first_id"), F.col("doc_id").alias("last_id"))).filter("chunk IS NULL").count() == 2_000


def test_greedy_split_and_presets():
    runs = list(snapshots.greedy_split([(str(i), 10) for i in range(10)], 4, 35))
    assert [len(r) for r in runs] == [3, 3, 3, 1]
    assert [len(r) for r in snapshots.greedy_split([("a", 500), ("b", 1)], 4, 100)] == [1, 1]
    assert list(snapshots.greedy_split([], 4, 100)) == []


def test_facing_merge():
    c = [snapshots.Chunk("a", "b", 2, 20), snapshots.Chunk("c", "d", 1, 10), snapshots.Chunk("e", "f", 9, 90)]
    # The chunk after it comes first, though the one before is smaller; the last one takes the one before.
    assert snapshots.facing_merge(c, 1, 10, 100) == [c[0], snapshots.Chunk("c", "f", 10, 100)]
    assert snapshots.facing_merge(c, 1, 9, 100) == c
    assert snapshots.facing_merge(c[:2], 1, 10, 100) == [snapshots.Chunk("a", "d", 3, 30)]
    assert snapshots.facing_merge(c, 2, 10, 100) == c and snapshots.facing_merge(c[:1], 0, 10, 100) == c[:1]


def test_gc_is_due_when_a_boundary_is_crossed():
    assert snapshots.crosses(250, 260, 256) and not snapshots.crosses(256, 300, 256) and snapshots.crosses(255, 256, 256)
    head = {"log_seq_start": 0, "snapshot_bytes": 0}
    assert snapshots.maintenance_due(head, 260, 1, snapshots.PROFILES["node"], before=250)[1]


def test_head_rules():
    from foldlake.errors import EngineError

    old = {"log_seq_start": 5, "log_delete_floor": 2}
    snapshots.assert_head_step(old, {"log_seq_start": 6, "log_delete_floor": 6})
    for bad in ({"log_seq_start": 4, "log_delete_floor": 2}, {"log_seq_start": 5, "log_delete_floor": 1}, {"log_seq_start": 5, "log_delete_floor": 6}):
        with pytest.raises(EngineError):
            snapshots.assert_head_step(old, bad)
    assert snapshots.compact_decision(None, 0)[0] == "missing"
    assert snapshots.compact_decision(old, 50)[0] == "below-min"
    assert snapshots.compact_decision(old, 500) == ("ok", 500)
    assert snapshots.maintenance_due({"log_seq_start": 0, "snapshot_bytes": 0}, 1024, 64, snapshots.PROFILES["node"]) == (True, True)
    assert snapshots.pass_steps({"log_seq_start": 0, "snapshot_bytes": 64 << 20}, 10**9, 64, snapshots.PROFILES["node"])[0] == "defer-fold"


def test_fold_budget_takes_a_prefix(spark):
    rows = [(0, "a", 10, "x", 100), (1, "a", 10, "x", 100), (2, "b", 10, "y", 100), (3, "c", 10, None, 0), (4, "a", 10, "x", 100)]
    log = spark.createDataFrame(rows, "seq long, doc_id string, bytes long, chunk string, chunk_bytes long")
    fits = lambda **b: [r.seq for r in snapshots.plan_fold(log, snapshots.Budgets(**b)).filter("fits").orderBy("seq").collect()]
    assert fits(ids=2) == [0, 1, 2]
    assert fits(chunks=1) == [0, 1]
    assert fits(read_bytes=150) == [0, 1]
    assert fits(log_bytes=40) == [0, 1, 2, 3]
    assert fits() == [0, 1, 2, 3, 4]


def test_fold_budget_against_sums_over_slices(spark):
    rng = random.Random(1)
    rows = [(s, f"d{rng.randrange(5_000)}", None if s in (10_000, 12_345) else rng.randrange(9), rng.choice(["x", "y", None]), 7) for s in range(9_000, 21_000)]
    n = size = met = 0
    ids, chunks, want = set(), set(), {}
    for seq, doc, b, chunk, cost in rows:
        n, size = n + 1, size + (b or 0)
        ids.add(doc)
        if chunk and chunk not in chunks:
            chunks.add(chunk)
            met += cost
        want[seq] = n <= 11_000 and size <= 40_000 and len(ids) <= 4_400 and size + met <= 39_000
    budgets = snapshots.Budgets(entries=11_000, log_bytes=40_000, ids=4_400, write_bytes=39_000)
    out = snapshots.plan_fold(spark.createDataFrame(rows, "seq long, doc_id string, bytes long, chunk string, chunk_bytes long"), budgets)
    assert {r.seq: r.fits for r in out.collect()} == want and any(want.values()) and not all(want.values())
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(chunk" not in plan and "windowspecdefinition(doc_id" not in plan  # no chunk or id is one task's
