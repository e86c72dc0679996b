import json
import re

import pytest
from pyspark.sql import functions as F

from foldlake.errors import EngineError
from foldlake.operators import maintenance, snapshots
from foldlake.operators.collection import Collection
from foldlake.operators.patch import merge_patch, patch_typed
from foldlake.operators.query import manifest_pointer
from foldlake.sources.ndjson import read_ndjson
from foldlake.sources.store import LOG, Store, parse_bucket
from foldlake.streaming import feed


@pytest.fixture
def coll(spark, tmp_path):
    return Collection(Store(spark, f"file://{tmp_path}", "notes"))


def documents(c):
    return {r._id: json.loads(r.b) for r in c.all().select("_id", F.to_json("body").alias("b")).collect()}


@pytest.mark.parametrize(
    "target, patch, want",
    [
        ({"o": {"team": "x", "lvl": 1}}, {"o": {"lvl": None, "team": "y"}}, {"o": {"team": "y"}}),
        ({"s": 5}, {"o": {"q": None}}, {"s": 5, "o": {"q": None}}),
        ({"arr": [1, 2]}, {"arr": [3]}, {"arr": [3]}),
        ({"a": 1}, {"a": None, "b": 2}, {"b": 2}),
        ({"a": 1}, {"__proto__": 1}, {"a": 1}),
        ({"o": [1]}, {"o": {"x": None}}, {"o": {"x": None}}),
        ({"a": {"b": {"c": 1}}}, {}, {"a": {"b": {"c": 1}}}),
    ],
)
def test_merge_patch(target, patch, want):
    assert merge_patch(target, patch) == want
    again = merge_patch(merge_patch(target, patch), patch)
    if "None" not in str(want):  # a stored null goes the second time
        assert again == want


def test_typed_patch(spark):
    df = spark.createDataFrame([(1, ("x", 2))], "k int, o struct<team:string,lvl:int>")
    new = patch_typed(df.schema, {"o": {"lvl": None, "team": "y"}})
    assert df.select(new["o"].alias("o")).first().o == ("y", None)
    with pytest.raises(EngineError):
        patch_typed(df.schema, {"nothing": 1})


def test_life_of_a_collection(coll, tmp_path):
    assert coll.count() == 0 and coll.store.head() is None
    coll.insert({"_id": "a", "v": 1})
    made = coll.insert({"v": 2})["_id"]
    with pytest.raises(EngineError) as e:
        coll.insert({"_id": "a"})
    assert e.value.code == "Conflict"
    for bad in ("_x", "a/b", "x" * 300, "a\n"):
        with pytest.raises(EngineError):
            coll.insert({"_id": bad})
    assert coll.update("a", {"v": None, "w": {"x": 1}}) == {"modified": 1}
    assert coll.update("zz", {"v": 1}) == {"modified": 0}
    assert documents(coll) == {"a": {"_id": "a", "w": {"x": 1}}, made: {"_id": made, "v": 2}}
    with pytest.raises(EngineError) as e:
        coll.replace("zz", {})
    assert e.value.code == "NotFound"
    coll.replace("a", {"v": 7})
    before = documents(coll)
    assert coll.store.compact() == "ok"
    assert documents(coll) == before and coll.store.head()["log_seq_start"] == coll.store.head()["tail"]
    assert coll.store.compact(least=1) == "below-min"
    assert coll.update_where(lambda q: q.gte("v", 2), {"hit": True}) == {"modified": 2}
    assert coll.delete_where({"v": 7}) == {"deleted": 1}
    assert coll.delete("nope") == {"deleted": 0}
    assert list(documents(coll)) == [made]
    coll.dump(f"{tmp_path}/dump")
    lines = [json.loads(r.value) for r in coll.spark.read.text(f"{tmp_path}/dump").collect()]
    assert lines == [{"_id": made, "hit": True, "v": 2}]
    with pytest.raises(EngineError):
        coll.restore(f"{tmp_path}/dump")
    old = coll.store.head()["generation"]
    coll.restore(f"{tmp_path}/dump", force=True)
    assert coll.store.head()["generation"] != old and list(documents(coll)) == [made]


def test_insert_frame_and_schema(coll):
    coll.schema = lambda d: [] if d.get("v", 0) >= 0 else ["negative"]
    rows = coll.spark.range(50).select(F.format_string("k%03d", "id").alias("_id"), F.parse_json(F.format_string('{"v":%d}', "id")).alias("body"))
    assert coll.insert_frame(rows) == {"inserted": 50}
    log = coll.store.log()
    assert sorted(r.seq for r in log.collect()) == list(range(50))
    with pytest.raises(EngineError):
        coll.insert_frame(rows.limit(1))
    with pytest.raises(EngineError) as e:
        coll.update_where({"v": 3}, {"v": -1})
    assert e.value.code == "SchemaError" and e.value.issues == ["negative"]
    with pytest.raises(EngineError):
        coll.insert({"_id": "q", "v": -2})
    assert coll.where(lambda q: q.lt("v", 10)).count() == 10


def test_lost_race(coll):
    coll.insert({"_id": "a"})
    head = coll.store.head()
    coll.insert({"_id": "b"})
    with pytest.raises(EngineError) as e:
        coll.store._advance(head, tail=99)
    assert e.value.code == "Conflict" and e.value.retriable


def test_feed_pages_and_retention(coll):
    assert feed.since_page(coll.store) == ([], "")
    for i in range(4):
        coll.insert({"_id": f"d{i}"})
    rows, at = feed.since_page(coll.store, "", page=3)
    assert [r.seq for r in rows] == [0, 1, 2]
    rows, at = feed.since_page(coll.store, at)
    assert [r.doc_id for r in rows] == ["d3"]
    assert feed.since_page(coll.store, at) == ([], at)
    with pytest.raises(EngineError):
        feed.since_page(coll.store, "other." + at.rpartition(".")[2])
    old = feed.since_page(coll.store, "", page=1)[1]
    coll.store.compact()
    assert coll.store.retire(retain=0) == (0, 4)
    assert coll.count() == 4
    with pytest.raises(EngineError):
        feed.since_page(coll.store, old)


def test_streaming_source_and_live_view(coll, tmp_path, spark):
    for i in range(3):
        coll.insert({"_id": f"d{i}", "v": i})
    coll.update("d0", {"v": 9})
    spark.dataSource.register(feed.FeedSource)
    stream = spark.readStream.format("changefeed").option("path", coll.store.root).load()
    got = {}

    def apply(batch, _):
        for r in batch.collect():
            got[r.doc_id] = json.loads(r.after)["v"] if r.after else None

    q = feed.live_view(stream, apply, f"{tmp_path}/ckpt", available_now=False)
    try:
        q.processAllAvailable()
        assert got == {"d0": 9, "d1": 1, "d2": 2}
        coll.delete("d1")
        q.processAllAvailable()
        assert got == {"d0": 9, "d1": None, "d2": 2}
    finally:
        q.stop()


def test_file_stream(coll, tmp_path, spark):
    coll.insert({"_id": "a", "v": 1})
    seen = []
    q = feed.live_view(feed.log_stream(spark, f"{coll.store.root}/log", LOG), lambda b, i: seen.extend(r.doc_id for r in b.collect()), f"{tmp_path}/c2")
    q.awaitTermination(60)
    assert seen == ["a"]


def test_live_queries(coll):
    live = feed.LiveQueries()
    live.add("n", {"notes"}, coll.count)
    coll.insert({"_id": "a"})
    assert live.results["n"] == 0 and live.changed("other") == []
    assert live.changed("notes") == ["n"] and live.results["n"] == 1 and live.states["n"] == "ok"


def test_buckets(spark, tmp_path):
    assert parse_bucket("s3://b/p/q").path() == "s3a://b/p/q"
    assert parse_bucket("gcs://b").path() == "gs://b"
    assert parse_bucket("file:///x/y").path() == "file:///x/y"
    for bad in ("ftp://b", "b", "s3:///x"):
        with pytest.raises(EngineError):
            parse_bucket(bad)
    with pytest.raises(EngineError):
        Store(spark, f"file://{tmp_path}", "_bad")


@pytest.mark.parametrize("line", ['{"v":1}', '{"_id":5}', '{"_id":"_x"}', "not json", "[1]"])
def test_bad_ndjson(spark, tmp_path, line):
    (tmp_path / "x.ndjson").write_text('{"_id":"ok"}\n' + line + "\n")
    with pytest.raises(Exception, match="bad document"):
        read_ndjson(spark, str(tmp_path / "x.ndjson")).collect()


def test_commit_is_found_again_by_its_token(coll, spark):
    rows = spark.createDataFrame([("I", "a", '{"v":1}')], "op string, doc_id string, t string").select("op", "doc_id", F.parse_json("t").alias("after"))
    first = coll.store.append(rows, token="t1")
    assert coll.store.append(rows, token="t1") == first and coll.store.head()["tail"] == 1
    assert coll.store.append(rows, token="t2") == (1, 2)


def test_a_lost_race_is_tried_again_and_leaves_nothing(coll, monkeypatch):
    coll.insert({"_id": "a", "v": 1})
    real, lost = coll.store._advance, []

    def race(head, **changes):
        if not lost:
            lost.append(1)
            real(coll.store.head(), tail=head["tail"])  # someone else's version comes first
        return real(head, **changes)

    monkeypatch.setattr(coll.store, "_advance", race)
    assert coll.update("a", {"v": 2}) == {"modified": 1} and coll.get("a")["v"] == 2
    assert sorted(coll.store.files.list("log")) == sorted(coll.store.head()["batches"])


def test_retrying_waits_and_gives_up():
    from foldlake.sources.store import retrying

    waits, runs = [], []

    def fail():
        runs.append(1)
        raise EngineError("Conflict", "x", retriable=True)

    with pytest.raises(EngineError):
        retrying(fail, attempts=4, sleep=waits.append)
    assert len(runs) == 4 and len(waits) == 3 and all(w <= 0.05 * 2**i for i, w in enumerate(waits))


def test_two_creates_of_one_file(coll):
    f = coll.store.files
    assert f.create("head/x", b"1") and not f.create("head/x", b"2") and f.read("head/x") == b"1"
    assert f.list("head") == ["x"]


def test_snapshots_are_named_and_checked_by_content(spark, tmp_path):
    names = []
    for root in ("p", "q"):
        c = Collection(Store(spark, f"file://{tmp_path}/{root}", "notes"))
        c.insert({"_id": "a", "v": 1})
        assert c.store.compact() == "ok"
        names.append(c.store.head()["snapshot"])
    assert c.store.head()["snapshot_bytes"] > 0 and names[0].endswith(".parquet")
    assert maintenance.verify_snapshots(spark.read.format("binaryFile").load(f"{c.store.root}/{names[1]}/*.parquet")).first().ok
    file = next((tmp_path / "q/app=app/tenant=main/notes" / names[1]).glob("*.parquet"))
    other = Store(spark, f"file://{tmp_path}/q", "notes")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 255
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    file.write_bytes(bytes(data))
    assert not maintenance.verify_snapshots(spark.read.format("binaryFile").load(f"{c.store.root}/{names[1]}/*.parquet")).first().ok
    with pytest.raises(EngineError) as e:
        other.view()
    assert e.value.code == "Internal"


def test_pointer_moves_with_every_change(coll):
    seen = set()
    for step in (lambda: coll.insert({"_id": "a"}), lambda: coll.update("a", {"v": 1}), coll.store.compact, lambda: coll.delete("a")):
        step()
        seen.add(manifest_pointer(coll.store.head()))
    assert len(seen) == 4 and all(re.fullmatch("m1:[0-9a-z]{13}", p) for p in seen)


def test_maintenance_pass_folds_marks_and_sweeps(coll):
    for i in range(3):
        coll.insert({"_id": f"d{i}"})
        assert coll.store.maintain(entry_bytes=1 << 20)[0] == "fold:ok"
    assert len(coll.store.files.list("snapshot/L9")) == 3
    small = snapshots.Profile(1 << 30, 1 << 30, 2)
    assert coll.store.maintain(small, entry_bytes=1, before=0)[0] == "gc:0" and len(coll.store.head()["gc"]) == 2
    assert coll.store.maintain(small, entry_bytes=1, before=0, now="2999-01-01")[0] == "gc:2"
    assert [f"snapshot/L9/{n}" for n in coll.store.files.list("snapshot/L9")] == [coll.store.head()["snapshot"]]
    assert coll.count() == 3 and coll.store.head()["gc"] == []
    assert coll.store.maintain(snapshots.Profile(0, 0), entry_bytes=1 << 20) == []


def test_maintenance_folds_the_whole_log(coll, spark):
    coll.insert_frame(spark.range(10_001).select(F.col("id").cast("string").alias("_id"), F.parse_json(F.lit("{}")).alias("body")))
    assert coll.store.maintain(entry_bytes=1 << 20)[0] == "fold:ok"
    head = coll.store.head()
    assert head["log_seq_start"] == head["tail"] == 10_001 and head["snapshot_rows"] == 10_001


def test_maintenance_defers_and_leaves_nothing(coll, spark, tmp_path):
    store, old = coll.store, [f"{i:012d}-{i:012d}-{'a' * 64}.parquet" for i in range(1_001)]
    store.reseed(spark.range(65_537).select(F.col("id").cast("string").alias("_id"), F.parse_json(F.lit("{}")).alias("body")))
    coll.insert_frame(spark.range(100_000, 103_000).select(F.col("id").cast("string").alias("_id"), F.parse_json(F.lit("{}")).alias("body")))
    for name in old:
        (tmp_path / "app=app/tenant=main/notes/snapshot/L9" / name).mkdir()
    # The snapshot passes a host's ceiling, retention is over 20 numbers behind, and over 1,000 snapshots are orphans.
    assert store.maintain(entry_bytes=1 << 20, before=0) == ["fold:ok", "gc:0", "retention:1976"]
    assert store.head()["snapshot_rows"] == 68_537 and len(store.head()["gc"]) == 1_002
    store.maintain(entry_bytes=0, before=0, now="2999-01-01")
    assert store.files.list("snapshot/L9") == [store.head()["snapshot"].rpartition("/")[2]]
    assert coll.count() == 68_537


def test_cursor_rules(coll):
    for i in range(3):
        coll.insert({"_id": f"d{i}"})
    _, at = feed.since_page(coll.store, "", page=2)
    with pytest.raises(EngineError, match="generation"):
        feed.since_page(coll.store, at.rpartition(".")[2])
    coll.store.compact()
    with pytest.raises(EngineError, match="folded"):
        feed.since_page(coll.store, at)
    assert feed.since_page(coll.store, "")[0] == []
    coll.insert({"_id": "d9"})
    assert [r.doc_id for r in feed.since_page(coll.store, "")[0]] == ["d9"]


def test_long_poll(coll):
    import time

    coll.insert({"_id": "a"})
    rows, at = feed.long_poll(coll.store, timeout=5)
    assert [r.doc_id for r in rows] == ["a"]
    began = time.monotonic()
    assert feed.long_poll(coll.store, at, timeout=0.4, interval=0.1) == ([], at) and time.monotonic() - began >= 0.4
    assert feed.long_poll(coll.store, at, timeout=60, cancelled=lambda: True) == ([], at)
    with pytest.raises(EngineError):
        feed.long_poll(coll.store, "nonsense", timeout=60)


def test_insert_frame_checks_ids_and_bodies(coll, spark):
    frame = lambda *rows: spark.createDataFrame(rows, "_id string, t string").select("_id", F.parse_json("t").alias("body"))
    for bad, code in (((None, "{}"), "InvalidConfig"), (("_x", "{}"), "InvalidConfig"), (("a", "[1]"), "SchemaError"), (("a", None), "SchemaError")):
        with pytest.raises(EngineError) as e:
            coll.insert_frame(frame(("ok", "{}"), bad))
        assert e.value.code == code
    coll.schema = lambda d: [] if d.get("v", 0) >= 0 else ["negative"]
    with pytest.raises(EngineError) as e:
        coll.insert_frame(frame(("ok", '{"v":-1}')))
    assert e.value.issues == ["negative"] and coll.store.head() is None


def test_old_heads_go(coll, monkeypatch):
    from foldlake.sources import store

    monkeypatch.setattr(store, "KEEP_HEADS", 2)
    for i in range(4):
        coll.insert({"_id": f"d{i}"})
    assert len(coll.store.files.list("head")) == 2 and coll.count() == 4


def test_skipped_live_query(coll):
    live = feed.LiveQueries()
    live.add("n", {"notes"}, None)
    assert live.states["n"] == "skipped" and live.changed("notes") == []
