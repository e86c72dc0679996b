"""Registered queries over the document-store operators, each with its SQL.

Every query runs over whole tables; a limit is there only where it is the feature (top-k, first,
a page, usage's newest entries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake import predicate as P
from foldlake.functions import codecs, columns
from foldlake.operators import export, fold, indexes, maintenance, patch, snapshots, stats
from foldlake.operators.collection import Collection
from foldlake.operators.query import Query, from_request, manifest_pointer
from foldlake.sources.store import Store, scratch
from foldlake.streaming import feed
from foldlake.streaming.feed import since

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark, sf_dir, name, id_col) -> Query:
    return Query(table(spark, sf_dir, name), id_col)


def bodies(spark, sf_dir) -> Query:
    """events with ``props`` as a VARIANT body."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.parse_json("props").alias("body"))
    return Query(e, "_id", "body")


def nested(spark, sf_dir) -> Query:
    """Documents with objects, arrays, nulls and mixed kinds, made of orders."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(
        F.lit('{"cust":{"key":'), F.col("o_custkey"), F.lit(',"status":"'), F.col("o_orderstatus"), F.lit('"},"n":'),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('"'), F.col("o_custkey"), F.lit('"'))).when(F.col("o_orderkey") % 4 == 1, F.lit("null")).otherwise(F.col("o_custkey").cast("string")),
        F.lit(',"tags":["'), F.col("o_orderpriority"), F.lit('"]'), F.when(F.col("o_orderkey") % 3 == 0, F.lit(',"extra":true}')).otherwise(F.lit("}")),
    )
    return Query(o.select(F.col("o_orderkey").alias("_id"), F.parse_json(text).alias("body")), "_id", "body")


NESTED = """SELECT o_orderkey AS _id, o_custkey, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderkey % 4 = 0 THEN 'string' WHEN o_orderkey % 4 = 1 THEN 'null' ELSE 'number' END AS n_kind, o_orderkey % 3 = 0 AS extra FROM orders"""


# Predicates and terminals


@query(
    "topk_filtered",
    "SELECT * FROM events WHERE event_type = 'click' AND value >= 50 ORDER BY ts DESC, event_id LIMIT 50",
)
def topk_filtered(spark, sf_dir):
    q = docs_of(spark, sf_dir, "events", "event_id").where({"event_type": "click"}).where(lambda q: q.gte("value", 50))
    return q.order({"ts": "desc", "event_id": "asc"}).limit(50).all()


@query("where_eq", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def where_eq(spark, sf_dir):
    return docs_of(spark, sf_dir, "orders", "o_orderkey").where({"o_orderstatus": "F"}).all()


@query("where_in", "SELECT * FROM part WHERE p_size IN (1, 15, 49) AND p_brand IN ('Brand#12', 'Brand#23', 'Brand#1')")
def where_in(spark, sf_dir):
    q = docs_of(spark, sf_dir, "part", "p_partkey")
    return q.where(lambda q: q.in_("p_size", [1, 15, 49, "15"]).in_("p_brand", ["Brand#12", "Brand#23", "Brand#1"])).all()


@query("where_range", "SELECT * FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20 AND l_discount >= 0.05")
def where_range(spark, sf_dir):
    return docs_of(spark, sf_dir, "lineitem", "l_orderkey").where(lambda q: q.gt("l_quantity", 10).lte("l_quantity", 20).gte("l_discount", 0.05)).all()


@query("where_chain", "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 100000 AND o_orderpriority = '1-URGENT'")
def where_chain(spark, sf_dir):
    q = docs_of(spark, sf_dir, "orders", "o_orderkey").where({"o_orderstatus": "O"}).where(lambda q: q.lt("o_totalprice", 100000))
    return q.where({"o_orderpriority": "1-URGENT"}).all()


@query("where_string_range", "SELECT * FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def where_string_range(spark, sf_dir):
    return docs_of(spark, sf_dir, "orders", "o_orderkey").where(lambda q: q.gte("o_orderpriority", "2").lt("o_orderpriority", "4")).all()


@query("where_utf16_order", "SELECT doc_id, lang FROM documents WHERE lang > 'e' AND lang <= 'es'")
def where_utf16_order(spark, sf_dir):
    q = Query(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", utf16=True)
    return q.where(lambda q: q.gt("lang", "e").lte("lang", "es")).all()


@query("where_type_strict", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 7)")
def where_type_strict(spark, sf_dir):
    """Strings in the list are of another kind and match no number."""
    q = Query(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return q.where(lambda q: q.in_("c_custkey", [1, "2", 7, True])).all()


@query("where_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'")
def where_time_range(spark, sf_dir):
    """ISO strings compare with time columns as times."""
    q = Query(table(spark, sf_dir, "events").select("event_id", "ts"), "event_id")
    return q.where(lambda q: q.gte("ts", "2024-01-02T00:00:00")).all()


@query("where_json_path_number", "SELECT event_id AS _id, CAST(props->>'$.k' AS DOUBLE) AS k FROM events WHERE CAST(props->>'$.k' AS DOUBLE) > 50")
def where_json_path_number(spark, sf_dir):
    rows = bodies(spark, sf_dir).where(lambda q: q.gt("k", 50)).all()
    return rows.select("_id", F.variant_get("body", "$.k", "double").alias("k"))


@query("where_json_type_strict", "SELECT count(*) FILTER (WHERE json_type(props, '$.k') = 'VARCHAR' AND props->>'$.k' = '69') AS as_string, count(*) FILTER (WHERE CAST(props->>'$.k' AS DOUBLE) = 69) AS as_number FROM events")
def where_json_type_strict(spark, sf_dir):
    b = F.col("body")
    one = lambda c: F.count(F.when(c, 1))
    return bodies(spark, sf_dir).df.agg(one(columns.variant(b, (P.Clause("eq", "k", "69"),))).alias("as_string"), one(columns.variant(b, (P.Clause("eq", "k", 69),))).alias("as_number"))


@query("where_missing_path", "SELECT 0::BIGINT AS with_path, count(*) AS without_path FROM events")
def where_missing_path(spark, sf_dir):
    hit = columns.variant(F.col("body"), P.normalise({"k": {"deeper": 1}}))
    return bodies(spark, sf_dir).df.agg(F.count(F.when(hit, 1)).alias("with_path"), F.count(F.when(~hit, 1)).alias("without_path"))


@query("where_nested_path", f"SELECT _id FROM ({NESTED}) WHERE o_orderstatus = 'F' AND o_custkey > 100")
def where_nested_path(spark, sf_dir):
    return nested(spark, sf_dir).where(lambda q: q.eq("cust.status", "F").gt("cust.key", 100)).all().select("_id")


@query("where_sub_document", f"SELECT _id FROM ({NESTED}) WHERE o_orderstatus = 'O'")
def where_sub_document(spark, sf_dir):
    """Open world: the object has a key more."""
    return nested(spark, sf_dir).where(lambda q: q.eq("cust", {"status": "O"})).all().select("_id")


@query("where_mixed_kinds", f"SELECT _id, n_kind FROM ({NESTED}) WHERE (n_kind = 'number' AND o_custkey <= 50) OR (n_kind = 'string' AND o_custkey = 7)")
def where_mixed_kinds(spark, sf_dir):
    view = nested(spark, sf_dir)
    low = view.where(lambda q: q.lte("n", 50)).all()
    seven = view.where(lambda q: q.in_("n", ["7", False])).all()
    return low.unionByName(seven).select("_id", columns.variant_kind(columns.variant_at(F.col("body"), "n")).alias("n_kind"))


@query("where_array_never", f"SELECT count(*) FILTER (WHERE extra) AS extra, 0::BIGINT AS in_array FROM ({NESTED})")
def where_array_never(spark, sf_dir):
    b = F.col("body")
    one = lambda where: F.count(F.when(columns.variant(b, P.normalise(where)), 1))
    return nested(spark, sf_dir).df.agg(one({"extra": True}).alias("extra"), one({"tags": {"0": "1-URGENT"}}).alias("in_array"))


@query("empty_object_matches_all", "SELECT count(*) AS n FROM customer")
def empty_object_matches_all(spark, sf_dir):
    return docs_of(spark, sf_dir, "customer", "c_custkey").where({"anything": {}}).count_df()


@query("first", "SELECT * FROM supplier WHERE s_nationkey = 3 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def first(spark, sf_dir):
    return docs_of(spark, sf_dir, "supplier", "s_suppkey").where({"s_nationkey": 3}).order({"s_acctbal": "desc"}).first()


@query("order_multi_limit", "SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_extendedprice ASC, l_orderkey, l_linenumber LIMIT 100")
def order_multi_limit(spark, sf_dir):
    q = docs_of(spark, sf_dir, "lineitem", "l_orderkey")
    return q.order({"l_shipdate": "desc", "l_extendedprice": "asc", "l_orderkey": "asc", "l_linenumber": "asc"}).limit(100).all()


@query("order_missing_first", f"SELECT _id FROM ({NESTED}) ORDER BY extra, _id LIMIT 40")
def order_missing_first(spark, sf_dir):
    return nested(spark, sf_dir).order({"extra": "asc"}).limit(40).all().select("_id")


@query("order_missing_last", f"SELECT _id FROM ({NESTED}) ORDER BY extra DESC, _id LIMIT 40")
def order_missing_last(spark, sf_dir):
    return nested(spark, sf_dir).order({"extra": "desc"}).limit(40).all().select("_id")


@query("count_where", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count_where(spark, sf_dir):
    return docs_of(spark, sf_dir, "lineitem", "l_orderkey").where({"l_returnflag": "R"}).count_df()


@query("count_limit", "SELECT least(count(*), 100) AS with_limit, count(*) AS without_limit FROM orders WHERE o_orderstatus = 'P'")
def count_limit(spark, sf_dir):
    q = docs_of(spark, sf_dir, "orders", "o_orderkey").where({"o_orderstatus": "P"}).limit(100)
    return q.count_df().select(F.col("n").alias("with_limit")).crossJoin(q.count_df(ignore_limit=True).select(F.col("n").alias("without_limit")))


@query("get_by_id", "SELECT * FROM customer WHERE c_custkey = 42")
def get_by_id(spark, sf_dir):
    return docs_of(spark, sf_dir, "customer", "c_custkey").get(42)


@query("request_parameters", "SELECT * FROM part WHERE p_brand = 'Brand#12' AND p_size > 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def request_parameters(spark, sf_dir):
    wire = '{"clauses":[{"op":"eq","field":"p_brand","value":"Brand#12"},{"op":"gt","field":"p_size","value":20}]}'
    return from_request(table(spark, sf_dir, "part"), {"where": wire, "order": '{"p_retailprice":"desc"}', "limit": "25"}, "p_partkey").all()


# The log and the fold


def event_log(spark, sf_dir) -> DataFrame:
    """events as a log of one document a user: an error deletes it, all else writes it."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "D").otherwise("U")
    return e.select(
        F.lit("users").alias("collection"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("doc_id"),
        F.when(op == "U", F.struct("event_type", "value")).alias("after"), F.col("ts").alias("commit_ts"),
    )


def flat(view: DataFrame) -> DataFrame:
    return view.select("_id", "body.event_type", "body.value")


FOLD = """SELECT user_id AS _id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events {where}
GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'"""


@query("fold_view", FOLD.format(where=""))
def fold_view(spark, sf_dir):
    return flat(fold.fold(event_log(spark, sf_dir), collection="users"))


@query("fold_where", f"SELECT * FROM ({FOLD.format(where='')}) WHERE event_type = 'purchase' AND value > 20")
def fold_where(spark, sf_dir):
    return Query(flat(fold.fold(event_log(spark, sf_dir)))).where(lambda q: q.eq("event_type", "purchase").gt("value", 20)).all()


@query("fold_by_id", f"SELECT * FROM ({FOLD.format(where='')}) WHERE _id = 3")
def fold_by_id(spark, sf_dir):
    return Query(flat(fold.fold(event_log(spark, sf_dir)))).get(3)


@query("fold_count", f"SELECT count(*) AS n FROM ({FOLD.format(where='')})")
def fold_count(spark, sf_dir):
    return Query(flat(fold.fold(event_log(spark, sf_dir)))).count_df()


@query("fold_as_of", FOLD.format(where="WHERE event_id < 600"))
def fold_as_of(spark, sf_dir):
    return flat(fold.fold(event_log(spark, sf_dir), upto=600))


@query("fold_variant", f"SELECT _id, value FROM ({FOLD.format(where='')})")
def fold_variant(spark, sf_dir):
    """VARIANT bodies ride through the window as payload."""
    log = event_log(spark, sf_dir).withColumn("after", F.to_variant_object("after"))
    return fold.fold(log).select("_id", F.variant_get("body", "$.value", "double").alias("value"))


@query("compact_then_overlay", FOLD.format(where=""))
def compact_then_overlay(spark, sf_dir):
    """The fold of a snapshot and the log after it is the fold of the whole log."""
    log = event_log(spark, sf_dir)
    return flat(fold.fold(log, fold.compact(log, None, 500), since=500))


@query("pre_image", "SELECT event_id, lag(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY event_id) AS before_value FROM events")
def pre_image(spark, sf_dir):
    return fold.pre_images(event_log(spark, sf_dir)).select(F.col("seq").alias("event_id"), F.col("before.value").alias("before_value"))


GAPPED = "(SELECT event_id FROM events WHERE event_id % 97 <> 5)"


@query("log_gaps", f"SELECT g.seq FROM (SELECT unnest(generate_series(0, (SELECT max(event_id) FROM {GAPPED}))) AS seq) g WHERE g.seq NOT IN {GAPPED}")
def log_gaps(spark, sf_dir):
    return fold.gaps(event_log(spark, sf_dir).filter("seq % 97 <> 5"), 0)


@query("tail_probe", f"SELECT min(event_id) + 1 AS tail FROM {GAPPED} e WHERE event_id >= 10 AND event_id + 1 NOT IN {GAPPED}")
def tail_probe(spark, sf_dir):
    return spark.createDataFrame([(fold.tail(event_log(spark, sf_dir).filter("seq % 97 <> 5"), 10),)], "tail bigint")


@query("since_page", "SELECT event_id AS seq, user_id AS doc_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 1024")
def since_page(spark, sf_dir):
    return since(event_log(spark, sf_dir), 100).select("seq", "doc_id")


# Mutations


def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer")


def patched(spark, sf_dir, where, change: dict) -> DataFrame:
    c = customers(spark, sf_dir)
    new = patch.patch_typed(c.schema, change)
    hit = columns.typed(c.schema, P.validate(P.normalise(where)))
    return c.select(*[F.when(hit, new[n]).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in c.columns])


@query("merge_patch_flat", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'CLOSED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def merge_patch_flat(spark, sf_dir):
    return patched(spark, sf_dir, {"c_nationkey": 3}, {"c_acctbal": 0.0, "c_mktsegment": "CLOSED"})


@query("merge_patch_null_delete", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def merge_patch_null_delete(spark, sf_dir):
    return patched(spark, sf_dir, lambda q: q.lt("c_acctbal", 0), {"c_mktsegment": None})


@query("merge_patch_variant", f"SELECT _id, NULL::VARCHAR AS status, 1.0::DOUBLE AS added, o_custkey::DOUBLE AS key FROM ({NESTED})")
def merge_patch_variant(spark, sf_dir):
    rows = nested(spark, sf_dir).df.select("_id", patch.patch_variant(F.col("body"), {"cust": {"status": None, "added": 1}}).alias("body"))
    at = lambda p, t: F.try_variant_get("body", p, t)
    return rows.select("_id", at("$.cust.status", "string").alias("status"), at("$.cust.added", "double").alias("added"), at("$.cust.key", "double").alias("key"))


def stored(spark, name: str, rows: DataFrame, id_col: str) -> Collection:
    """A collection in a fresh store, with a document for each row of a table."""
    c = Collection(Store(spark, scratch(spark, name), name))
    c.insert_frame(rows.select(F.col(id_col).cast("string").alias("_id"), F.to_variant_object(F.struct(*rows.columns)).alias("body")))
    return c


def fields(view: DataFrame, **kinds: str) -> DataFrame:
    return view.select(*[F.try_variant_get("body", f"$.{name}", kind).alias(name) for name, kind in kinds.items()])


@query("bulk_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bulk_update(spark, sf_dir):
    c = stored(spark, "customers", customers(spark, sf_dir), "c_custkey")
    c.update_where({"c_mktsegment": "BUILDING"}, {"c_mktsegment": "BUILT"})
    return fields(c.all(), c_custkey="bigint", c_mktsegment="string")


@query("bulk_delete", "SELECT c_custkey FROM customer WHERE c_nationkey <> 7")
def bulk_delete(spark, sf_dir):
    c = stored(spark, "customers", customers(spark, sf_dir), "c_custkey")
    c.delete_where({"c_nationkey": 7})
    return fields(c.all(), c_custkey="bigint")


@query("replace", "SELECT c_custkey, CASE WHEN c_custkey = 9 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey = 9 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def replace(spark, sf_dir):
    c = stored(spark, "customers", customers(spark, sf_dir), "c_custkey")
    c.replace("9", {"c_custkey": 9, "c_acctbal": 1.5})
    return fields(c.all(), c_custkey="bigint", c_name="string", c_acctbal="double")


@query("insert_conflicts", "SELECT n_nationkey AS doc_id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def insert_conflicts(spark, sf_dir):
    """Ids of new documents that the collection has already."""
    c = stored(spark, "nations", customers(spark, sf_dir).select("c_nationkey").distinct(), "c_nationkey")
    new = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("_id"))
    return c.conflicts(new).select(F.col("_id").cast("bigint").alias("doc_id"))


@query("store_life", "SELECT s_suppkey, CASE WHEN s_suppkey = 2 THEN 'second' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 3")
def store_life(spark, sf_dir):
    """Insert, fold, update and delete through the store: the view is the checked snapshot with the log after it."""
    c = stored(spark, "suppliers", table(spark, sf_dir, "supplier"), "s_suppkey")
    c.store.compact()
    c.update("2", {"s_name": "second"})
    c.delete("3")
    return fields(c.all(), s_suppkey="bigint", s_name="string")


@query("store_snapshots", "SELECT count(*) AS rows, true AS verified, true AS named_by_content, true AS pointer_moved, count(*) AS pending_before, 0::BIGINT AS pending_after FROM supplier")
def store_snapshots(spark, sf_dir):
    """A maintenance pass writes a snapshot that its name verifies; equal content has the same digest, and the table's version moves."""
    c = stored(spark, "suppliers", table(spark, sf_dir, "supplier"), "s_suppkey")
    before = c.store.head()
    c.store.maintain(entry_bytes=1 << 20)
    head = c.store.head()
    ok = maintenance.verify_snapshots(spark.read.format("binaryFile").load(f"{c.store.root}/{head['snapshot']}/*.parquet"))
    facts = F.lit(head["snapshot"] in [r.key for r in c.store.snapshot_files().collect()])  # one snapshot
    return ok.select(
        F.lit(head["snapshot_rows"]).cast("bigint").alias("rows"), F.col("ok").alias("verified"), facts.alias("named_by_content"),
        F.lit(manifest_pointer(head) != manifest_pointer(before)).alias("pointer_moved"),
        F.lit(before["tail"] - before["log_seq_start"]).cast("bigint").alias("pending_before"), F.lit(head["tail"] - head["log_seq_start"]).cast("bigint").alias("pending_after"),
    )


@query("store_feed", "SELECT s_suppkey::VARCHAR AS doc_id, 'I' AS op FROM supplier UNION ALL SELECT '1', 'U'")
def store_feed(spark, sf_dir):
    """Pages of the feed through the store, each after the cursor of the one before."""
    c = stored(spark, "suppliers", table(spark, sf_dir, "supplier"), "s_suppkey")
    c.update("1", {"s_name": "first"})
    head = c.store.head()
    # The page's own form: a top-k over the log; the cursor codec and rules are those of since_page.
    rows, at = feed.since_page(c.store, "", page=3)
    rest = since(c.store.log(head, len(rows)), rows[-1].seq, head["tail"]).select("doc_id", "op")
    assert feed.since_page(c.store, at, page=1)[0][0].seq == rows[-1].seq + 1
    return spark.createDataFrame([(r.doc_id, r.op) for r in rows], "doc_id string, op string").unionByName(rest)


@query("validate_rules", "SELECT c_custkey, (CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END + CASE WHEN length(c_name) > 0 THEN 0 ELSE 1 END)::INTEGER AS n_issues FROM customer")
def validate_rules(spark, sf_dir):
    from foldlake.operators.collection import rule_issues

    issues = rule_issues({"c_acctbal": ("must not be negative", F.col("c_acctbal") >= 0), "c_name": ("must have a letter", F.length("c_name") > 0)})
    return customers(spark, sf_dir).select("c_custkey", F.size(issues).alias("n_issues"))


# Indexes

BY_PRIORITY = indexes.Index("by_priority", ("o_orderpriority", "o_totalprice"), (P.Clause("eq", "o_orderstatus", "O"),))


@query("index_keys", "SELECT lower('40' || hex(o_orderpriority)) AS key, o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'O'")
def index_keys(spark, sf_dir):
    return indexes.keys_by_hex(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", BY_PRIORITY.where)


@query("index_prune", "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice > 150000.0")
def index_prune(spark, sf_dir):
    """A planned walk over an index, its documents fetched and the whole predicate applied again."""
    orders = table(spark, sf_dir, "orders")
    clauses = P.validate(Query(orders).where(lambda q: q.eq("o_orderstatus", "O").eq("o_orderpriority", "1-URGENT").gt("o_totalprice", 150000.0)).clauses)
    plan = indexes.choose_plan(clauses, (BY_PRIORITY,))
    ids = indexes.walk(indexes.project(orders, BY_PRIORITY, "o_orderkey"), plan)
    return indexes.fetch(orders, ids, clauses, "o_orderkey")


@query("index_in_walk", "SELECT p_partkey FROM part WHERE p_size IN (3, 5, 8)")
def index_in_walk(spark, sf_dir):
    part, ix = table(spark, sf_dir, "part"), indexes.Index("by_size", ("p_size",))
    clauses = P.validate((P.Clause("in", "p_size", [3, 5, 8]),))
    return indexes.walk(indexes.project(part, ix, "p_partkey"), indexes.choose_plan(clauses, (ix,))).select(F.col("doc_id").cast("bigint").alias("p_partkey"))


@query("index_key_order", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 200")
def index_key_order(spark, sf_dir):
    """Keys of doubles, some negative, sort as the doubles do."""
    rows = customers(spark, sf_dir).select("c_custkey", codecs.index_key_col(F.col("c_acctbal"), "number").alias("key"))
    return rows.orderBy("key", "c_custkey").limit(200).select("c_custkey")


@query("index_drift", "SELECT count(*) FILTER (WHERE o_orderkey % 10 = 3 AND o_orderstatus = 'O') AS added, count(*) FILTER (WHERE o_orderstatus = 'P') AS removed, count(*) FILTER (WHERE o_orderkey % 10 <> 3 AND o_orderstatus = 'O') AS kept FROM orders")
def index_drift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    expected = indexes.keys_by_hex(orders, "o_orderpriority", "o_orderkey", BY_PRIORITY.where)
    actual = expected.filter("doc_id % 10 <> 3").unionByName(indexes.keys_by_hex(orders.filter("o_orderstatus = 'P'"), "o_orderpriority", "o_orderkey"))
    return indexes.drift_counts(expected, actual)


@query("lsn_codec", "SELECT event_id, event_id AS seq FROM events")
def lsn_codec(spark, sf_dir):
    """Names of log entries and back."""
    e = table(spark, sf_dir, "events")
    name = codecs.lsn_col(F.unix_millis(F.col("ts").cast("timestamp")), F.lit("abc123"), F.col("event_id"))
    return e.select("event_id", codecs.lsn_seq_col(name).alias("seq"))


@query("lsn_newest_first", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def lsn_newest_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = codecs.lsn_col(F.unix_millis(F.col("ts").cast("timestamp")), F.lit("abc123"), F.col("event_id"))
    return e.select("event_id", name.alias("name")).orderBy("name").limit(20).select("event_id")


# Snapshots

CHUNKED = "SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS id FROM customer"


def chunk_table(spark, sf_dir) -> DataFrame:
    """Chunks of 100 customers by id, with every second one gone."""
    c = customers(spark, sf_dir).select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("id"), F.floor(F.col("c_custkey") / 100).alias("g"))
    return c.groupBy("g").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("g % 2 = 0")


@query(
    "chunk_routing",
    f"""WITH c AS ({CHUNKED}), m AS (SELECT min(id) AS first_id, max(id) AS last_id FROM c WHERE (c_custkey // 100) % 2 = 0 GROUP BY c_custkey // 100)
SELECT c.id AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'D' ELSE 'U' END AS op,
  CASE WHEN EXISTS (SELECT 1 FROM m WHERE c.id BETWEEN m.first_id AND m.last_id) OR c_custkey % 5 <> 0
       THEN coalesce((SELECT max(first_id) FROM m WHERE first_id <= c.id), (SELECT min(first_id) FROM m)) END AS chunk FROM c""",
)
def chunk_routing(spark, sf_dir):
    m = customers(spark, sf_dir).select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("doc_id"), F.when(F.col("c_custkey") % 5 == 0, "D").otherwise("U").alias("op"))
    return snapshots.route(m, chunk_table(spark, sf_dir))


@query("chunk_split")
def chunk_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("_id"), F.octet_length("text").alias("bytes"))
    return snapshots.split(d, *reversed(snapshots.PRESETS["small"]))


@query(
    "fold_budget",
    """WITH e AS (SELECT event_id AS seq, length(props) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS i FROM events),
r AS (SELECT seq, count(*) OVER w AS n, sum(b) OVER w AS bytes, sum(i::INT) OVER w AS ids FROM e WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT seq, n <= 800 AND bytes <= 6000 AND ids <= 60 AS fits FROM r""",
)
def fold_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"), F.length("props").alias("bytes"), F.lit("all").alias("chunk"), F.lit(0).alias("chunk_bytes"))
    return snapshots.plan_fold(e, snapshots.Budgets(entries=800, log_bytes=6000, ids=60))


# Export


@query("infer_columns", "SELECT key AS field, count(*) AS n, bool_or(json_type(v) = 'VARCHAR') AS has_string, bool_or(json_type(v) = 'BOOLEAN') AS has_boolean, bool_or(json_type(v) IN ('UBIGINT', 'BIGINT')) AS has_int32, bool_or(json_type(v) = 'DOUBLE') AS has_number, bool_or(json_type(v) IN ('OBJECT', 'ARRAY')) AS has_nested, bool_or(json_type(v) = 'NULL') AS has_null, 'integer' AS sql_type FROM (SELECT e.key, e.value AS v FROM events, json_each(events.props) e) GROUP BY key")
def infer_columns(spark, sf_dir):
    view = bodies(spark, sf_dir).df
    return export.field_kinds(view).withColumn("sql_type", export.lattice(True))


@query("infer_mixed", "SELECT * FROM (VALUES ('cust', 'jsonb'), ('extra', 'boolean'), ('n', 'text'), ('tags', 'jsonb')) AS t(field, sql_type)")
def infer_mixed(spark, sf_dir):
    return export.field_kinds(nested(spark, sf_dir).df).select("field", export.lattice(True).alias("sql_type"))


@query("insert_statements", """SELECT event_id::VARCHAR AS _id, 'INSERT INTO "events" ("_id", "k") VALUES (''' || event_id || ''', ' || (props->>'$.k') || ');' AS statement FROM events""")
def insert_statements(spark, sf_dir):
    view = bodies(spark, sf_dir).df.withColumn("_id", F.col("_id").cast("string"))
    plan = export.ExportPlan("postgres", "events", (export.ColumnPlan("_id", "text", False, False), export.ColumnPlan("k", "integer", True, False)), 0)
    return export.insert_statements(view, plan)


@query("dump_canonical", """SELECT doc_id::VARCHAR AS _id, '{"_id":"' || doc_id || '","lang":"' || lang || '","source":"' || source || '"}' AS value FROM documents""")
def dump_canonical(spark, sf_dir):
    from foldlake.sources.ndjson import canonical_lines

    d = table(spark, sf_dir, "documents")
    return canonical_lines(d.select(F.col("doc_id").cast("string").alias("_id"), F.to_variant_object(F.struct("source", "lang")).alias("body")))


@query("content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# Maintenance

KEYS = """SELECT c_custkey, 'app/a/tenant/t/manifests/' || lower(c_mktsegment) || '/snapshot/L9/' || lpad((c_custkey)::VARCHAR, 12, '0') || '-' || lpad((c_custkey + 5)::VARCHAR, 12, '0') || '-' || sha256(c_custkey::VARCHAR) || CASE WHEN c_custkey % 11 = 0 THEN '.tmp' ELSE '.json' END AS key FROM customer"""


def key_list(spark, sf_dir) -> DataFrame:
    num = lambda c: F.lpad(c.cast("string"), 12, "0")
    k = F.col("c_custkey")
    return customers(spark, sf_dir).select(
        "c_custkey",
        F.concat(
            F.lit("app/a/tenant/t/manifests/"), F.lower("c_mktsegment"), F.lit("/snapshot/L9/"), num(k), F.lit("-"), num(k + 5), F.lit("-"),
            F.sha2(k.cast("string").cast("binary"), 256), F.when(k % 11 == 0, ".tmp").otherwise(".json"),
        ).alias("key"),
    )


NOW = "TIMESTAMP '2024-06-01 00:00:00'"


@query("collection_discovery", f"SELECT DISTINCT split_part(split_part(key, '/manifests/', 2), '/', 1) AS collection FROM ({KEYS})")
def collection_discovery(spark, sf_dir):
    return maintenance.discover_collections(key_list(spark, sf_dir))


@query("orphan_mark", f"SELECT key, {NOW} + INTERVAL 7 DAY AS due_at, 'orphan-snapshot' AS reason, 'g2' AS generation FROM ({KEYS}) WHERE c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 ORDER BY key LIMIT 1000")
def orphan_mark(spark, sf_dir):
    keys = key_list(spark, sf_dir)
    return maintenance.mark_orphans(keys, None, keys.filter("c_custkey % 3 = 0"), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")), "g2")


LEDGER = f"""SELECT c_custkey, key, {NOW} + (c_custkey % 5 - 2) * INTERVAL 1 DAY AS due_at,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'g1' ELSE 'g2' END AS generation FROM ({KEYS})"""
CURRENT = "(SELECT key FROM keyed WHERE c_custkey = 4)"
VERDICT = f"""WITH keyed AS ({LEDGER}) SELECT key, CASE WHEN generation IS NULL OR key LIKE '%.tmp' THEN 'evict' WHEN generation <> 'g2' THEN 'drop'
  WHEN key = {CURRENT} THEN 'rescue' WHEN due_at > {NOW} THEN 'wait' WHEN c_custkey + 5 >= 800 THEN 'blocked' ELSE 'sweep' END AS verdict FROM keyed"""


def classified(spark, sf_dir) -> DataFrame:
    keys = key_list(spark, sf_dir)
    now = F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    due = F.expr(f"{NOW.replace('TIMESTAMP', 'TIMESTAMP_NTZ')} + make_dt_interval(CAST(c_custkey % 5 - 2 AS INT))")
    gen = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 7 == 1, "g1").otherwise("g2")
    ledger = keys.select("key", due.alias("due_at"), gen.alias("generation"))
    current = keys.filter("c_custkey = 4").first()["key"]
    return maintenance.classify_candidates(ledger, "g2", current, 800, now)


@query("gc_classify", VERDICT)
def gc_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("key", "verdict")


@query("gc_sweep", f"SELECT key FROM ({VERDICT}) WHERE verdict = 'sweep' ORDER BY (SELECT 1), key LIMIT 1000")
def gc_sweep(spark, sf_dir):
    return maintenance.sweep(classified(spark, sf_dir))[0]


@query("retention_range", "SELECT c_custkey, c_custkey AS retire_from, greatest(c_custkey, least(c_custkey * 3 - 1024, c_custkey + 20)) AS retire_to FROM customer")
def retention_range(spark, sf_dir):
    heads = customers(spark, sf_dir).select("c_custkey", F.col("c_custkey").alias("log_delete_floor"), (F.col("c_custkey") * 3).alias("log_seq_start"))
    return maintenance.retention_ranges(heads).select("c_custkey", "retire_from", "retire_to")


USAGE = """SELECT event_type AS collection, count(*) AS entries, CASE WHEN count(*) > 1 THEN (count(*) - 1) / greatest(1.0 / 60, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6) ELSE NULL END AS writes_per_minute
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 120 GROUP BY event_type"""



@query("usage_rate", f"SELECT collection, entries, round(writes_per_minute, 6) AS writes_per_minute, CASE WHEN writes_per_minute >= 30 THEN 'error' WHEN writes_per_minute >= 15 THEN 'warn' WHEN writes_per_minute IS NULL THEN 'info' ELSE 'ok' END AS severity FROM ({USAGE})")
def usage_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("event_id").alias("seq"), F.col("ts").alias("commit_ts"))
    return maintenance.usage(e).withColumn("writes_per_minute", F.round("writes_per_minute", 6))


@query("cost_projection", f"SELECT collection, round(writes_per_minute * 43200 * 1.8, 3) AS monthly_ops, round(greatest(0, writes_per_minute * 43200 * 1.8 - 1000000) / 1e6 * 4.5, 6) AS monthly_cost FROM ({USAGE})")
def cost_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("event_id").alias("seq"), F.col("ts").alias("commit_ts"))
    return maintenance.cost_projection(maintenance.usage(e), 1.8).select("collection", F.round("monthly_ops", 3).alias("monthly_ops"), F.round("monthly_cost", 6).alias("monthly_cost"))


@query("metrics_summary", "SELECT event_type AS name, CASE WHEN event_type IN ('click', 'view') THEN 'counter' WHEN event_type = 'error' THEN 'gauge' ELSE 'histogram' END AS kind, round(CASE WHEN event_type = 'error' THEN arg_max(value, event_id) ELSE sum(value) END, 4) AS value, count(*) AS n FROM events GROUP BY event_type")
def metrics_summary(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t.isin("click", "view"), "counter").when(t == "error", "gauge").otherwise("histogram")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), kind.alias("kind"), t.alias("name"), "value")
    return maintenance.metrics_summary(e).withColumn("value", F.round("value", 4))


@query("op_percentiles", "SELECT event_type AS kind, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY event_type")
def op_percentiles(spark, sf_dir):
    return maintenance.op_rollup(table(spark, sf_dir, "events"), "event_type", "value").withColumn("share", F.round("share", 9))


@query("op_accounting", f"SELECT CASE c_custkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'PUT' ELSE 'LIST' END AS method, 'app/a' AS prefix, count(*) AS n, sum(length(key))::BIGINT AS bytes FROM ({KEYS}) GROUP BY ALL")
def op_accounting(spark, sf_dir):
    m = F.when(F.col("c_custkey") % 3 == 0, "GET").when(F.col("c_custkey") % 3 == 1, "PUT").otherwise("LIST")
    return maintenance.account(key_list(spark, sf_dir).select(m.alias("method"), "key", F.length("key").cast("bigint").alias("bytes")))


@query("inspect_summary", f"SELECT NULL::VARCHAR AS snapshot, 0 AS log_seq_start, (SELECT max(event_id) + 1 FROM events) AS tail, (SELECT count(*) FROM ({FOLD.format(where='')})) AS rows, (SELECT count(*) FROM ({KEYS}) WHERE c_custkey % 11 <> 0) AS orphan_snapshots")
def inspect_summary(spark, sf_dir):
    log = event_log(spark, sf_dir)
    start = log.agg(F.min("seq")).first()[0]
    out = maintenance.inspect({"snapshot": None, "log_seq_start": start}, log, fold.fold(log), key_list(spark, sf_dir))
    return out.withColumn("log_seq_start", F.col("log_seq_start") - start).withColumn("snapshot", F.lit(None).cast("string"))


@query("session_anti_join", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'user')")
def session_anti_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return maintenance.session_misses(c.select("conv_id", "turn"), c.filter("role = 'user'"), ["conv_id", "turn"])


@query("monotonic_reads", "SELECT session, read_no, seq, before FROM (SELECT user_id AS session, event_id AS read_no, (value * 10)::BIGINT AS seq, max((value * 10)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT user_id, event_id, floor(value) AS value FROM events)) WHERE seq < before")
def monotonic_reads(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("read_no"), (F.floor("value") * 10).alias("seq"))
    return maintenance.monotonic_violations(e)


# Statistics


@query("quantiles", "SELECT l_returnflag, quantile_disc(l_quantity, 0.9) AS rank90, round(quantile_cont(l_extendedprice, 0.9), 6) AS r7_90 FROM lineitem GROUP BY l_returnflag")
def quantiles(spark, sf_dir):
    li, by = table(spark, sf_dir, "lineitem"), ["l_returnflag"]
    rank, r7 = stats.quantiles(li, "l_quantity", {"rank90": ("rank", 0.9)}, by), stats.quantiles(li, "l_extendedprice", {"r7_90": ("r7", 0.9)}, by)
    return stats.beside(rank, r7, by).withColumn("r7_90", F.round("r7_90", 6))


@query("mad", "SELECT round(median, 6) AS median, round(quantile_cont(abs(l_extendedprice - median), 0.5), 6) AS mad FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem) GROUP BY median")
def mad(spark, sf_dir):
    return stats.mad(table(spark, sf_dir, "lineitem"), "l_extendedprice").select(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("ols_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def ols_simple(spark, sf_dir):
    o = stats.ols_simple(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")
    return o.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("failure_bounds", "SELECT event_type, round((p + 2.7055434540954144 / (2 * n) + 1.6448536269514722 * sqrt(p * (1 - p) / n + 2.7055434540954144 / (4 * n * n))) / (1 + 2.7055434540954144 / n), 8) AS wilson, round(1 - pow(0.05, 1.0 / n), 8) AS zero_failures FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 90) / count(*) AS p FROM events GROUP BY event_type)")
def failure_bounds(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 90, 1)).alias("k"))
    return g.select("event_type", F.round(stats.wilson_upper(F.col("k"), F.col("n")), 8).alias("wilson"), F.round(stats.zero_failure_upper(F.col("n")), 8).alias("zero_failures"))


def _cramer(names: list[str], y: str, source: str) -> str:
    """SQL of a linear regression on three columns by Cramer's rule over covariances."""
    cov = lambda a, b: f"covar_pop({a}, {b})"
    m = [[f"s{i}{j}" for j in range(3)] for i in range(3)]

    def det(q):
        return f"({q[0][0]} * ({q[1][1]} * {q[2][2]} - {q[1][2]} * {q[2][1]}) - {q[0][1]} * ({q[1][0]} * {q[2][2]} - {q[1][2]} * {q[2][0]}) + {q[0][2]} * ({q[1][0]} * {q[2][1]} - {q[1][1]} * {q[2][0]}))"

    terms = [f"{det([[f'c{i}' if j == k else m[i][j] for j in range(3)] for i in range(3)])} / {det(m)} AS b{k}" for k in range(3)]
    sums = [f"{cov(names[i], names[j])} AS s{i}{j}" for i in range(3) for j in range(3)] + [f"{cov(n, y)} AS c{i}, avg({n}) AS a{i}" for i, n in enumerate(names)]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS term, round(b{i}, 3) AS beta FROM b" for i, n in enumerate(names))
    return f"WITH s AS (SELECT {', '.join(sums)}, avg({y}) AS ay FROM {source}), b AS (SELECT *, {', '.join(terms)} FROM s) SELECT 'intercept' AS term, round(ay - b0 * a0 - b1 * a1 - b2 * a2, 3) AS beta FROM b UNION ALL {rows}"


@query("ols_multiple", _cramer(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "lineitem"))
def ols_multiple(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    beta, rss = stats.ols(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(n, round(float(b), 3)) for n, b in zip(["intercept", "l_quantity", "l_discount", "l_tax"], beta, strict=True)], "term string, beta double")


@query("bootstrap_median")
def bootstrap_median(spark, sf_dir):
    return stats.bootstrap_by(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal", rounds=100)
