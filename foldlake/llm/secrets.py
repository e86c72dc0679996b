"""Secret scans with an incremental blob ledger (native).

Texts are content-addressed: a blob is the SHA-256 of a text. The ledger is a table in a folder with one
row per (blob, rule version) that was ever scanned and the spans found. A scan takes historical
versions of documents, keeps each blob once, drops the pairs that the ledger has, scans the rest with
built-in functions and appends them as one batch. Findings are then joined back to every path (document,
or document and version) that ever held the blob. A scan of what the ledger has already scans nothing.

Batches are told apart by name and seen whole: a batch counts once Spark's writer has marked it done,
so a scan that was lost leaves the ledger as it was. Two scans at one time may both append a pair;
readers keep one row of a pair.

Defined cases: a null text is the empty text and has no findings; repeated rows and copies
share one ledger row and each gets the findings; a null doc_id stays null; an empty table gives
no rows and appends nothing; a text of any length is scanned whole; matches of one kind that start
at one place cannot be, those of several kinds stand in the order of the rules; columns other than
the id and the text are ignored, whatever their names.

Spans are counted in code points, end exclusive. A match's start is the summed length of what
lies before it: the pieces between matches (``split``) and the matches (``regexp_extract_all``),
both from the same leftmost non-overlapping scan.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm.common import documents, free_name, new_folder, saved, text_of


@dataclass(frozen=True)
class Rule:
    """``hint``: a cheap pattern without which ``pattern`` cannot match. ``least``: characters that ``group`` must have."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base patterns, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)pass|secret|token|api", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", 0, 20, True),
    # Runs of hexadecimal digits that reach 24 are exactly the maximal runs that long.
    Rule("hex", 1, r"[0-9a-f]{24,}", "[0-9a-f]{24}", 0, 24, True),
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{30,}", "gh[pousr]_"),
)
RULES = BASE_RULES + ADDED_RULES
SPAN = "struct<start:int,order:int,kind:string,end:int,base:boolean>"
LEDGER = f"blob string, rule string, version int, spans array<{SPAN}>"
#: A session's setting that names the folder of a ledger to go on with.
SETTING = "spark.foldlake.secrets.ledger"


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of spans of one rule, by start."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(hits, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else lengths
    step = F.arrays_zip(gaps.alias("gap"), lengths.alias("len"), sizes.alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.base).alias("base"))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(step, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def blobs(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """(blob, text), each blob once; copies are combined before the shuffle."""
    text = text_of(F.col(text_col))
    return versions.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def scan(blob_rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, version, spans): a ledger row for each blob and rule."""
    per_rule = [
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _spans(F.col("text"), r, RULES.index(r) if r in RULES else len(RULES) + i).alias("spans"))
        for i, r in enumerate(rules)
    ]
    return blob_rows.select("blob", F.explode(F.array(*per_rule)).alias("x")).select("blob", "x.*")


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger rows to append: those of blob and rule-version pairs that ``ledger`` lacks.

    A blob for which all rules are known is dropped before any pattern runs; for the others
    the rules that are known for it are skipped.
    """
    todo = blobs(versions, text_col)
    if ledger is None:
        return scan(todo, rules)
    wanted = [F.concat_ws(":", F.lit(r.kind), F.lit(str(r.version))) for r in rules]
    known = ledger.select(F.col("blob").alias("_b"), F.concat_ws(":", "rule", F.col("version").cast("string")).alias("_r")).groupBy("_b").agg(F.collect_set("_r").alias("_known"))
    todo = todo.join(known, F.col("blob") == F.col("_b"), "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    todo = todo.filter(F.size(F.array_except(F.array(*wanted), F.col("_known"))) > 0)
    per_rule = [
        F.when(
            ~F.array_contains("_known", w),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _spans(F.col("text"), r, RULES.index(r) if r in RULES else len(RULES) + i).alias("spans")),
        )
        for i, (r, w) in enumerate(zip(rules, wanted, strict=True))
    ]
    return todo.select("blob", F.explode(F.array(*per_rule)).alias("x")).filter("x IS NOT NULL").select("blob", "x.*")


def findings(ledger: DataFrame) -> DataFrame:
    """(blob, found): all spans of a blob, by start and then by the order of kinds. Blobs without spans are left out."""
    hits = ledger.filter(F.size("spans") > 0)
    return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))


class Ledger:
    """The ledger in a folder: batches of rows, each written once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._files = path, path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        """Folders of the batches that were finished."""
        if not self._files.exists(self._path(self.folder)):
            return []
        found = [str(s.getPath().toString()) for s in self._files.listStatus(self._path(self.folder))]
        return sorted(b for b in found if self._files.exists(self._path(f"{b}/_SUCCESS")))

    def rows(self) -> DataFrame | None:
        """One row a pair; None before the first batch."""
        batches = self._batches()
        return self.spark.read.schema(LEDGER).parquet(*batches).dropDuplicates(["blob", "rule", "version"]) if batches else None

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> int:
        """Scan what is unseen of ``versions`` and append it; how many pairs that were."""
        batch = f"{self.folder}/batch-{uuid.uuid4().hex}"
        new = update_ledger(versions, self.rows(), rules, text_col)
        new.withColumn("version", F.col("version").cast("int")).repartition(F.col("blob")).write.parquet(batch)
        return self.spark.read.schema(LEDGER).parquet(batch).count()

    def found(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found) by these rules and versions of them."""
        rows = self.rows()
        if rows is None:
            return self.spark.createDataFrame([], f"blob string, found array<{SPAN}>")
        return findings(rows.filter(F.concat_ws(":", "rule", "version").isin([f"{r.kind}:{r.version}" for r in rules])))


def join_paths(versions: DataFrame, found: DataFrame, paths: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(…paths, blob, found) for every row of ``versions``.

    A blob may be the text of a third of all rows: so the findings, few and small, are written first, and
    the join reads tables only; a partition that one blob makes large is then read by several
    tasks (adaptive skew joins).
    """
    found = saved(found, "findings").withColumnRenamed("blob", "_blob")
    rows = versions.select(*[F.col(p) for p in paths], F.sha2(text_of(F.col(text_col)).cast("binary"), 256).alias("blob"))
    empty = F.array().cast(f"array<{SPAN}>")
    return rows.join(found, F.col("blob") == F.col("_blob"), "left").select(*paths, "blob", F.coalesce("found", empty).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``paths``, blob and spans of every row, by way of the ledger; a new one in the shared folder if none is given.

    A session may name the folder of a ledger to go on with, in the setting ``SETTING``.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, spark.conf.get(SETTING, None) or new_folder(spark, "ledger"))
    ledger.scan(docs, rules, text_col)
    return join_paths(docs, ledger.found(rules), paths, text_col)


def op10_secret_scans(spark, sf_dir):
    rows = scan_documents(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "blob",
    )


def redact_stage(spark, docs, sf_dir, mask: str = "[SECRET]"):
    """Pipeline stage: every span found is replaced by ``mask``; no document goes.

    ``n_chars`` is counted anew where it was the text's length. Null texts stay null.
    """
    rows = scan_documents(docs)
    key, blob, own, found, clean = (free_name(docs, f"_{x}") for x in ("key", "blob", "own", "found", "clean"))
    # Rows of one id may differ in text, so the blob belongs to the key.
    hits = rows.filter(F.size("found") > 0).select(F.col("doc_id").alias(key), F.col("blob").alias(blob), F.col("found").alias(found)).dropDuplicates([key, blob])
    text = F.col("text")

    def cut(acc, s):
        piece = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], piece, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    masked = F.when(F.col(found).isNull(), text).otherwise(F.aggregate(found, begin, cut, rest))
    joined = docs.withColumn(own, F.sha2(text_of(text).cast("binary"), 256))
    joined = joined.join(hits, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(blob)), "left").withColumn(clean, masked)

    def column(name):
        if name == "text":
            return F.col(clean).alias(name)
        if name == "n_chars":
            return F.when(F.col(found).isNull(), F.col(name)).otherwise(F.length(clean)).cast(docs.schema[name].dataType).alias(name)
        return F.col(f"`{name}`")

    return joined.select(*map(column, docs.columns))


def _rule_sql(rule: Rule, order: int) -> str:
    """(r, start, ord, kind, stop, base) of one rule: the same gaps and matches, in DuckDB's functions."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT r, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start,
  {order} AS ord, '{rule.kind}' AS kind, length(hits[i]) AS n, {str(rule.base).lower()} AS base
FROM (SELECT r, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {rule.group}) AS groups FROM t WHERE regexp_matches(text, '{pattern}')) AS x{order}, unnest(generate_series(1, len(hits))) AS g{order}(i)
WHERE length(groups[i]) >= {rule.least}"""


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
f AS (SELECT r, string_agg(kind || ':' || start || ':' || start + n, ',' ORDER BY start, ord) AS spans,
        string_agg(kind || ':' || start || ':' || start + n, ',' ORDER BY start, ord) FILTER (WHERE base) AS base_spans,
        {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)} FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, sha256(text) AS blob FROM t LEFT JOIN f ON t.r = f.r
"""

QUERIES = {"op10_secret_scans": op10_secret_scans}
ORACLES: dict[str, str] = {"op10_secret_scans": SQL}
