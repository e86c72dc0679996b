"""NDJSON: documents read as (_id, body), and written in canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a document id may be.
MAX_ID_BYTES = 256
BAD_ID = r"[/\x00-\x1f\x7f]|^_|^$"


def id_ok(id_col):
    return id_col.isNotNull() & ~id_col.rlike(BAD_ID) & (F.octet_length(id_col) <= MAX_ID_BYTES)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(_id, body VARIANT). The read fails at the first line that is no object with a good string ``_id``."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    body = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(body, "$._id", "variant"))
    doc_id = F.try_variant_get(body, "$._id", "string")
    good = F.coalesce((kind == "STRING") & id_ok(doc_id), F.lit(False))
    checked = F.when(good, doc_id).otherwise(F.raise_error(F.concat(F.lit("SchemaError: bad document: "), F.substring("value", 1, 200))))
    return lines.select(checked.alias("_id"), body.alias("body"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_id").count().filter("count > 1")


def canonical_lines(view: DataFrame) -> DataFrame:
    """(_id, value): each document as one line with sorted keys and its ``_id`` inside, as Spark prints VARIANT."""
    rest = F.regexp_replace(F.to_json("body"), r"^\{", "")
    has_id = F.try_variant_get("body", "$._id", "variant").isNotNull()
    ident = F.regexp_replace(F.regexp_replace(F.to_json(F.to_variant_object(F.array("_id"))), r"^\[", ""), r"\]$", "")
    plain = F.concat(F.lit('{"_id":'), ident, F.when(rest == "}", rest).otherwise(F.concat(F.lit(","), rest)))
    # Keys before "_id" in the order (capitals, "_A") exist: let VARIANT sort them all.
    sorted_all = F.to_json(F.parse_json(plain))
    return view.select("_id", F.when(has_id, F.to_json("body")).otherwise(sorted_all).alias("value"))


def write_ndjson(view: DataFrame, path: str) -> None:
    """Lines in id order over the files' order."""
    canonical_lines(view).orderBy("_id").select("value").write.text(path)
