import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents of (doc_id, text) pairs, with clashing extra columns."""

    def build(pairs, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("score", "bucket", "shard", "blob", "found", "class_id", "_id", "_m", "m", "digest"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build


#: Nulls, empty, wordless, repeated rows and ids, ties, and a very long text.
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "!!! ???"), (5, "one"), (5, "one"), (5, "two words"), (None, "no id at all here"), (None, None), (6, "word " * 40000), (7, "é😀 ñ ß"), (8, "one")]
