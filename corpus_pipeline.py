"""A corpus pipeline over ``documents`` in five stages, each of which writes its result for the next.

1. toxicity: documents with a toxicity score of 0.5 or more go.
2. near_duplicates: of each group of documents that are linked by a Jaccard similarity of 0.8 or more of
   their five-word shingles, the one with the least id stays.
3. decontamination: documents with a passage of a benchmark item (47 characters or more, verbatim or nearly) go.
4. secrets: spans found by the secret scan are masked.
5. packing: length buckets and token-budget batches of the documents that are left.

Stages 1 to 4 return the columns of ``documents``; each works on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldlake.llm import decontaminate, ngram_join, packing, secrets, toxicity
from foldlake.llm.common import saved

STAGES = [
    ("toxicity", toxicity.reject_stage),
    ("near_duplicates", ngram_join.keep_one_stage),
    ("decontamination", decontaminate.filter_stage),
    ("secrets", secrets.redact_stage),
    ("packing", packing.pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted classifier and the dynamic programming cannot be told in SQL; tests compare with brute force.
ORACLE_SQL = None
