"""Shared helpers: the shared folder, written intermediate tables, folds."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without one gets a folder under /tmp for as long as the process lives; on a
    cluster that would be another folder on every machine, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    path = f"/tmp/foldlake-shared-{os.getpid()}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def new_folder(spark: SparkSession, name: str) -> str:
    """The full address of a fresh folder in the shared one, which is deleted when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return files.makeQualified(path).toString()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    """
    path = new_folder(df.sparkSession, name) + "/rows"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: Bytes of rows that go to a Python worker at once, in a session that does not set them.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def batched(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on bounds the bytes of a batch for Python workers: rows alone do not, texts being of any length.

    A row that is longer than the bound is a batch of its own.
    """
    if df.sparkSession.conf.get(_BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem
