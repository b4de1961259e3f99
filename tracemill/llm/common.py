"""Helpers shared by the text operators: table access, staged tables, column checks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read through Spark so that any store it knows works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset in a local session,
    as in tests, a folder of our own is used; elsewhere executors would not share that.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return f"file://{_OWN_DIR[0]}"


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of files, never a recomputation of
    the plan above, and the returned frame carries no partitioning of its own, so that
    joins on it are planned (and their skew split) afresh. The files go when the session ends.
    """
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that a Python worker gets: bounds what a task holds of long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size in this session, unless its configuration names sizes of its own."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.sparkContext.getConf().get(key) is None:
            spark.conf.set(key, str(most))


def release(*memories: dict) -> None:
    """Empties what a task remembered, so that idle Python workers hold no more than their libraries."""
    for memory in memories:
        memory.clear()
    pa.default_memory_pool().release_unused()


def text_or_empty(col: str):
    """The text column with null counted as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(columns: list[str], stem: str = "_row") -> str:
    """A name that no column begins with. Spark tells columns apart without case, so this does too."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(stem) for c in taken):
        stem += "_"
    return stem


def quoted(name: str) -> str:
    """A column's name as Spark's resolver takes it literally, dots too."""
    return f"`{name}`"
