"""Staged tables: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset in a local session; elsewhere executors would not share that."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return _OWN[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Written and read back, which cuts lineage and survives lost executors. The files go when the session ends."""
    path = scratch(spark, label) + "/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Failures:
    """What kernels could not work on: rows with the operator, the keys of the failed row and the reason, kept aside while the good rows go on.

    Operators that take ``failed`` write what their kernel returns once, hand its failed rows here, and read on from its good rows.
    """

    def __init__(self) -> None:
        self._parts: list[DataFrame] = []

    def good(self, results: DataFrame, operator: str, keys: list[str]) -> DataFrame:
        """The good rows of kernel results (keys..., outputs..., error), without that column."""
        rows = staged(results.sparkSession, results, "kernel")
        told = F.create_map(*[x for c in keys for x in (F.lit(c), F.col(c).cast("string"))])
        self._parts.append(rows.filter("error is not null").select(F.lit(operator).alias("operator"), told.alias("keys"), "error"))
        return rows.filter("error is null").drop("error")

    def table(self, spark: SparkSession) -> DataFrame:
        """(operator, keys, error) of everything that failed so far."""
        if not self._parts:
            return spark.createDataFrame([], "operator string, keys map<string,string>, error string")
        return reduce(DataFrame.unionByName, self._parts)


def good_rows(results: DataFrame, operator: str, keys: list[str], failed: Failures | None) -> DataFrame:
    """Kernel results that have no error; the others go to ``failed``, where it is given."""
    return results.filter("error is null").drop("error") if failed is None else failed.good(results, operator, keys)


#: Bytes of a batch of rows with long arrays that a Python worker gets.
BATCH_BYTES = 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size in this session, unless its configuration names a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(BATCH_BYTES))
