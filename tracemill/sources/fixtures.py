"""The logical tables of a recording, derived from the given tables.

Frames count from 0. Unit identity is (recording_id, unit_id). Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples per second of the derived traces.
FPS = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, unit_id, trace): one row per unit."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("recording_id"), F.col("vec_id").alias("unit_id"), F.col("embedding").cast("array<double>").alias("trace"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, unit_id, frame, value): the long form of ``trace_arrays``."""
    return explode_traces(trace_arrays(spark, sf_dir))


def explode_traces(arrays: DataFrame) -> DataFrame:
    return arrays.select("recording_id", "unit_id", F.posexplode("trace").alias("frame", "value"))


def explode_recordings(arrays: DataFrame) -> DataFrame:
    """(recording_id, frame, value) of one trace per recording."""
    return arrays.select("recording_id", F.posexplode("trace").alias("frame", "value"))


def gappy_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traces`` with every fifth sample missing, at a place that differs by unit."""
    missing = (F.col("unit_id") * 7 + F.col("frame")) % 5 == 0
    return traces(spark, sf_dir).withColumn("value", F.when(~missing, F.col("value")))


def gappy_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gappy_traces`` as one row per unit."""
    hole = lambda x, i: F.when((F.col("unit_id") * 7 + i) % 5 != 0, x)
    return trace_arrays(spark, sf_dir).withColumn("trace", F.transform("trace", hole))


def sparse_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, unit_id, frame, value): sales per supplier and 28 days, with irregular frames."""
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    frame = F.floor(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) / 28).cast("int")
    return sold.groupBy((F.col("s_nationkey") % 5).alias("recording_id"), F.col("l_suppkey").alias("unit_id"), frame.alias("frame")).agg(F.sum("l_extendedprice").alias("value"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, unit_id, x, y, z)."""
    e = table(spark, sf_dir, "embeddings")
    place = [(F.col("vec_id") % n).cast("double").alias(axis) for axis, n in (("x", 37), ("y", 23), ("z", 11))]
    return e.select(F.col("label").alias("recording_id"), F.col("vec_id").alias("unit_id"), *place)


def event_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, event_id, kind, frame, amp): frame is the hour since 2024-01-01."""
    e = table(spark, sf_dir, "events")
    hour = F.expr("cast(floor((unix_timestamp(ts) - unix_timestamp(TIMESTAMP_NTZ'2024-01-01 00:00:00')) / 3600) as int)")
    return e.select((F.col("user_id") % 5).alias("recording_id"), "event_id", F.col("event_type").alias("kind"), hour.alias("frame"), F.col("value").alias("amp"))


#: Frames of the event train's clock.
EVENT_FRAMES = 720


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, unit_id, trial, rel_frame, value): a trace folded into trials of 8 frames."""
    t = traces(spark, sf_dir)
    return t.select(F.col("recording_id").alias("subject_id"), "unit_id", F.floor(F.col("frame") / 8).cast("int").alias("trial"), (F.col("frame") % 8).alias("rel_frame"), "value")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, cond, frame, value): hourly sums of three sessions per subject."""
    day = F.dayofmonth("ts")
    cond = F.when(day <= 10, "high").when(day <= 20, "mid").otherwise("low")
    frame = ((day - 1) % 10 * 24 + F.hour("ts")).cast("int")
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("subject_id"), cond.alias("cond"), frame.alias("frame")).agg(F.sum("value").alias("value"))
