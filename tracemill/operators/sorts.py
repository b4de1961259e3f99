"""Top shares, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import beside, places


def top_fraction(df: DataFrame, by: list[str], col: str, share: float, tie: str) -> DataFrame:
    """The best max(1, round(share n)) rows of each group."""
    ranked = places(df, by, -F.col(col), [F.desc(col), tie], "_k")
    return ranked.filter(F.col("_k") <= F.greatest(F.lit(1), F.round(share * F.col("_k_all")))).drop("_k", "_k_all")


def position_in_order(df: DataFrame, by: list[str], lead: Column, order: list, out: str = "place") -> DataFrame:
    """Place of each row (from 0) in the order of its group: what a sort permutation holds. ``lead`` is a number that never falls along ``order``."""
    return places(df, by, lead, order, out).withColumn(out, (F.col(out) - 1).cast("int")).drop(f"{out}_all")


def evenly_picked(df: DataFrame, by: list[str], col: str, n: int, tie: str) -> DataFrame:
    """n rows of each group, evenly spread over the order of a column."""
    numbered = places(df, by, F.col(col), [col, tie], "_k")
    want = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(1 + i * (F.col("_k_all") - 1) / max(1, n - 1)))
    return numbered.filter(F.array_contains(want, F.col("_k").cast("double"))).drop("_k", "_k_all")


def most_changed(features: DataFrame, n: int) -> DataFrame:
    """(recording_id, unit_id, score, place): the n units of each recording that gain most in event duration and area from low to high.

    ``features`` (recording_id, label, unit_id, n, dur, auc). The score is the z of one difference plus the
    z of the other, 0 where there is no spread, over the units that have both; in a recording without such
    units it is the number of events. Ties go to the smaller unit.
    """
    at = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    wide = features.groupBy("recording_id", "unit_id").agg((at("high", "dur") - at("low", "dur")).alias("dd"), (at("high", "auc") - at("low", "auc")).alias("da"), F.sum("n").alias("events"))
    valid = F.col("dd").isNotNull() & F.col("da").isNotNull()
    moments = [f(F.when(valid, F.col(c))).alias(f"{k}_{c}") for c in ("dd", "da") for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    told = beside(wide, wide.groupBy("recording_id").agg(*moments, F.count(F.when(valid, 1)).alias("valid")), ["recording_id"])
    z = lambda c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
    score = F.when(F.col("valid") == 0, F.col("events").cast("double")).when(valid, z("dd") + z("da"))
    scored = told.select("recording_id", "unit_id", F.round(score, 9).alias("score")).filter("score is not null")
    return places(scored, ["recording_id"], -F.col("score"), [F.desc("score"), "unit_id"]).filter(F.col("place") <= n).drop("place_all")


def sessions_on_one_clock(df: DataFrame, by: list[str], session: str, order: list[str], t: str = "t", step: float = 1.0) -> DataFrame:
    """Sessions one after the other: each is shifted by the length of those before it plus one step."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(session))
    length = df.groupBy(*by, session).agg((F.max(t) + step).alias("_len"))
    shift = F.coalesce(F.sum("_len").over(Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.join(length.withColumn("_shift", shift).drop("_len"), [*by, session]).withColumn(t, F.col(t) + F.col("_shift")).drop("_shift")


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")
