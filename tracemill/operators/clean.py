"""Slices, quality gates, cleaning and normalising of traces.

Frames are long rows (recording_id, unit_id, frame, value) with NULL for missing values. All
windows are per unit, so their partitions are bounded by a recording's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ["recording_id", "unit_id"]


def nan_to_null(df: DataFrame, col: str = "value") -> DataFrame:
    """NaN becomes NULL, which aggregates skip."""
    return df.withColumn(col, F.when(~F.isnan(col), F.col(col)))


def epoch_slice(df: DataFrame, start: float, end: float, n_frames: int, unit: str = "frames", fps: float = 1.0) -> DataFrame:
    """Frames of [start, end), given in frames, seconds or minutes and clamped to the recording; fails if nothing is left."""
    rate = {"frames": 1.0, "sec": fps, "min": 60.0 * fps}[unit]
    first, last = max(0, int(start * rate)), min(n_frames, int(end * rate)) - 1
    if last < first:
        raise ValueError("the epoch is empty")
    return df.filter(F.col("frame").between(first, last))


def fixed_periods(df: DataFrame, start: int, frames_per_period: int, periods: int = 4) -> DataFrame:
    """Adds period 0, 1, ...; periods include both ends, so a boundary frame belongs to two."""
    into = F.col("frame") - start
    k = F.floor(into / frames_per_period).cast("int")
    both = F.when(into % frames_per_period == 0, F.array(k - 1, k)).otherwise(F.array(k))
    return df.withColumn("period", F.explode(both)).filter(F.col("period").between(0, periods - 1))


def unit_qc_finite(df: DataFrame, n_frames: int, least_share: float = 0.95, least_std: float = 0.0) -> DataFrame:
    """Units with enough values and more than ``least_std`` of spread."""
    return df.groupBy(*UNIT).agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd")).filter((F.col("n") >= least_share * n_frames) & (F.col("sd") > least_std)).select(*UNIT)


def unit_qc_shared(df: DataFrame, positions: DataFrame, low: tuple[int, int], high: tuple[int, int], most_missing: float = 0.2) -> DataFrame:
    """Units with enough values in both windows and a complete position."""
    def enough(window):
        first, last = window
        return F.count(F.when(F.col("frame").between(first, last), F.col("value"))) >= (1 - most_missing) * (last - first + 1)

    kept = df.groupBy(*UNIT).agg(enough(low).alias("a"), enough(high).alias("b")).filter("a and b").select(*UNIT)
    return kept.join(positions.filter("x is not null and y is not null and z is not null"), UNIT, "left_semi")


def drop_nan_zero_units(df: DataFrame) -> DataFrame:
    """Rows of units without a missing value that are not all zero."""
    good = df.groupBy(*UNIT).agg(F.bool_and(F.col("value").isNotNull()).alias("whole"), F.bool_or(F.col("value") != 0).alias("any")).filter("whole and any")
    return df.join(good.select(*UNIT), UNIT, "left_semi")


def band_filter(df: DataFrame, low: float, high: float, col: str = "dom") -> DataFrame:
    return df.filter(F.col(col).between(low, high))


def valid_frames(events: DataFrame, n_frames: int) -> DataFrame:
    """Distinct whole event frames inside the recording."""
    return events.select("recording_id", F.round("frame").cast("int").alias("frame")).filter(F.col("frame").between(0, n_frames - 1)).distinct()


def peri_margin(events: DataFrame, peri: int, n_frames: int) -> DataFrame:
    """Events whose whole surrounding of ``peri`` frames lies inside the recording."""
    return events.filter((F.col("frame") > peri - 1) & (F.col("frame") < n_frames - 1 - peri))


def min_interval_thin(events: DataFrame, least_gap: int) -> DataFrame:
    """Drops an event that follows the one before it, itself kept or not, too closely."""
    before = F.lag("frame").over(Window.partitionBy("recording_id").orderBy("frame"))
    return events.withColumn("gap", F.col("frame") - before).filter(F.col("gap").isNull() | (F.col("gap") >= least_gap)).drop("gap")


def min_count_gate(events: DataFrame, least: int) -> DataFrame:
    """Rows of recordings with at least ``least`` events; their counts meet the rows in a join."""
    enough = events.groupBy("recording_id").count().filter(F.col("count") >= least).select("recording_id")
    return events.join(enough, "recording_id", "left_semi")


def fill_missing(df: DataFrame, by: list[str] = UNIT) -> DataFrame:
    """Linear between neighbours, nearest at the ends, 0 for a unit without values."""
    w = Window.partitionBy(*by).orderBy("frame")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("value").isNotNull(), F.struct("frame", "value"))
    a, b = F.last(known, True).over(before), F.first(known, True).over(after)
    line = a["value"] + (b["value"] - a["value"]) * (F.col("frame") - a["frame"]) / (b["frame"] - a["frame"])
    filled = F.coalesce(F.col("value"), F.when(a["frame"] != b["frame"], line), a["value"], b["value"], F.lit(0.0))
    return df.withColumn("value", filled)


def zscore(value: Column, over) -> Column:
    """(x - mean) / sd (n - 1) over a window; sd 0 or unknown counts as 1, missing results as 0."""
    sd = F.stddev_samp(value).over(over)
    return F.coalesce((value - F.avg(value).over(over)) / F.when(sd > 0, sd).otherwise(1.0), F.lit(0.0))


def zscore_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("value", zscore(F.col("value"), Window.partitionBy(*UNIT)))


def zscore_column(df: DataFrame, col: str, out: str = "z") -> DataFrame:
    """z-score of a summary column over all rows, 0 where there is no spread; the two moments are broadcast by Spark."""
    moments = df.agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    return df.crossJoin(F.broadcast(moments)).withColumn(out, F.when(F.col("_s") > 0, (F.col(col) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def dff(df: DataFrame, smooth: int, window: int) -> DataFrame:
    """Percent change over a trailing baseline: the minimum over ``window`` frames of the mean over ``smooth`` frames."""
    w = Window.partitionBy(*UNIT).orderBy("frame")
    smoothed = df.withColumn("smooth", F.avg("value").over(w.rowsBetween(1 - smooth, 0)))
    base = smoothed.withColumn("base", F.min("smooth").over(w.rowsBetween(1 - window, 0)))
    return base.withColumn("dff", F.when(F.col("base") != 0, (F.col("value") - F.col("base")) / F.col("base") * 100)).drop("smooth", "base")


def clip(value: Column, low: float, high: float) -> Column:
    """The value held inside [low, high]; a missing value stays missing (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def normalize01(df: DataFrame, by: list[str], col: str = "value") -> DataFrame:
    """Minimum to 0 and maximum to 1 within each group; a flat group becomes NULL."""
    w = Window.partitionBy(*by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(col, F.when(high > low, (F.col(col) - low) / (high - low)))


def detrend(df: DataFrame) -> DataFrame:
    """Removes each unit's least-squares line; missing values count as 0."""
    full = df.withColumn("value", F.coalesce("value", F.lit(0.0)))
    w = Window.partitionBy(*UNIT)
    line = F.regr_slope("value", "frame").over(w) * F.col("frame") + F.regr_intercept("value", "frame").over(w)
    return full.withColumn("value", F.col("value") - line)


def freq_bin_label(df: DataFrame, positions: DataFrame, low: float = 0.0, high: float = 0.10, bins: int = 11, col: str = "dom") -> DataFrame:
    """Units with position and frequency bin (1 to ``bins``; the last includes its upper edge); NULL outside."""
    width = (high - low) / bins
    k = F.floor((F.col(col) - low) / width) + 1
    label = F.when((F.col(col) >= low) & (F.col(col) <= high), F.least(k, F.lit(bins))).cast("int")
    return df.join(positions, UNIT).withColumn("bin", label).withColumn("in_bin", F.col("bin").isNotNull())
