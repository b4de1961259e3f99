"""Low against high activity: the skeleton that most analyses of a recording share.

Events to onsets, sliding windows ranked by onset count, the least and most active window per
recording, any per-unit feature in both, and a paired rank test per recording.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clean, joins, stats, windows


def low_high_windows(events: DataFrame, n_frames: int, window: int, step: int) -> DataFrame:
    """(recording_id, label, n, start, end): the windows with the fewest and the most onsets."""
    onsets = clean.valid_frames(events, n_frames)
    recordings = onsets.select("recording_id").distinct().withColumn("n_frames", F.lit(n_frames))
    counts = joins.count_in_windows(onsets, windows.sliding_windows(recordings, window, step), step)
    return windows.rank_windows(counts)


def window_slices(arrays: DataFrame, picked: DataFrame) -> DataFrame:
    """(recording_id, label, unit_id, trace): each unit's trace inside the picked windows of its recording."""
    listed = picked.select("recording_id", "label", "start", "end")
    both = arrays.join(listed, "recording_id")
    return both.select("recording_id", "label", "unit_id", F.slice("trace", F.col("start") + 1, F.col("end") - F.col("start") + 1).alias("trace"))


def known_mean(trace: Column) -> Column:
    """Mean of the values that are there."""
    known = F.filter(trace, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def compare(arrays: DataFrame, picked: DataFrame, feature: Callable[[Column], Column], least: int, p: bool = True) -> DataFrame:
    """(recording_id, n, w, ties, median[, p]): paired test of a feature of a window's trace over units with ``least`` values in both windows."""
    inside = window_slices(arrays, picked)
    enough = F.size(F.filter("trace", lambda x: x.isNotNull())) >= least
    at = lambda label: F.max(F.when(F.col("label") == label, F.col("v")))
    both = inside.filter(enough).select("recording_id", "unit_id", "label", feature(F.col("trace")).alias("v")).groupBy("recording_id", "unit_id").agg(at("low").alias("low"), at("high").alias("high"))
    return stats.signrank(both.filter("low is not null and high is not null"), ["recording_id"], "high", "low", p)
