"""Ordered windows over frames: smoothing, runs, sliding windows, phase and resampling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import UNIT


def _along(by: list[str], order: str = "frame"):
    return Window.partitionBy(*by).orderBy(order)


def moving_mean(df: DataFrame, k: int, by: list[str] = UNIT, col: str = "value", out: str | None = None) -> DataFrame:
    """Centred mean of k frames with shrinking ends; an even k reaches one further back."""
    return df.withColumn(out or col, F.avg(col).over(_along(by).rowsBetween(-(k // 2), k - 1 - k // 2)))


def gaussian_smooth(df: DataFrame, k: int, by: list[str] = UNIT, col: str = "value", out: str | None = None) -> DataFrame:
    """Gaussian-weighted mean of k frames (sigma k / 5), renormalised at the ends and over missing values."""
    w = _along(by)
    total = norm = F.lit(0.0)
    for i in range(-(k // 2), k - k // 2):
        v, g = F.lag(col, -i).over(w), math.exp(-0.5 * (i / (k / 5)) ** 2)
        total, norm = total + F.coalesce(v * g, F.lit(0.0)), norm + F.when(v.isNotNull(), g).otherwise(0.0)
    return df.withColumn(out or col, F.when(norm > 0, total / norm))


def exp_causal_filter(df: DataFrame, tau: float, rate: float, by: list[str] = UNIT, col: str = "value", out: str | None = None) -> DataFrame:
    """Convolution with exp(-t / tau) over the last 2 tau seconds."""
    w, total = _along(by), F.lit(0.0)
    for k in range(int(2 * tau * rate) + 1):
        total = total + F.coalesce(F.lag(col, k).over(w), F.lit(0.0)) * math.exp(-k / (tau * rate))
    return df.withColumn(out or col, total)


def gradient(df: DataFrame, by: list[str] = UNIT, col: str = "value", t: str = "frame", out: str = "gradient") -> DataFrame:
    """Central differences along time, one-sided at the ends."""
    w = _along(by, t)
    v, at = F.col(col), F.col(t)
    before, after, t0, t1 = F.lag(v).over(w), F.lead(v).over(w), F.lag(at).over(w), F.lead(at).over(w)
    return df.withColumn(out, F.coalesce((after - before) / (t1 - t0), (after - v) / (t1 - at), (v - before) / (at - t0)))


def difference(df: DataFrame, rectify: bool = False, by: list[str] = UNIT, col: str = "value", out: str = "diff") -> DataFrame:
    """First difference, 0 at the first frame; optionally only increases."""
    d = F.coalesce(F.col(col) - F.lag(col).over(_along(by)), F.lit(0.0))
    return df.withColumn(out, F.greatest(d, F.lit(0.0)) if rectify else d)


def runs(df: DataFrame, on: str, by: list[str] = UNIT, order: str = "frame") -> DataFrame:
    """(by..., run, start, end, length): maximal runs of rows where ``on`` holds."""
    w = _along(by, order)
    flag = F.coalesce(F.col(on), F.lit(False))
    starts = (flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    marked = df.withColumn("_on", flag).withColumn("_start", starts).withColumn("run", F.sum("_start").over(w))
    return marked.filter("_on").groupBy(*by, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"))


def drop_short_runs(df: DataFrame, on: str, least: int, by: list[str] = UNIT) -> DataFrame:
    return runs(df, on, by).filter(F.col("length") >= least)


def merge_and_delete(df: DataFrame, on: str, fill: int, delete: int, by: list[str] = UNIT, order: str = "frame") -> DataFrame:
    """(by..., start, end): events after gaps of at most ``fill`` frames between them are filled and then events of at most ``delete`` frames dropped.

    Frames are dense, so a gap is the distance of two runs.
    """
    r = runs(df, on, by, order)
    w = _along(by, "start")
    fresh = r.withColumn("_new", F.coalesce((F.col("start") - F.lag("end").over(w) - 1 > fill).cast("int"), F.lit(1)))
    merged = fresh.withColumn("_id", F.sum("_new").over(w)).groupBy(*by, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.filter(F.col("end") - F.col("start") + 1 > delete).drop("_id")


def sliding_windows(recordings: DataFrame, window: int, step: int) -> DataFrame:
    """(recording_id, win, start, end) for recordings (recording_id, n_frames); full windows only, ends included."""
    starts = F.posexplode(F.sequence(F.lit(0), F.col("n_frames") - window, F.lit(step)))
    fit = recordings.filter(F.col("n_frames") >= window)
    return fit.select("recording_id", starts.alias("win", "start")).withColumn("end", F.col("start") + window - 1)


def rank_windows(counts: DataFrame, col: str = "n") -> DataFrame:
    """Per recording the windows with the fewest (``low``) and the most (``high``) events, the first on ties."""
    by = counts.groupBy("recording_id").agg(
        F.min(F.struct(F.col(col), "start", "end")).alias("low"),
        F.max(F.struct(F.col(col), (-F.col("start")).alias("neg"), "start", "end")).alias("high"),
    )
    pick = lambda k: F.struct(F.lit(k).alias("label"), F.col(f"{k}.{col}").alias(col), F.col(f"{k}.start").alias("start"), F.col(f"{k}.end").alias("end"))
    return by.select("recording_id", F.explode(F.array(pick("low"), pick("high"))).alias("w")).select("recording_id", "w.*")


def unwrap_phase(df: DataFrame, by: list[str] = UNIT, col: str = "phase", out: str = "unwrapped") -> DataFrame:
    """Phase without jumps of more than pi."""
    w = _along(by)
    d = F.col(col) - F.lag(col).over(w)
    turns = df.withColumn("_fix", F.coalesce(-F.round(d / (2 * math.pi)), F.lit(0.0)))
    return turns.withColumn(out, F.col(col) + 2 * math.pi * F.sum("_fix").over(w)).drop("_fix")


def instantaneous_freq(df: DataFrame, fps: float, by: list[str] = UNIT, col: str = "phase", smooth: int | None = None) -> DataFrame:
    """Frequency from the phase's first difference; NULL at the first frame."""
    u = unwrap_phase(df, by, col)
    out = u.withColumn("freq", (F.col("unwrapped") - F.lag("unwrapped").over(_along(by))) * fps / (2 * math.pi))
    return gaussian_smooth(out, max(3, smooth), by, "freq") if smooth else out


def local_maxima(df: DataFrame, by: list[str] = UNIT, col: str = "value", least: float | None = None) -> DataFrame:
    """Rows higher than both neighbours (the first row of a plateau); the ends are never peaks."""
    w = _along(by)
    step = df.withColumn("_prev", F.lag(col).over(w))
    changes = step.filter(F.col("_prev").isNull() | (F.col(col) != F.col("_prev"))).drop("_prev")
    peaks = changes.withColumn("_p", F.lag(col).over(w)).withColumn("_n", F.lead(col).over(w)).filter((F.col(col) > F.col("_p")) & (F.col(col) > F.col("_n"))).drop("_p", "_n")
    return peaks if least is None else peaks.filter(F.col(col) >= least)


def resize(df: DataFrame, n: int, by: list[str] = UNIT, col: str = "value") -> DataFrame:
    """(by..., k, value): each series resized to n samples by linear interpolation."""
    m = Window.partitionBy(*by)
    rows = df.withColumn("_n", F.count(F.lit(1)).over(m)).withColumn("_i", F.row_number().over(_along(by)) - 1)
    rows = rows.withColumn("_next", F.lead(col).over(_along(by)))
    step = (F.col("_n") - 1) / F.lit(float(n - 1))
    first, last = F.ceil((F.col("_i") - 1e-9) / step), F.ceil((F.col("_i") + 1 - 1e-9) / step) - 1
    last = F.when(F.col("_i") == F.col("_n") - 1, F.lit(n - 1)).otherwise(last)
    grid = rows.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    part = F.col("k") * step - F.col("_i")
    return grid.select(*by, F.col("k").cast("int").alias("k"), (F.col(col) + F.when(part > 1e-9, part * (F.col("_next") - F.col(col))).otherwise(0.0)).alias(col))


def rank_within(df: DataFrame, by: list[str], col: str, out: str = "rank") -> DataFrame:
    """Rank with mean ranks on ties, for groups that are small by design; NULL values keep a NULL rank and come last."""
    r = F.rank().over(Window.partitionBy(*by).orderBy(F.col(col).asc_nulls_last()))
    ties = F.count(col).over(Window.partitionBy(*by, col))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), r + (ties - 1) / 2.0))


def dominant_mode_per_frame(df: DataFrame) -> DataFrame:
    """(recording_id, frame, mode): mode with the largest absolute mean trace; the lowest mode on ties."""
    return df.groupBy("recording_id", "frame").agg(F.max(F.struct(F.abs("value").alias("a"), (-F.col("mode")).alias("m"))).alias("best")).select("recording_id", "frame", (-F.col("best.m")).alias("mode"))
