"""Joins of recordings, windows, events and clocks.

Range joins always carry the recording and a bucket of frames as equality keys, so Spark plans
them as hash or sort-merge joins and never as nested loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two artefact lists that share a key."""
    return a.join(b, key)


def having_both(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Rows of ``a`` whose key also occurs in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def positional_zip(a: DataFrame, b: DataFrame, by: list[str], order_a: str, order_b: str, col_a: str, col_b: str) -> DataFrame:
    """(by..., k, col_a, col_b): rows paired by their number within the group, up to the shorter side."""
    def numbered(df, order, col, name):
        return df.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).alias("k"), F.col(col).alias(name))

    return numbered(a, order_a, col_a, "a").join(numbered(b, order_b, col_b, "b"), [*by, "k"])


def events_in_windows(events: DataFrame, windows: DataFrame, bucket: int) -> DataFrame:
    """(window columns, event columns) for events inside windows (start to end, both included).

    A window is listed in every bucket of ``bucket`` frames that it touches, an event in its own.
    """
    listed = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    own = events.withColumn("_b", F.floor(F.col("frame") / bucket))
    return listed.join(own, ["recording_id", "_b"]).filter(F.col("frame").between(F.col("start"), F.col("end"))).drop("_b")


def count_in_windows(events: DataFrame, windows: DataFrame, bucket: int) -> DataFrame:
    """Each window with the number of its events, 0 included."""
    n = events_in_windows(events.select("recording_id", "frame"), windows, bucket).groupBy("recording_id", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    return windows.join(n, ["recording_id", "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def trailing_rate(samples: DataFrame, events: DataFrame, window: int, per: float) -> DataFrame:
    """(recording_id, frame, rate): events of the last ``window`` frames at each sample, the sample's own included, times per / window."""
    both = samples.select("recording_id", "frame", F.lit(0).alias("_e")).unionByName(events.select("recording_id", "frame", F.lit(1).alias("_e")))
    n = F.sum("_e").over(Window.partitionBy("recording_id").orderBy("frame").rangeBetween(-window, 0))
    return both.withColumn("rate", n * per / window).filter("_e = 0").select("recording_id", "frame", "rate")


def nearest(points: DataFrame, grid: list[float], col: str, out: str = "nearest") -> DataFrame:
    """Adds the index of the nearest of a few grid values, the lowest on ties; no join is needed."""
    gaps = F.array(*[F.struct(F.abs(F.col(col) - g).alias("gap"), F.lit(i).alias("i")) for i, g in enumerate(grid)])
    return points.withColumn(out, F.array_min(gaps)["i"])


def nearest_frame(left: DataFrame, right: DataFrame) -> DataFrame:
    """(recording_id, frame, nearest): the right frame nearest to each left frame, the earlier one on ties.

    Both sides are merged on one clock; the last and the next right frame come from windows.
    """
    both = left.select("recording_id", "frame", F.lit(None).cast("int").alias("_r"), F.lit(1).alias("_left")).unionByName(right.select("recording_id", "frame", F.col("frame").alias("_r"), F.lit(0).alias("_left")))
    w = Window.partitionBy("recording_id").orderBy("frame", "_left")
    before = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = F.when(after.isNull() | (F.col("frame") - before <= after - F.col("frame")), before).otherwise(after)
    return both.withColumn("nearest", near).filter("_left = 1").select("recording_id", "frame", "nearest").distinct()


def interpolate_to(series: DataFrame, clock: DataFrame, by: list[str], outside: str = "null") -> DataFrame:
    """(by..., t, value): series (by..., t, value) on another clock (by..., t), linear between samples.

    Of equal times the first row counts. ``outside``: ``null``, ``zero``, ``nearest`` or ``extend``
    (the line of the first or last two samples). Rows of a group lie on one clock in one window.
    """
    known = series.filter(F.col("value").isNotNull() & F.col("t").isNotNull()).groupBy(*by, "t").agg(F.first("value").alias("value"))
    w = Window.partitionBy(*by).orderBy("t")
    here = F.struct("t", "value")
    known = known.withColumn("_next", F.lead(here).over(w)).withColumn("_prev", F.lag(here).over(w))
    known = known.select(*by, "t", F.struct("t", "value", "_prev", "_next").alias("_s"), F.lit(0).alias("_q"))
    wanted = clock.select(*by, "t").distinct().withColumn("_s", F.lit(None).cast(known.schema["_s"].dataType)).withColumn("_q", F.lit(1))
    v = Window.partitionBy(*by).orderBy("t", "_q")
    both = known.unionByName(wanted)
    both = both.withColumn("_a", F.last("_s", True).over(v.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_s", True).over(v.rowsBetween(0, Window.unboundedFollowing)))
    a, b, t = F.col("_a"), F.col("_b"), F.col("t")

    def line(p: Column, q: Column) -> Column:
        return p["value"] + (q["value"] - p["value"]) * (t - p["t"]) / (q["t"] - p["t"])

    inside = F.when(a["t"] == t, a["value"]).when(a.isNotNull() & b.isNotNull(), line(a, b))
    ends = {
        "null": F.lit(None).cast("double"), "zero": F.lit(0.0), "nearest": F.coalesce(a["value"], b["value"]),
        "extend": F.when(a.isNull(), line(b, b["_next"])).otherwise(line(a["_prev"], a)),
    }[outside]
    value = F.when(a.isNull() | b.isNull(), F.when(a["t"] == t, a["value"]).otherwise(ends)).otherwise(inside)
    return both.filter("_q = 1").select(*by, "t", value.alias("value"))


#: Parts that the units of a recording are dealt to when each meets each: tasks of a recording are pairs of parts.
PARTS = 12


def _part(unit: str) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(PARTS)).cast("int")


def unit_pairs(units: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs a < b of units within a recording, with the given columns of both sides.

    Units are dealt into parts; each pair of parts is a join key of its own, so no task holds a recording.
    """
    side = lambda s: units.select("recording_id", F.col("unit_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    a = side("a").withColumn("_p", _part("a")).withColumn("_q", F.col("_other")).drop("_other")
    b = side("b").withColumn("_p", F.col("_other")).withColumn("_q", _part("b")).drop("_other")
    return a.hint("merge").join(b, ["recording_id", "_p", "_q"]).filter("a < b").drop("_p", "_q")


def rectangle_pairs(units: DataFrame, columns: list[str], inside: Column) -> DataFrame:
    """Pairs of a unit inside a set with a unit outside it, within a recording; dealt into parts as ``unit_pairs`` are."""
    side = lambda s, own: units.filter(own).select("recording_id", F.col("unit_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    a = side("a", inside).withColumn("_p", _part("a")).withColumn("_q", F.col("_other")).drop("_other")
    b = side("b", ~inside).withColumn("_p", F.col("_other")).withColumn("_q", _part("b")).drop("_other")
    return a.hint("merge").join(b, ["recording_id", "_p", "_q"]).drop("_p", "_q")


def peri_event(arrays: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(recording_id, unit_id, event, lag, value): each unit's samples around each event whose surrounding is whole."""
    e = events.select("recording_id", F.col("frame").alias("event")).distinct()
    cut = arrays.join(e, "recording_id").filter((F.col("event") >= before) & (F.col("event") + after < F.size("trace")))
    part = F.slice("trace", F.col("event") - before + 1, before + after + 1)
    return cut.select("recording_id", "unit_id", "event", F.posexplode(part).alias("k", "value")).select("recording_id", "unit_id", "event", (F.col("k") - before).alias("lag"), "value")


def assignment_agreement(a: DataFrame, b: DataFrame, by: list[str], unit: str, mode: str) -> DataFrame:
    """(by..., common, equal, jaccard): share of common units with equal mode, and overlap of the unit sets."""
    both = a.select(*by, unit, F.col(mode).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*by, unit, F.col(mode).alias("_b"), F.lit(1).alias("_ib")), [*by, unit], "full_outer")
    common = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    return both.groupBy(*by).agg(F.count(F.when(common, 1)).alias("common"), F.avg(F.when(common, (F.col("_a") == F.col("_b")).cast("double"))).alias("equal"), (F.count(F.when(common, 1)) / F.count(F.lit(1))).alias("jaccard"))


def grid_points(df: DataFrame, x: str, y: str, nx: int, ny: int, by: list[str]) -> DataFrame:
    """(by..., gi, gj, gx, gy): an even grid over each group's range."""
    r = df.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    g = r.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("gj", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    return g.select(*by, "gi", "gj", (F.col("x0") + F.col("gi") * (F.col("x1") - F.col("x0")) / (nx - 1)).alias("gx"), (F.col("y0") + F.col("gj") * (F.col("y1") - F.col("y0")) / (ny - 1)).alias("gy"))


def common_span(series: DataFrame, group: str, member: str) -> DataFrame:
    """(group, start, end, dt): latest start, earliest end and median step over the members; groups without overlap are left out."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy(group, member).orderBy("t"))
    per = series.withColumn("_dt", step).groupBy(group, member).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.median("_dt").alias("d"))
    return per.groupBy(group).agg(F.max("a").alias("start"), F.min("b").alias("end"), F.median("d").alias("dt")).filter("start <= end")


def leave_one_out_mean(df: DataFrame, by: list[str], col: str = "value", out: str = "others") -> DataFrame:
    """Mean of the other rows of the group; NULL for a lone row."""
    w = Window.partitionBy(*by)
    n = F.count(col).over(w)
    return df.withColumn(out, F.when(n > 1, (F.sum(col).over(w) - F.col(col)) / (n - 1)))


def session_pairs(units: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """(subject_id, k, a, b): the first recording of two sessions per subject, units paired by number."""
    w = Window.partitionBy("subject_id", "session")
    kept = units.withColumn("_r", F.min("recording_id").over(w)).filter("recording_id = _r")
    side = lambda s: kept.filter(F.col("session") == s)
    return positional_zip(side(first), side(second), ["subject_id"], "unit_id", "unit_id", value, value)
