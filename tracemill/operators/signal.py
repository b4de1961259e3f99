"""Spectra, autocorrelation, filters and beats.

Kernels run on array rows in Arrow batches, one row per unit, many rows at a time where the
kernel allows it; everything after them (bands, peaks, widths) is column arithmetic on long spectra.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.batches import matrices, output
from ..sources.staging import Failures, bounded_batches, good_rows, staged
from .aggregates import mad, mean_curve, trapz
from .clean import UNIT, fill_missing
from .joins import interpolate_to
from .ranks import beside, running, value_counts
from .windows import drop_short_runs, gaussian_smooth, gradient, moving_mean, runs


def per_trace(arrays: DataFrame, fn: Callable[[np.ndarray], dict], schema: str, keys: list[str] = UNIT, col: str = "trace", rows: bool = False) -> DataFrame:
    """Applies a kernel to the trace of each row; ``schema`` names its outputs.

    With ``rows`` the kernel takes a matrix of equally long traces and returns a row of each output
    per trace. A row that fails gets NULLs and the reason in ``error``; see ``sources.recordings.split_errors``.
    """
    kinds = dict(arrays.dtypes)
    names = dict(part.split() for part in schema.split(", "))
    full = ", ".join([f"{c} {kinds[c]}" for c in keys] + [schema, "error string"])
    bounded_batches(arrays.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = {n: [None] * batch.num_rows for n in names}
            errors: list[str | None] = ["no trace"] * batch.num_rows

            def put(at, x):
                got = fn(x)
                for j, i in enumerate(at):
                    for n in names:
                        cells[n][i] = got[n][j] if rows else got[n]
                    errors[i] = None

            for at, x in matrices(batch.column(len(keys))):
                if not x.shape[1]:
                    for i in at:
                        errors[i] = "empty trace"
                    continue
                x = k.finite(x)
                try:
                    if rows:
                        put(at, x)
                        continue
                except Exception:  # the rows one by one, to tell which of them fail
                    pass
                for j, i in enumerate(at):
                    try:
                        put([i], x[j : j + 1] if rows else x[j])
                    except Exception as e:  # one bad recording must not stop the others
                        errors[i] = f"{type(e).__name__}: {e}"
            out = [output(n, kind, cells[n]) for n, kind in names.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *out, pa.array(errors, pa.string())], names=[*keys, *names, "error"])

    return arrays.select(*keys, F.col(col).cast("array<double>").alias(col)).mapInArrow(run, full)


def collect_traces(df: DataFrame, keys: list[str] = UNIT, order: str = "frame", col: str = "value") -> DataFrame:
    """Long rows to one array per unit, in order; a unit's length bounds the array."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.coalesce(col, F.lit(float("nan"))).alias("v")))).alias("_s"))
    return rows.select(*keys, F.col("_s.v").alias("trace"))


def acf(arrays: DataFrame, max_lag: int) -> DataFrame:
    return per_trace(arrays, lambda x: {"acf": k.acf(x, max_lag)}, "acf array<double>", rows=True)


def long_acf(arrays: DataFrame, max_lag: int, failed: Failures | None = None) -> DataFrame:
    """(recording_id, unit_id, lag, r)"""
    return good_rows(acf(arrays, max_lag), "acf", UNIT, failed).select(*UNIT, F.posexplode("acf").alias("lag", "r"))


def acf_peaks(arrays: DataFrame, fps: float, min_sec: float, max_sec: float, prominence: float) -> DataFrame:
    """(recording_id, unit_id, n_peaks, first_lag, first_freq): peaks of the autocorrelation between two lags."""
    low, high = int(min_sec * fps), int(max_sec * fps)

    def fn(x):
        at, _ = k.find_peaks(k.acf(x, high)[low:], prominence=prominence)
        return {"n_peaks": len(at), "first_lag": (at[0] + low) / fps if len(at) else None, "first_freq": fps / (at[0] + low) if len(at) and at[0] + low else None}

    return per_trace(arrays, fn, "n_peaks int, first_lag double, first_freq double")


def acf_peak_filter(arrays: DataFrame, fps: float, min_sec: float = 10, max_sec: float = 120, prominence: float = 0.08, least: int = 2) -> DataFrame:
    """Units with at least ``least`` autocorrelation peaks."""
    good = acf_peaks(arrays, fps, min_sec, max_sec, prominence).filter(F.col("n_peaks") >= least).select(*UNIT)
    return arrays.join(good, UNIT, "left_semi")


def welch_spectra(arrays: DataFrame, fps: float, window: int, overlap: int, nfft: int, kind: str = "hann", keys: list[str] = UNIT, failed: Failures | None = None) -> DataFrame:
    """(keys..., f, pxx): Welch spectrum per row."""
    make = {"hann": k.hann, "hamming": k.hamming}[kind]

    def fn(x):
        f, p = k.welch(x, fps, make(window), overlap, nfft)
        return {"fs": [f] * len(x), "ps": p}

    s = good_rows(per_trace(arrays, fn, "fs array<double>, ps array<double>", keys, rows=True), "welch", keys, failed)
    return s.select(*keys, F.explode(F.arrays_zip("fs", "ps")).alias("s")).select(*keys, F.col("s.fs").alias("f"), F.col("s.ps").alias("pxx"))


def dominant_freq(spectra: DataFrame, low: float, high: float, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., dom, power): frequency of the largest power in the band, the lowest on ties."""
    best = spectra.filter(F.col("f").between(low, high)).groupBy(*keys).agg(F.max(F.struct("pxx", (-F.col("f")).alias("nf"))).alias("b"))
    return best.select(*keys, (-F.col("b.nf")).alias("dom"), F.col("b.pxx").alias("power"))


def band_power(spectra: DataFrame, low: float, high: float, keys: list[str] = UNIT, integral: bool = False) -> DataFrame:
    band = spectra.filter(F.col("f").between(low, high))
    return trapz(band, keys, "f", "pxx", "power") if integral else band.groupBy(*keys).agg(F.sum("pxx").alias("power"))


def normalise_spectrum(spectra: DataFrame, mode: str, low: float, high: float, keys: list[str] = UNIT, eps: float = 1e-12) -> DataFrame:
    """Unit area in the band (of the whole spectrum, if it has fewer than two bins there), maximum 1, or as it is."""
    if mode == "none":
        return spectra
    if mode == "max":
        return spectra.withColumn("pxx", F.col("pxx") / F.greatest(F.max("pxx").over(Window.partitionBy(*keys)), F.lit(eps)))
    w, band = Window.partitionBy(*keys).orderBy("f"), F.col("f").between(low, high)
    part = (F.col("f") - F.lag("f").over(w)) * (F.col("pxx") + F.lag("pxx").over(w)) / 2
    rows = spectra.withColumn("_p", part).withColumn("_in", band & F.lag(band).over(w)).withColumn("_b", band.cast("int"))
    whole = Window.partitionBy(*keys)
    area = F.when(F.sum("_b").over(whole) >= 2, F.sum(F.when(F.col("_in"), F.col("_p"))).over(whole)).otherwise(F.sum("_p").over(whole))
    return rows.withColumn("pxx", F.col("pxx") / F.greatest(area, F.lit(eps))).drop("_p", "_in", "_b")


def freq_to_hz(spectra: DataFrame, fps: float, keys: list[str] = UNIT) -> DataFrame:
    """Frequencies in radians or cycles per sample, told by their largest value, to Hz."""
    top = F.max("f").over(Window.partitionBy(*keys))
    return spectra.withColumn("f", F.when(top <= 0.5 + 1e-9, F.col("f") * fps).when(top <= math.pi + 1e-9, F.col("f") * fps / (2 * math.pi)).otherwise(F.col("f")))


def q_factor(spectra: DataFrame, low: float, high: float, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., dom, fwhm, q): width at half maximum by linear interpolation on both sides of the peak; NULL without both crossings."""
    dom = dominant_freq(spectra, low, high, keys)
    rows = spectra.join(dom, keys)
    w = Window.partitionBy(*keys).orderBy("f")
    rows = rows.withColumn("_f1", F.lead("f").over(w)).withColumn("_p1", F.lead("pxx").over(w)).withColumn("_h", F.col("power") / 2)
    cross = F.col("f") + (F.col("_h") - F.col("pxx")) * (F.col("_f1") - F.col("f")) / (F.col("_p1") - F.col("pxx"))
    up = (F.col("_f1") <= F.col("dom")) & (F.col("pxx") <= F.col("_h")) & (F.col("_p1") > F.col("_h"))
    down = (F.col("f") >= F.col("dom")) & (F.col("pxx") > F.col("_h")) & (F.col("_p1") <= F.col("_h"))
    g = rows.groupBy(*keys, "dom").agg(F.max(F.when(up, cross)).alias("_l"), F.min(F.when(down, cross)).alias("_r"))
    width = F.col("_r") - F.col("_l")
    return g.select(*keys, "dom", width.alias("fwhm"), F.when(width > 0, F.col("dom") / width).alias("q"))


def q_factor_simple(spectra: DataFrame, low: float, high: float, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., q): peak over the span of frequencies at half its power or more."""
    band = spectra.filter(F.col("f").between(low, high)).join(dominant_freq(spectra, low, high, keys), keys)
    wide = F.when(F.col("pxx") >= F.col("power") / 2, F.col("f"))
    g = band.groupBy(*keys, "dom").agg((F.max(wide) - F.min(wide)).alias("_w"))
    return g.select(*keys, F.when(F.col("_w") > 0, F.col("dom") / F.col("_w")).alias("q"))


def occupied_bandwidth(spectra: DataFrame, low: float, high: float, share: float = 0.99, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., obw): span between the frequencies where the cumulated in-band power passes the two tails."""
    band = spectra.filter(F.col("f").between(low, high))
    w = Window.partitionBy(*keys)
    cum = band.withColumn("_c", F.sum("pxx").over(w.orderBy("f")) / F.sum("pxx").over(w))
    tail = (1 - share) / 2
    return cum.groupBy(*keys).agg((F.min(F.when(F.col("_c") >= 1 - tail, F.col("f"))) - F.min(F.when(F.col("_c") >= tail, F.col("f")))).alias("obw"))


def windowed_peak_freq(arrays: DataFrame, fps: float, window: int, hop: int, low: float, high: float, keys: list[str] = UNIT, failed: Failures | None = None) -> DataFrame:
    """(keys..., start, freq): dominant frequency of each hop window. A trace that is shorter than a window has none and counts as failed."""
    if failed is not None:
        short = F.when(F.col("trace").isNull(), "no trace").when(F.size("trace") < window, "shorter than a window")
        arrays = good_rows(arrays.select(*keys, "trace", short.alias("error")), "windows", keys, failed)
    starts = F.explode(F.sequence(F.lit(0), F.size("trace") - window, F.lit(hop))).alias("start")
    cut = arrays.filter(F.size("trace") >= window).select(*keys, "trace", starts).withColumn("trace", F.slice("trace", F.col("start") + 1, window))
    spectra = welch_spectra(cut, fps, window, window // 2, window, keys=[*keys, "start"], failed=failed)
    return dominant_freq(spectra, low, high, [*keys, "start"]).select(*keys, "start", F.col("dom").alias("freq"))


def bout_peak_freq(df: DataFrame, bouts: DataFrame, fps: float, low: float, high: float, least_sec: float = 0.3, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., run, freq, error): dominant frequency inside each bout (keys..., run, start, end) that lasts long enough."""
    long = bouts.filter((F.col("end") - F.col("start") + 1) >= least_sec * fps)
    inside = df.join(long.select(*keys, "run", "start", "end"), keys).filter(F.col("frame").between(F.col("start"), F.col("end")))
    arrays = collect_traces(inside, [*keys, "run"])

    def fn(x):
        length = x.shape[1]
        f, p = k.welch(x - x.mean(axis=1, keepdims=True), fps, k.hann(length), 0, 2 ** math.ceil(math.log2(max(8, length))))
        band = (f >= low) & (f <= high)
        return {"freq": f[band][np.argmax(p[:, band], axis=1)] if band.any() else np.full(len(x), np.nan)}

    return per_trace(arrays, fn, "freq double", [*keys, "run"], rows=True)


def bandpass(arrays: DataFrame, fps: float, low: float, high: float, order: int = 3, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., trace, error): zero-phase Butterworth band-pass."""
    sections = k.butter_bandpass(order, low, high, fps)
    return per_trace(arrays, lambda x: {"trace": k.filtfilt(sections, x)}, "trace array<double>", keys, rows=True)


def analytic_signal(arrays: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., phase, amp, error) arrays."""
    def fn(x):
        z = k.analytic(x)
        return {"phase": np.angle(z), "amp": np.abs(z)}

    return per_trace(arrays, fn, "phase array<double>, amp array<double>", keys, rows=True)


def long_phases(signals: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., frame, phase, amp) of analytic signals."""
    return signals.select(*keys, F.posexplode(F.arrays_zip("phase", "amp")).alias("frame", "z")).select(*keys, "frame", "z.phase", "z.amp")


def resample_rate(arrays: DataFrame, rate_in: float, rate_out: float, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., trace, error): resampled with anti-aliasing."""
    return per_trace(arrays, lambda x: {"trace": k.resample(x, rate_in, rate_out)}, "trace array<double>", keys, rows=True)


def peak_list(arrays: DataFrame, height: float = -math.inf, prominence: float = 0.0, distance: int = 0, keys: list[str] = UNIT, failed: Failures | None = None) -> DataFrame:
    """(keys..., frame, value, prominence): local maxima by height, then prominence, then tallest first at a distance."""
    def fn(x):
        at, prom = k.find_peaks(x, height, prominence, distance)
        return {"at": at.tolist(), "heights": x[at], "proms": prom}

    found = good_rows(per_trace(arrays, fn, "at array<int>, heights array<double>, proms array<double>", keys), "peaks", keys, failed)
    return found.select(*keys, F.explode(F.arrays_zip("at", "heights", "proms")).alias("p")).select(*keys, F.col("p.at").alias("frame"), F.col("p.heights").alias("value"), F.col("p.proms").alias("prominence"))


def hemisphere_split(positions: DataFrame, axis: str) -> DataFrame:
    """Adds side 0 (lower) or 1: the exact 2-means split of one axis, from prefix sums in two levels."""
    rows = staged(positions.sparkSession, running(positions, ["recording_id"], F.col(axis), [axis, "unit_id"], {"_n": F.lit(1), "_s": F.col(axis)}), "sides")
    n, s, m, t = (F.col(c) for c in ("_n", "_s", "_n_all", "_s_all"))
    gain = F.round(F.when(n < m, s**2 / n + (t - s) ** 2 / (m - n)), 9)
    cut = rows.groupBy("recording_id").agg((-F.max(F.struct(gain.alias("g"), (-n).alias("c")))["c"]).alias("_c"))
    return beside(rows, cut, ["recording_id"]).withColumn("side", (n > F.col("_c")).cast("int")).drop("_n", "_s", "_n_all", "_s_all", "_c")


def side_xcorr(traces: DataFrame, sides: DataFrame, max_lag: int, auc_lag: int) -> DataFrame:
    """(recording_id, zero, peak, peak_lag, auc): cross-correlation of the two sides' mean traces."""
    mean = traces.join(sides.select(*UNIT, "side"), UNIT).groupBy("recording_id", "side", "frame").agg(F.avg("value").alias("value"))
    arrays = collect_traces(mean, ["recording_id", "side"]).groupBy("recording_id").agg(F.max(F.when(F.col("side") == 0, F.col("trace"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("trace"))).alias("b"))
    both = arrays.filter("a is not null and b is not null").select("recording_id", F.concat("a", "b").alias("trace"))

    def fn(x):
        n = len(x) // 2
        lags, r = k.xcorr(x[:n], x[n:], min(max_lag, n - 1))
        near = np.abs(lags) <= auc_lag
        at = int(np.argmax(r))
        return {"zero": float(r[lags == 0][0]), "peak": float(r[at]), "peak_lag": int(lags[at]), "auc": float(((r[near][1:] + r[near][:-1]) / 2).sum())}

    return per_trace(both, fn, "zero double, peak double, peak_lag int, auc double", ["recording_id"])


def beat_rate(arrays: DataFrame, fps: float, smooth: int, min_sec: float = 0.15, keys: list[str] = UNIT, digits: int | None = None) -> DataFrame:
    """(keys..., beats, rate): peaks of the smoothed angle, prominence (rounded to ``digits``, if given) half the MAD; rate from the mean interval."""
    def fn(x):
        kernel = np.ones(smooth)
        x = np.convolve(x, kernel, "same") / np.convolve(np.ones(len(x)), kernel, "same")
        spread = float(np.median(np.abs(x - np.median(x))))
        at, _ = k.find_peaks(x, prominence=0.5 * spread, distance=max(1, int(min_sec * fps)), digits=digits)
        return {"beats": len(at), "rate": fps * (len(at) - 1) / (at[-1] - at[0]) if len(at) > 1 else None}

    return per_trace(arrays, fn, "beats int, rate double", keys)


def activity(df: DataFrame, smooth: int, keys: list[str] = UNIT) -> DataFrame:
    """Adds activity: smoothed absolute value of a raw channel."""
    return moving_mean(df.withColumn("_a", F.abs("value")), smooth, keys, "_a", "activity").drop("_a")


def speed(df: DataFrame, smooth: int, fps: float, keys: list[str] = UNIT) -> DataFrame:
    """Adds speed: absolute time derivative of the smoothed angle."""
    g = gradient(moving_mean(df, smooth, keys, "value", "_s"), keys, "_s", out="_g")
    return g.withColumn("speed", F.abs(F.col("_g")) * fps).drop("_s", "_g")


def vigor(v: Column, b: tuple[float, float, float]) -> Column:
    """Quadratic calibration, not below 0."""
    return F.when(v.isNotNull(), F.greatest(b[0] + b[1] * v + b[2] * v * v, F.lit(0.0)))


def predicted_distance(speeds: DataFrame, b: tuple[float, float, float], fps: float, smooth: int, keys: list[str] = UNIT, col: str = "speed") -> DataFrame:
    """(keys..., distance): the calibrated vigor of the smoothed speed, integrated over time in seconds."""
    v = moving_mean(speeds, smooth, keys, col, "_v").withColumn("_y", vigor(F.col("_v"), b)).withColumn("_t", F.col("frame") / fps)
    return trapz(v, keys, "_t", "_y", "distance")


def tail_signal(a0: Column, a1: Column, speed: Column, gate: float = 0.1, half_wave: bool = False) -> Column:
    """Sum of two angles where the tail moves, rectified."""
    s = F.when(speed > gate, a0 + a1).otherwise(0.0)
    return F.greatest(s, F.lit(0.0)) if half_wave else F.abs(s)


def threshold_onsets(df: DataFrame, k_mad: float, least: int, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., start): onsets of runs over median + k MAD."""
    med = df.groupBy(*keys).agg(F.median("value").alias("_med"))
    thr = med.join(mad(df, keys), keys).select(*keys, (F.col("_med") + k_mad * F.col("mad")).alias("_thr"))
    on = df.join(thr, keys).withColumn("_on", F.col("value") > F.col("_thr"))
    return runs(on, "_on", keys).filter(F.col("length") >= least).select(*keys, "start")


def bout_onsets(recordings: DataFrame, fps: float, k_mad: float = 2.0, least_sec: float = 0.10, smooth: int = 5) -> DataFrame:
    """(recording_id, frame, source): onsets of movement from the best source that a recording has.

    Columns of ``recordings``, each NULL where a recording lacks it: ``n_frames``, ``onset_frames``
    (array; not used if its largest value is over 1.2 times n_frames), ``onset_seconds`` (array),
    ``train`` (array, above 0 while moving) and ``tail`` (array). The first present counts, in this
    order. Train and tail are stretched to n_frames by linear interpolation; the tail is filled, smoothed,
    and compared with median + k MAD, where runs under ``least_sec`` (two frames at least) do not count.
    """
    r = recordings.withColumn("onset_frames", F.when(F.array_max("onset_frames") <= 1.2 * F.col("n_frames"), F.col("onset_frames")))
    listed = F.when(F.col("onset_frames").isNotNull(), F.transform("onset_frames", lambda x: F.round(x))).otherwise(F.transform("onset_seconds", lambda x: F.round(x * fps)))
    source = F.when(F.col("onset_frames").isNotNull(), "frames").when(F.col("onset_seconds").isNotNull(), "seconds").when(F.col("train").isNotNull(), "train").when(F.col("tail").isNotNull(), "tail")
    r = r.withColumn("source", source)
    told = r.filter(F.col("source").isin("frames", "seconds")).select("recording_id", F.explode(F.transform(listed, lambda x: x.cast("int"))).alias("frame"), "source")

    def stretched(name: str) -> DataFrame:
        """(recording_id, frame, value): an array on n_frames frames."""
        own = r.filter(F.col("source") == name).select("recording_id", "n_frames", F.col(name).cast("array<double>").alias("trace"))
        last = F.size("trace") - 1

        def value(i: Column) -> Column:
            place = i * last / F.greatest(F.col("n_frames") - 1, F.lit(1))
            low = F.floor(place + 1e-9).cast("int")
            here, part = F.get("trace", low), place - low
            return F.when(part > 1e-9, here + part * (F.get("trace", low + 1) - here)).otherwise(here)

        stretch = F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1), value)
        return own.select("recording_id", F.posexplode(stretch).alias("frame", "value"))

    def starts(on: DataFrame, least: int) -> DataFrame:
        return drop_short_runs(on, "_on", least, ["recording_id"]).select("recording_id", F.col("start").alias("frame"))

    train = starts(stretched("train").withColumn("_on", F.col("value") > 0), 1).withColumn("source", F.lit("train"))
    tail = gaussian_smooth(fill_missing(stretched("tail"), ["recording_id"]), smooth, ["recording_id"])
    med = tail.groupBy("recording_id").agg(F.median("value").alias("_med")).join(mad(tail, ["recording_id"]), "recording_id")
    over = tail.join(med, "recording_id").withColumn("_on", F.col("value") > F.col("_med") + k_mad * F.col("mad"))
    tail = starts(over, max(2, round(least_sec * fps))).withColumn("source", F.lit("tail"))
    return told.unionByName(train).unionByName(tail)


def synced_clock(frames: DataFrame, sync: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw frame times on the synchronised clock, and the even clock of the crop window.

    ``frames`` (recording_id, t) in raw seconds; ``sync`` (recording_id, scale, delay, start, end),
    where a missing scale or delay is identity and a missing window end the span of the frames. Returns
    (recording_id, t) with t = raw * scale + delay, and (recording_id, k, t, rate): start, start +
    1 / rate, ... up to the end, the rate from the median step inside the window (start excluded).
    """
    on = frames.join(sync, "recording_id", "left")
    on = on.withColumn("t", F.col("t") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("delay", F.lit(0.0)))
    w = Window.partitionBy("recording_id").orderBy("t")
    first, last = F.min("t").over(Window.partitionBy("recording_id")), F.max("t").over(Window.partitionBy("recording_id"))
    on = on.withColumn("start", F.coalesce("start", first)).withColumn("end", F.coalesce("end", last))
    inside = (F.col("t") > F.col("start")) & (F.col("t") <= F.col("end"))
    on = on.withColumn("_step", F.col("t") - F.lag("t").over(w)).withColumn("_was", F.lag(inside).over(w)).withColumn("_in", inside)
    strict = F.median(F.when(F.col("_in") & F.col("_was"), F.col("_step")))
    rates = on.groupBy("recording_id", "start", "end").agg((1 / F.coalesce(strict, F.median("_step"))).alias("rate")).filter("rate > 0")
    k_ = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) * F.col("rate") + 1e-9).cast("int")), lambda i: F.col("start") + i / F.col("rate"))).alias("k", "t")
    return on.select("recording_id", "t"), rates.filter("end >= start").select("recording_id", k_, "rate")


def on_clock(series: DataFrame, clock: DataFrame, by: list[str], outside: str = "extend") -> DataFrame:
    """Channels (recording_id, by..., t, value) on the clock of their recording (recording_id, t)."""
    wanted = series.select("recording_id", *by).distinct().join(clock.select("recording_id", "t"), "recording_id")
    return interpolate_to(series, wanted, ["recording_id", *by], outside)


def channel_domfreq(series: DataFrame, bands: DataFrame, fps: float, window: int, nfft: int, smooth: int, keys: list[str]) -> DataFrame:
    """(keys..., channel, dom, power): dominant frequency of each channel in the band that ``bands`` (channel, mode, low, high) names.

    Channels of mode ``angle`` enter as speed, all others as smoothed absolute value.
    """
    rows = series.join(F.broadcast(bands.select("channel", "mode")), "channel")  # a row per kind of channel
    angle = speed(rows.filter("mode = 'angle'"), smooth, fps, [*keys, "channel"]).select(*keys, "channel", "frame", F.col("speed").alias("value"))
    raw = activity(rows.filter("mode <> 'angle'"), smooth, [*keys, "channel"]).select(*keys, "channel", "frame", F.col("activity").alias("value"))
    arrays = collect_traces(angle.unionByName(raw), [*keys, "channel"])
    spectra = welch_spectra(arrays, fps, window, window // 2, nfft, keys=[*keys, "channel"]).join(F.broadcast(bands), "channel")
    inside = spectra.filter(F.col("f").between(F.col("low"), F.col("high")))
    return dominant_freq(inside, 0.0, math.inf, [*keys, "channel"])


def period_acf(periods: DataFrame, max_lag: int, lags: int, failed: Failures | None = None) -> DataFrame:
    """(recording_id, unit_id, period, k, r): autocorrelation of each period on ``lags`` evenly spaced lags, by linear interpolation.

    ``periods`` (recording_id, unit_id, period, trace); shorter periods reach fewer lags, so the grid makes them comparable.
    """
    keys = [*UNIT, "period"]

    def fn(x):
        r = k.acf(x, max_lag)
        at = np.linspace(0, r.shape[1] - 1, lags)
        low = np.minimum(at.astype(int), max(r.shape[1] - 2, 0))
        return {"r": r[:, low] + (at - low) * (r[:, np.minimum(low + 1, r.shape[1] - 1)] - r[:, low])}

    return good_rows(per_trace(periods, fn, "r array<double>", keys, rows=True), "period acf", keys, failed).select(*keys, F.posexplode("r").alias("k", "r"))


def period_power(periods: DataFrame, fps: float, window: int, low: float, high: float) -> DataFrame:
    """(recording_id, unit_id, period, power): peak in-band power of each unit and period whose dominant frequency lies in the band."""
    keys = [*UNIT, "period"]
    spectra = welch_spectra(periods, fps, window, window // 2, window, keys=keys)
    dom = dominant_freq(spectra, 0.0, math.inf, keys).filter(F.col("dom").between(low, high)).select(*keys)
    peak = spectra.filter(F.col("f").between(low, high)).groupBy(*keys).agg(F.max("pxx").alias("power"))
    return peak.join(dom, keys, "left_semi")


def pooled_by_period(power: DataFrame) -> DataFrame:
    """(period, mean, sem, n): power pooled over the units of all recordings."""
    return mean_curve(power, ["period"], "power")


def pooled_limits(power: DataFrame, share: float = 0.01) -> DataFrame:
    """(low, high): percentiles of the power pooled over all periods, units and recordings, from both ends."""
    one = power.filter(F.col("power").isNotNull()).withColumn("_f", F.lit(1))
    told = running(value_counts(one, ["_f"], "power"), ["_f"], F.col("power"), ["power"], {"_upto": F.col("n")})
    # plotting position (i - 0.5) / n, linear between neighbours
    place = lambda p: F.least(F.greatest(p * F.col("_upto_all") + 0.5, F.lit(1.0)), F.col("_upto_all").cast("double"))
    at = lambda p, up: F.min(F.when(F.col("_upto") >= (F.ceil(place(p)) if up else F.floor(place(p))), F.col("power")))
    part = lambda p: F.max(place(p) - F.floor(place(p)))
    return told.agg(*[(at(p, False) + part(p) * (at(p, True) - at(p, False))).alias(n) for n, p in (("low", share), ("high", 1 - share))])


def rasterise(beats: DataFrame, recordings: DataFrame, fps: float) -> DataFrame:
    """(recording_id, frame, amp): beats (recording_id, t, amp) put on every frame of a clock, 0 elsewhere; several in a frame keep the largest."""
    grid = recordings.select("recording_id", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    own = beats.groupBy("recording_id", F.round(F.col("t") * fps).cast("int").alias("frame")).agg(F.max("amp").alias("amp"))
    return grid.join(own, ["recording_id", "frame"], "left").withColumn("amp", F.coalesce("amp", F.lit(0.0)))


def in_band_units(arrays: DataFrame, good: DataFrame, fps: float, window: int, low: float, high: float) -> DataFrame:
    """(recording_id, unit_id): good units whose dominant frequency lies in the band."""
    first = dominant_freq(welch_spectra(arrays, fps, window, window // 2, window), 0.0, fps / 2)
    return first.filter(F.col("dom").between(low, high)).join(good.select(*UNIT), UNIT, "left_semi").select(*UNIT)


def in_band_counts(arrays: DataFrame, kept: DataFrame) -> DataFrame:
    """(recording_id, units, in_band): units of each recording, and how many of them a first pass kept."""
    counts = kept.groupBy("recording_id").agg(F.count(F.lit(1)).alias("in_band"))
    return arrays.groupBy("recording_id").agg(F.count(F.lit(1)).alias("units")).join(counts, "recording_id", "left").withColumn("in_band", F.coalesce("in_band", F.lit(0)).cast("long"))


def two_pass_refine(arrays: DataFrame, good: DataFrame, fps: float, window: int, low: float, high: float) -> DataFrame:
    """(recording_id, unit_id, dom, power): a second pass over the good units whose first-pass frequency is in the band."""
    kept = in_band_units(arrays, good, fps, window, low, high)
    return dominant_freq(welch_spectra(arrays.join(kept, UNIT, "left_semi"), fps, 2 * window, window, 2 * window), low, high)


def surrogates(arrays: DataFrame, kind: str, seeds: int, keys: list[str] = UNIT) -> DataFrame:
    """(keys..., seed, trace, error): seeded surrogates, ``phase`` or ``ar1``; a row carries its seed, so reruns agree."""
    make = {"phase": k.phase_randomised, "ar1": k.ar1_surrogate}[kind]
    rows = arrays.select(*keys, "trace", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed"))
    rows = rows.withColumn("trace", F.concat(F.array(F.col("seed").cast("double")), "trace"))
    return per_trace(rows, lambda x: {"trace": make(x[1:], int(x[0]))}, "trace array<double>", [*keys, "seed"])


def rhythm_metrics(arrays: DataFrame, fps: float, low: float, high: float, window: int, step: int, welch_frames: int, lags: tuple[int, int], keys: list[str] = UNIT) -> DataFrame:
    """(keys..., metric, value) of each trace."""
    names = ["peak_power", "peak_freq", "q", "acf_prominence", "acf_peaks", "window_cv", "inst_cv"]
    wide = per_trace(arrays, lambda x: k.rhythm_metrics(x, fps, low, high, window, step, welch_frames, lags), ", ".join(f"{n} double" for n in names), keys)
    return wide.unpivot(keys, names, "metric", "value")


def detrended(arrays: DataFrame, keys: list[str] = UNIT) -> DataFrame:
    return per_trace(arrays, lambda x: {"trace": k.detrended(x)}, "trace array<double>", keys).drop("error")


def representative_signal(arrays: DataFrame, kind: str, fps: float, low: float, high: float, window: int) -> DataFrame:
    """(recording_id, trace): one detrended signal per recording.

    ``mean``: the mean of the units; ``pc1``: the first component's time course; ``median_unit``: the unit
    whose dominant frequency is nearest to the median of those of three components (the smallest unit on ties).
    """
    from .latent import pca

    rec = ["recording_id"]
    if kind == "mean":
        long = arrays.select("recording_id", F.posexplode("trace").alias("frame", "value"))
        picked = collect_traces(long.groupBy("recording_id", "frame").agg(F.avg("value").alias("value")), rec)
    elif kind == "pc1":
        picked = pca(arrays, 1).select("recording_id", F.col("score").alias("trace"))
    elif kind == "median_unit":
        of = lambda df, keys: dominant_freq(welch_spectra(df, fps, window, window // 2, window, keys=keys), low, high, keys)
        target = of(pca(arrays, 3).select("recording_id", "pc", F.col("score").alias("trace")), ["recording_id", "pc"]).groupBy("recording_id").agg(F.median("dom").alias("_target"))
        near = of(arrays, UNIT).join(target, "recording_id").groupBy("recording_id").agg(F.min(F.struct(F.round(F.abs(F.col("dom") - F.col("_target")), 12).alias("gap"), "unit_id")).alias("b"))
        picked = arrays.join(near.select("recording_id", F.col("b.unit_id").alias("unit_id")), UNIT, "left_semi").select("recording_id", "trace")
    else:
        raise ValueError(f"no representative signal {kind!r}")
    return detrended(picked, rec)
