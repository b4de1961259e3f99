"""Events, trials, phase resetting and behaviour by condition."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.batches import padded
from ..sources.staging import bounded_batches, staged
from .aggregates import corr, fisher_z_mean, hazen, resultant, trapz
from .clean import UNIT
from .joins import events_in_windows, interpolate_to, leave_one_out_mean, peri_event
from .pairs import dealt, permuted
from .signal import activity, per_trace, speed
from .stats import correlation, fdr_mask, fisher_table, ranksum, signrank
from .windows import runs


def stim_class_split(events: DataFrame, names: tuple[str, str, str] = ("light", "tap", "lighttap"), least: int = 5) -> DataFrame:
    """Onsets in order, split into three equal consecutive blocks; the remainder and recordings with fewer than ``least`` onsets go."""
    w = Window.partitionBy("recording_id")
    k = F.row_number().over(w.orderBy("frame"))
    n = F.count(F.lit(1)).over(w)
    block = F.floor((F.col("_k") - 1) / F.floor(F.col("_n") / 3)).cast("int")
    rows = events.withColumn("_k", k).withColumn("_n", n).filter(F.col("_n") >= least).withColumn("_b", block).filter("_b < 3")
    return rows.withColumn("stim", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_b") + 1)).drop("_k", "_n", "_b")


def stim_class(code: Column) -> Column:
    """Class of a code 1, 2, 3 or a name; ``lighttap`` is a class of its own."""
    name = F.lower(F.trim(code.cast("string")))
    both = name.contains("light") & name.contains("tap")
    return F.when((name == "3") | both, "lighttap").when((name == "1") | name.contains("light"), "light").when((name == "2") | name.contains("tap"), "tap")


def mad_scores(df: DataFrame, by: list[str] = UNIT, col: str = "value") -> DataFrame:
    """Adds z = (x - median) / MAD, with the sd, or 1, where the MAD is 0."""
    med = df.groupBy(*by).agg(F.median(col).alias("_med"), F.stddev_samp(col).alias("_sd"))
    dev = df.join(med, by)
    mad = dev.groupBy(*by).agg(F.median(F.abs(F.col(col) - F.col("_med"))).alias("_mad"))
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return dev.join(mad, by).withColumn("z", (F.col(col) - F.col("_med")) / scale).drop("_med", "_sd", "_mad")


def strong_peaks(peaks: DataFrame, by: list[str] = UNIT, col: str = "z", share: float = 0.9, least: float = 10.0) -> DataFrame:
    """Peaks of at least ``least`` and at least the group's percentile of peak heights."""
    q = hazen(peaks, by, [share], col).drop("p")
    return peaks.join(q, by).filter(F.col(col) >= F.greatest("q", F.lit(least))).drop("q")


def mad_events(arrays: DataFrame, fps: float, height: float = 4.0, prominence: float = 2.5, gap_sec: float = 3.5, share: float = 0.9, least: float = 10.0, digits: int | None = None) -> DataFrame:
    """(recording_id, unit_id, frame, value, prominence): strong peaks of the MAD scores of each trace.

    Peaks by height, prominence and distance; of these the ones at or above the unit's percentile of
    peak heights and ``least``; with ``digits`` heights are compared with those as rounded to them.
    Missing values count as 0.
    """
    distance = max(1, round(gap_sec * fps))
    rows = arrays.select(*UNIT, F.transform("trace", lambda x: F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))).alias("trace"))

    def fn(x):
        z = k.mad_scores(x)
        at, prom = k.find_peaks(z, height, prominence, distance)
        tall = z[at] if digits is None else k.rounded(z[at], digits)
        high = tall >= max(k.hazen(tall, share), least) if len(at) else np.zeros(0, bool)
        return {"at": at[high].tolist(), "heights": z[at][high], "proms": np.asarray(prom)[high]}

    found = per_trace(rows, fn, "at array<int>, heights array<double>, proms array<double>").filter("error is null")
    return found.select(*UNIT, F.explode(F.arrays_zip("at", "heights", "proms")).alias("p")).select(*UNIT, F.col("p.at").alias("frame"), F.col("p.heights").alias("value"), F.col("p.proms").alias("prominence"))


def active_share(per_unit: DataFrame, by: list[str] = ["recording_id"]) -> DataFrame:
    """(by..., units, total, active, rate, rate_median, amplitude): units with events, and means over the units of ``unit_events_in_window``."""
    amplitude = F.sum(F.col("amplitude") * F.col("n")) / F.sum("n")
    return per_unit.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("total"), F.avg((F.col("n") > 0).cast("double")).alias("active"), F.avg("rate").alias("rate"), F.median("rate").alias("rate_median"), amplitude.alias("amplitude"))


def unit_events_in_window(units: DataFrame, events: DataFrame, first: int, last: int, seconds: float) -> DataFrame:
    """(recording_id, unit_id, n, rate, amplitude): events per unit in a window; units without events count 0."""
    own = events.filter(F.col("frame").between(first, last)).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("amplitude"))
    n = F.coalesce("n", F.lit(0))
    return units.select(*UNIT).join(own, UNIT, "left").select(*UNIT, n.alias("n"), (n / seconds).alias("rate"), "amplitude")


def run_features(df: DataFrame, on: str, fps: float, by: list[str] = UNIT, col: str = "value") -> DataFrame:
    """(by..., run, start, end, duration, peak, area): duration in seconds, trapezoid area per second over each run."""
    r = runs(df, on, by)
    w = Window.partitionBy(*by).orderBy("frame")
    flag = F.coalesce(F.col(on), F.lit(False))
    started = (flag & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    inside = df.withColumn("_s", started).withColumn("run", F.sum("_s").over(w)).filter(flag)
    area = trapz(inside, [*by, "run"], "frame", col)
    peak = inside.groupBy(*by, "run").agg(F.max(col).alias("peak"))
    out = r.join(area, [*by, "run"]).join(peak, [*by, "run"])
    return out.select(*by, "run", "start", "end", (F.col("length") / fps).alias("duration"), "peak", (F.col("area") / fps).alias("area"))


def itpc(peri: DataFrame) -> DataFrame:
    """(recording_id, unit_id, lag, itpc, n): inter-trial coherence of phases (recording_id, unit_id, event, lag, phase)."""
    return peri.groupBy(*UNIT, "lag").agg(resultant(F.col("phase")).alias("itpc"), F.count("phase").alias("n"))


def reset_strength(curve: DataFrame, pre: tuple[int, int], post: tuple[int, int], peak: tuple[int, int]) -> DataFrame:
    """(recording_id, unit_id, pre, post, reset): mean coherence before and after, and the largest after minus before."""
    at = lambda w: F.when(F.col("lag").between(*w), F.col("itpc"))
    return curve.groupBy(*UNIT).agg(F.avg(at(pre)).alias("pre"), F.avg(at(post)).alias("post"), (F.max(at(peak)) - F.avg(at(pre))).alias("reset"))


def peri_average(peri: DataFrame, col: str = "value") -> DataFrame:
    """(recording_id, unit_id, lag, mean): average around the events."""
    return peri.groupBy(*UNIT, "lag").agg(F.avg(col).alias("mean"))


def phase_signals(arrays: DataFrame, fps: float, low: float, high: float, order: int = 3) -> DataFrame:
    """(recording_id, unit_id, trace, phase, error): each trace band-passed, and the phase of its analytic signal."""
    sections = k.butter_bandpass(order, low, high, fps)

    def fn(x):
        y = k.filtfilt(sections, x)
        return {"trace": y, "phase": np.angle(k.analytic(y))}

    return per_trace(arrays, fn, "trace array<double>, phase array<double>", rows=True)


def event_curves(signals: DataFrame, events: DataFrame, fps: float, before: int, after: int, pre: tuple[int, int], post: tuple[int, int], peak: tuple[int, int], smooth: int | None = None) -> DataFrame:
    """What a unit's phase does around the events of its recording.

    (recording_id, unit_id, n, itpc, freq, mean, pre_itpc, post_itpc, delta_itpc, reset, pre_freq,
    post_freq, delta_freq). ``signals`` (recording_id, unit_id, trace, phase). Curves over lags -before
    to after: coherence of the phases, mean instantaneous frequency (first difference of the unwrapped
    phase, smoothed by a Gaussian of ``smooth`` frames, a second by default), and mean of the trace.
    Events count whose surrounding is whole; without any the curves are NULL. A unit's events are sliced
    from its row, so no table of samples is made.
    """
    smooth = max(3, round(fps)) if smooth is None else smooth
    onsets = events.groupBy("recording_id").agg(F.sort_array(F.collect_set("frame")).alias("at"))
    rows = signals.join(onsets, "recording_id").select(*UNIT, "trace", "phase", "at")
    lags = np.arange(-before, after + 1)
    inside = {n: (lags >= w[0]) & (lags <= w[1]) for n, w in (("pre", pre), ("post", post), ("peak", peak))}
    reach = np.arange(-(smooth // 2), smooth - smooth // 2)
    weights = np.exp(-0.5 * (reach / (smooth / 5)) ** 2)
    curves, numbers = ("itpc", "freq", "mean"), ("pre_itpc", "post_itpc", "delta_itpc", "reset", "pre_freq", "post_freq", "delta_freq")

    def frequency(phase: np.ndarray) -> np.ndarray:
        step = np.diff(phase)
        raw = np.concatenate(([np.nan], step - 2 * np.pi * np.round(step / (2 * np.pi)))) * fps / (2 * np.pi)
        known = np.isfinite(raw)
        held = np.pad(np.where(known, raw, 0.0), smooth), np.pad(known.astype(float), smooth)
        total, norm = (sum(w * x[smooth + i : smooth + i + len(raw)] for i, w in zip(reach, weights)) for x in held)
        return np.where(norm > 0, total / np.maximum(norm, 1e-300), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n", *curves, *numbers)}
            for i in range(batch.num_rows):
                trace, phase, at = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) if batch.column(c)[i].is_valid else np.zeros(0) for c in (2, 3, 4))
                at = at[(at >= before) & (at + after < len(phase))].astype(int) if len(trace) == len(phase) else at[:0].astype(int)
                got: dict = dict.fromkeys(out)
                got["n"] = len(at)
                if len(at):
                    near = at[:, None] + lags
                    freq = frequency(phase)[near]
                    itpc = np.abs(np.exp(1j * phase[near]).mean(axis=0))
                    mean = lambda x, w: float(np.nanmean(x[..., inside[w]])) if inside[w].any() else None  # noqa: E731, B023
                    got |= {"itpc": itpc, "freq": np.nanmean(freq, axis=0), "mean": trace[near].mean(axis=0), "pre_itpc": mean(itpc, "pre"), "post_itpc": mean(itpc, "post"), "pre_freq": mean(freq, "pre"), "post_freq": mean(freq, "post")}
                    got |= {f"delta_{c}": None if None in (got[f"pre_{c}"], got[f"post_{c}"]) else got[f"post_{c}"] - got[f"pre_{c}"] for c in ("itpc", "freq")}
                    got["reset"] = float(itpc[inside["peak"]].max()) - got["pre_itpc"] if inside["peak"].any() and got["pre_itpc"] is not None else None
                for c in out:
                    out[c].append(got[c])
            cells = [pa.array(out["n"], pa.int32()), *[pa.array(out[c], pa.list_(pa.float64())) for c in curves], *[pa.array(out[c], pa.float64()) for c in numbers]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cells], names=[*UNIT, *out])

    bounded_batches(signals.sparkSession)
    kinds = dict(signals.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in UNIT], "n int", *[f"{c} array<double>" for c in curves], *[f"{c} double" for c in numbers]])
    return rows.mapInArrow(run, schema)


def long_event_curves(curves: DataFrame, before: int) -> DataFrame:
    """(recording_id, unit_id, lag, itpc, freq, mean): the curves of ``event_curves``, a row per lag."""
    rows = curves.select(*UNIT, F.posexplode(F.arrays_zip("itpc", "freq", "mean")).alias("i", "c"))
    return rows.select(*UNIT, (F.col("i") - before).alias("lag"), "c.itpc", "c.freq", "c.mean")


def subject_rollup(units: DataFrame, subject: Column, col: str) -> DataFrame:
    """(subject_id, median, n) of pooled units."""
    return units.groupBy(subject.alias("subject_id")).agg(F.median(col).alias("median"), F.count(col).alias("n"))


def usable_trials(trials: DataFrame, frames: int, least: int = 3) -> DataFrame:
    """Rows of complete trials with spread, of units with at least ``least`` of them."""
    key = ["subject_id", "unit_id"]
    good = trials.groupBy(*key, "trial").agg(F.count("value").alias("_n"), F.stddev_samp("value").alias("_sd")).filter((F.col("_n") == frames) & (F.col("_sd") > 1e-12))
    enough = good.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter(F.col("_k") >= least).select(*key, "trial")
    return trials.join(enough, [*key, "trial"], "left_semi")


def trial_pair_corr(trials: DataFrame) -> DataFrame:
    """(subject_id, unit_id, a, b, r) for trial pairs a < b of a unit; the number of trials bounds the pairs."""
    key = ["subject_id", "unit_id", "rel_frame"]
    other = trials.select(*key, F.col("trial").alias("b"), F.col("value").alias("_v"))
    both = trials.withColumnRenamed("trial", "a").join(other, key).filter("a < b")
    return both.groupBy("subject_id", "unit_id", "a", "b").agg(corr("value", "_v").alias("r"))


def trial_reliability(trials: DataFrame) -> DataFrame:
    """(subject_id, unit_id, fisher, median, others): mean trial correlation by Fisher z, its median, and the mean correlation with the other trials' mean."""
    key = ["subject_id", "unit_id"]
    pairs = trial_pair_corr(trials).groupBy(*key).agg(fisher_z_mean(F.col("r")).alias("fisher"), F.median("r").alias("median"))
    loo = leave_one_out_mean(trials, [*key, "rel_frame"]).groupBy(*key, "trial").agg(corr("value", "others").alias("r")).groupBy(*key).agg(F.avg("r").alias("others"))
    return pairs.join(loo, key)


def significant_reliability(pairs: DataFrame, method: str = "fdr", alpha: float = 0.05) -> DataFrame:
    """(subject_id, unit_id, fisher, kept): mean over the pairs (with a p column) that stay significant after correction."""
    kept = fdr_mask(pairs, ["subject_id", "unit_id"], "p", alpha, method).filter("significant")
    return kept.groupBy("subject_id", "unit_id").agg(fisher_z_mean(F.col("r")).alias("fisher"), F.count(F.lit(1)).alias("kept"))


def split_reliability(first: DataFrame, second: DataFrame, seeds: int = 1) -> DataFrame:
    """(subject_id, unit_id, r, null_r): correlation of two blocks' mean traces per unit, and with another unit's second block in its place.

    A unit's mean trace (one value per frame) is one row, so what is drawn is rows of units, not of frames.
    """
    key = ["subject_id", "unit_id"]
    b = second.select(*key, "rel_frame", F.col("value").alias("_b"))
    own = first.join(b.hint("merge"), [*key, "rel_frame"]).groupBy(*key).agg(corr("value", "_b").alias("r"))
    frames = first.select("subject_id", "rel_frame").unionByName(second.select("subject_id", "rel_frame")).groupBy("subject_id").agg(F.sort_array(F.collect_set("rel_frame")).alias("_frames"))

    def wide(df: DataFrame, unit: str, name: str) -> DataFrame:
        """Values per unit in the order of the subject's frames, and which of them have a row."""
        one = df.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rel_frame", F.struct(F.col("value").cast("double").alias("v"))))).alias("_m"))
        cells = F.transform("_frames", lambda f: F.try_element_at("_m", f))
        rows = one.join(frames.hint("merge"), "subject_id").select("subject_id", F.col("unit_id").alias(unit), F.transform(cells, lambda c: c["v"]).alias(name), F.transform(cells, lambda c: c.isNotNull()).alias(f"{name}_row"))
        return rows.hint("merge")

    moved = permuted(first.select(*key).distinct(), seeds, ["subject_id"])
    rows = moved.join(wide(second, "other", "_y"), ["subject_id", "other"]).join(wide(first, "unit_id", "_x"), key)
    rows = rows.select(*key, "_x", "_y", F.exists(F.zip_with("_x_row", "_y_row", lambda p, q: p & q), lambda x: x).alias("_some")).filter("_some").drop("_some")
    bounded_batches(first.sparkSession)
    kinds = dict(first.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (padded(batch.column(i)) for i in (2, 3))
            known = np.isfinite(x) & np.isfinite(y)
            n = known.sum(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                spread = [np.where(known, v, -np.inf).max(axis=1, initial=-np.inf) > np.where(known, v, np.inf).min(axis=1, initial=np.inf) for v in (x, y)]
                x, y = (np.where(known, v - np.where(known, v, 0.0).sum(axis=1, keepdims=True) / n[:, None], 0.0) for v in (x, y))
                r = np.where(spread[0] & spread[1], (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(r, mask=n == 0)], names=[*key, "_r"])

    null = rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in key], "_r double"]))
    return own.join(null.groupBy(*key).agg(F.avg("_r").alias("null_r")).hint("merge"), key, "left")


def responsive_units(trials: DataFrame, stim_from: int, sds: float = 2.0) -> DataFrame:
    """(subject_id, unit_id, base, stim, response): response 1 or -1 where the stimulus mean leaves the baseline by ``sds`` deviations."""
    base, stim = F.when(F.col("rel_frame") < stim_from, F.col("value")), F.when(F.col("rel_frame") >= stim_from, F.col("value"))
    g = trials.groupBy("subject_id", "unit_id").agg(F.avg(base).alias("base"), F.stddev_samp(base).alias("_sd"), F.avg(stim).alias("stim"))
    r = F.when(F.col("stim") > F.col("base") + sds * F.col("_sd"), 1).when(F.col("stim") < F.col("base") - sds * F.col("_sd"), -1).otherwise(0)
    return g.withColumn("response", r).drop("_sd")


def responsive_by_signrank(trials: DataFrame, stim_from: int, alpha: float = 0.05, p: bool = True) -> DataFrame:
    """(subject_id, unit_id, n, w, ties, median[, p, response]): signed-rank test over a unit's trials of the stimulus mean against the baseline mean; response 1 or -1 where it is significant."""
    base, stim = F.when(F.col("rel_frame") < stim_from, F.col("value")), F.when(F.col("rel_frame") >= stim_from, F.col("value"))
    means = trials.groupBy("subject_id", "unit_id", "trial").agg(F.avg(base).alias("_b"), F.avg(stim).alias("_s"))
    t = signrank(means, ["subject_id", "unit_id"], "_s", "_b", p, small=True)
    return t.withColumn("response", F.when(F.col("p") < alpha, F.signum("median").cast("int")).otherwise(0)) if p else t


def movement(signals: DataFrame, fps: float, smooth_sec: float = 0.10, angle: bool = False) -> DataFrame:
    """Signals (subject_id, cond, frame, value) as what is thresholded: the smoothed absolute value, or for angles the absolute time derivative of the smoothed angle."""
    key, frames = ["subject_id", "cond"], max(1, round(smooth_sec * fps))
    moved = speed(signals, frames, fps, key).withColumn("value", F.col("speed")) if angle else activity(signals, frames, key).withColumn("value", F.col("activity"))
    return moved.select(*key, "frame", "value")


def quantify_by_condition(signals: DataFrame, k: float, least_frames: int, fps: float, floor: float = 1e-10, pooled: bool = True) -> DataFrame:
    """(subject_id, cond, mean, p95, active, bouts_per_min, integral): activity above the threshold median + k MAD (``floor`` at least).

    The threshold is the subject's, pooled over its conditions, or one of each condition.
    Frames are runs of the condition's clock; runs shorter than ``least_frames`` are no bouts.
    """
    group = ["subject_id"] if pooled else ["subject_id", "cond"]
    med = signals.groupBy(*group).agg(F.median("value").alias("_med"))
    dev = signals.join(med, group)
    mad = F.greatest(F.median(F.abs(F.col("value") - F.col("_med"))), F.lit(floor))
    thr = dev.groupBy(*group).agg((F.first("_med") + k * mad).alias("_thr"))
    on = signals.join(thr, group).withColumn("_on", F.col("value") > F.col("_thr"))
    key = ["subject_id", "cond"]
    bouts = runs(on, "_on", key).filter(F.col("length") >= least_frames).groupBy(*key).agg(F.count(F.lit(1)).alias("bouts"), F.sum("length").alias("frames"))
    stats = on.groupBy(*key).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    p95 = hazen(signals, key, [0.95]).select(*key, F.col("q").alias("p95"))
    area = trapz(signals, key, "frame", "value", "integral")
    out = stats.join(p95, key).join(area, key).join(bouts, key, "left")
    return out.select(*key, "mean", "p95", (F.coalesce("frames", F.lit(0)) / F.col("n")).alias("active"), (F.coalesce("bouts", F.lit(0)) * 60.0 * fps / F.col("n")).alias("bouts_per_min"), (F.col("integral") / fps).alias("integral"))


def beats_to_bouts(events: DataFrame, gap: int, by: list[str] = ["recording_id"]) -> DataFrame:
    """(by..., bout, start, end, beats): beats no more than ``gap`` frames apart belong to one bout."""
    w = Window.partitionBy(*by).orderBy("frame")
    fresh = F.coalesce((F.col("frame") - F.lag("frame").over(w) > gap).cast("int"), F.lit(1))
    return events.withColumn("_new", fresh).withColumn("bout", F.sum("_new").over(w)).groupBy(*by, "bout").agg(F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("beats"))


def response_latency(stims: DataFrame, beats: DataFrame, most: int) -> DataFrame:
    """(recording_id, frame, latency, responded): frames from each stimulus to the next beat, NULL beyond ``most``.

    Stimuli and beats are merged on one clock, so the next beat comes from a window.
    """
    both = stims.select("recording_id", "frame", F.lit(None).cast("int").alias("_b"), F.lit(1).alias("_s")).unionByName(beats.select("recording_id", "frame", F.col("frame").alias("_b"), F.lit(0).alias("_s")))
    after = F.first("_b", True).over(Window.partitionBy("recording_id").orderBy("frame", F.desc("_s")).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_d", after - F.col("frame")).filter("_s = 1")
    return near.select("recording_id", "frame", F.when(F.col("_d") <= most, F.col("_d")).alias("latency"), F.coalesce(F.col("_d") <= most, F.lit(False)).alias("responded"))


def responder_shares(latencies: DataFrame, stims: DataFrame) -> DataFrame:
    """(recording_id, stim, trials, responded, share, latency): per condition of the stimuli (recording_id, frame, stim) the share of responses in time and their mean latency."""
    both = latencies.join(stims.select("recording_id", "frame", "stim"), ["recording_id", "frame"])
    hits = F.count(F.when(F.col("responded"), 1))
    return both.groupBy("recording_id", "stim").agg(F.count(F.lit(1)).alias("trials"), hits.alias("responded"), (hits / F.count(F.lit(1))).alias("share"), F.avg("latency").alias("latency"))


def oscillator_core(traces: DataFrame, dom: DataFrame, low: float, high: float) -> DataFrame:
    """(recording_id, frame, core): mean trace of the units in the core band, else of all units."""
    inside = traces.join(dom, UNIT, "left")
    band = F.avg(F.when(F.col("dom").between(low, high), F.col("value")))
    return inside.groupBy("recording_id", "frame").agg(F.coalesce(band, F.avg("value")).alias("core"))


def trial_extract(arrays: DataFrame, onsets: DataFrame, before: int, after: int) -> DataFrame:
    """(recording_id, unit_id, trial, rel_frame, value): a unit's samples around each onset whose surrounding is whole; trials count the onsets of a recording in order."""
    w = Window.partitionBy("recording_id").orderBy("frame")
    numbered = onsets.select("recording_id", "frame").distinct().withColumn("trial", F.row_number().over(w) - 1)
    cut = peri_event(arrays, numbered, before, after)
    return cut.join(numbered.withColumnRenamed("frame", "event"), ["recording_id", "event"]).select(*UNIT, "trial", F.col("lag").alias("rel_frame"), "value")


def pool_on_common_time(curves: DataFrame) -> DataFrame:
    """(recording_id, unit_id, t, value): the curves of all recordings on the time axis of the first one, NULL where they do not reach."""
    # the axis is one array, which each curve unfolds
    axis = curves.groupBy("recording_id").agg(F.sort_array(F.collect_set("t")).alias("_axis")).agg(F.min_by("_axis", "recording_id").alias("_axis"))
    clock = curves.select(*UNIT).distinct().join(F.broadcast(axis), F.lit(True)).select(*UNIT, F.explode("_axis").alias("t"))
    return interpolate_to(curves, clock, UNIT, "null")


def subject_tests(units: DataFrame, subject: Column, before: str, after: str, p: bool = True) -> DataFrame:
    """(subject_id, before, after, n, w, ties, median[, p], n0, w0[, p0]): per subject the pooled units' medians, the paired test of after against before, and the test of after alone against 0."""
    rows = units.withColumn("subject_id", subject)
    medians = rows.groupBy("subject_id").agg(F.median(before).alias("before"), F.median(after).alias("after"))
    paired = signrank(rows, ["subject_id"], after, before, p)
    zero = signrank(rows, ["subject_id"], after, None, p)
    zero = zero.select("subject_id", F.col("n").alias("n0"), F.col("w").alias("w0"), *([F.col("p").alias("p0")] if p else []))
    return medians.join(paired, "subject_id", "left").join(zero, "subject_id", "left")


def baseline_noise(arrays: DataFrame) -> DataFrame:
    """(recording_id, unit_id, mu, sigma, error): centre and width of each trace's noise."""
    def fn(x):
        mu, sigma = k.baseline_noise(x)
        return {"mu": mu, "sigma": sigma}

    return per_trace(arrays, fn, "mu double, sigma double")


def scaled_by_noise(arrays: DataFrame, noise: DataFrame) -> DataFrame:
    """(recording_id, unit_id, trace): traces around their noise's centre, in its widths. Staged, as maps and transients read it many times."""
    scaled = arrays.join(noise.filter("sigma > 0").select(*UNIT, "mu", "sigma"), UNIT).select(*UNIT, F.transform("trace", lambda x: (x - F.col("mu")) / F.col("sigma")).alias("trace"))
    return staged(arrays.sparkSession, scaled, "scaled-traces")


def _transitions(scaled: DataFrame) -> DataFrame:
    """(recording_id, x, y): each sample with the next one."""
    n = F.size("trace")
    both = F.arrays_zip(F.slice("trace", 1, n - 1).alias("x"), F.slice("trace", 2, n - 1).alias("y"))
    return scaled.filter(n > 1).select("recording_id", F.explode(both).alias("p")).select("recording_id", "p.x", "p.y").filter("x is not null and y is not null")


def grid_range(scaled: DataFrame) -> DataFrame:
    """(recording_id, low, high): whole numbers around all samples of a recording."""
    ends = scaled.select("recording_id", F.array_min("trace").alias("a"), F.array_max("trace").alias("b")).groupBy("recording_id").agg(F.floor(F.min("a")).cast("double").alias("low"), F.ceil(F.max("b")).cast("double").alias("high"))
    return ends.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1))


def transition_counts(scaled: DataFrame, bins: int = 1000) -> DataFrame:
    """(recording_id, gi, gj, n): how often a sample pair (x_t, x_t+1) falls at each point of an even grid over the recording's range; gi is the place of x_t."""
    cell = lambda c: F.floor((F.col(c) - F.col("low")) / (F.col("high") - F.col("low")) * (bins - 1) + 0.5).cast("int")
    placed = _transitions(scaled).join(grid_range(scaled), "recording_id")
    return placed.groupBy("recording_id", cell("x").alias("gi"), cell("y").alias("gj")).agg(F.count(F.lit(1)).alias("n"))


def noise_covariance(scaled: DataFrame) -> DataFrame:
    """(recording_id, covariance): of the pairs below zero, which hold no events; 0 for fewer than two."""
    cov = F.covar_samp(F.when((F.col("x") < 0) & (F.col("y") < 0), F.col("x")), F.when((F.col("x") < 0) & (F.col("y") < 0), F.col("y")))
    return _transitions(scaled).groupBy("recording_id").agg(F.coalesce(cov, F.lit(0.0)).alias("covariance"))


def odds_maps(scaled: DataFrame, fps: float, bins: int = 1000, confidence: float = 0.99, decay: float = 2.0) -> DataFrame:
    """(recording_id, low, high, odds, joint): per recording the cells [next, current] that noise does not explain, and those of them that may belong to events, packed bits.

    The grid of a recording has a fixed size, so its maps are one small row whatever its units and frames.
    """
    counts = transition_counts(scaled, bins).groupBy("recording_id").agg(F.collect_list(F.struct("gi", "gj", "n")).alias("cells"))
    rows = counts.join(grid_range(scaled), "recording_id").join(noise_covariance(scaled), "recording_id")
    rows = rows.select("recording_id", "low", "high", "covariance", F.col("cells.gi").alias("gi"), F.col("cells.gj").alias("gj"), F.col("cells.n").alias("n")).repartition("recording_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                low, high, covariance = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                gi, gj, n = (batch.column(c)[i].values.to_numpy() for c in (4, 5, 6))
                grid = np.zeros((bins, bins))
                grid[gj, gi] = n
                odds = k.transition_odds(grid, low, high, covariance, confidence)
                joint = k.joint_map(odds, low, high, fps, decay)
                packed = [pa.array([np.packbits(m).tobytes()], pa.binary()) for m in (odds, joint)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([low]), pa.array([high]), *packed], names=["recording_id", "low", "high", "odds", "joint"])

    kind = dict(scaled.dtypes)["recording_id"]
    return staged(scaled.sparkSession, rows.mapInArrow(run, f"recording_id {kind}, low double, high double, odds binary, joint binary"), "odds-maps")


def _bit(bits: Column, place: Column) -> Column:
    """Bit of a packed map: place counts from 0, the highest bit of a byte first."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), 7 - place % 8)) % 2 == 1


def significant_cells(counts: DataFrame, maps: DataFrame, bins: int = 1000) -> DataFrame:
    """(recording_id, gi, gj, n): occupied cells of the grid that noise does not explain."""
    told = counts.join(maps.select("recording_id", "odds"), "recording_id")
    return told.filter(_bit(F.col("odds"), F.col("gj").cast("long") * bins + F.col("gi"))).select("recording_id", "gi", "gj", "n")


def significant_transients(scaled: DataFrame, maps: DataFrame, bins: int = 1000) -> DataFrame:
    """(recording_id, unit_id, trace): 1.0 where a frame belongs to an event, else 0.0.

    A frame does if two transitions in a row, around or beside it, lie in the recording's joint map. Blocks
    of units meet the map, so it travels once per block.
    """
    blocks = dealt(scaled, 256).groupBy("recording_id", "blk").agg(F.collect_list(F.struct("unit_id", "trace")).alias("u"))
    rows = blocks.join(maps.select("recording_id", "low", "high", "joint"), "recording_id").select("recording_id", F.col("u.unit_id").alias("ids"), F.col("u.trace").alias("traces"), "low", "high", "joint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, traces = batch.column(1)[i].values, batch.column(2)[i].values
                low, high, bits = (batch.column(c)[i].as_py() for c in (3, 4, 5))
                joint = np.unpackbits(np.frombuffer(bits, np.uint8), count=bins * bins).astype(bool).reshape(bins, bins)
                raster = k.event_raster(np.nan_to_num(padded(traces), nan=0.0), joint, low, high)
                rec = pa.array([batch.column(0)[i].as_py()] * len(ids), batch.schema.field(0).type)
                lengths = [len(t) if t.is_valid else 0 for t in traces]
                cells = pa.array([r[:n].astype(float) for r, n in zip(raster, lengths)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([rec, ids, cells], names=["recording_id", "unit_id", "trace"])

    kinds = dict(scaled.dtypes)
    return rows.mapInArrow(run, f"recording_id {kinds['recording_id']}, unit_id {kinds['unit_id']}, trace array<double>")


def window_events(samples: DataFrame, picked: DataFrame, fps: float, bucket: int) -> DataFrame:
    """(recording_id, label, unit_id, run, start, end, duration, peak, area): event runs of samples (recording_id, unit_id, frame, value, on) inside each picked window (recording_id, label, start, end); runs are cut at its ends."""
    inside = events_in_windows(samples, picked.select("recording_id", "label", "start", "end"), bucket).select("recording_id", "label", "unit_id", "frame", "value", "on")
    return run_features(inside, "on", fps, ["recording_id", "label", "unit_id"])


def unit_event_features(found: DataFrame, units: DataFrame, picked: DataFrame, fps: float) -> DataFrame:
    """(recording_id, label, unit_id, n, rate, amp, dur, auc): per unit and window, units without events included."""
    key = ["recording_id", "label", "unit_id"]
    every = units.select(*UNIT).join(picked.select("recording_id", "label", ((F.col("end") - F.col("start") + 1) / fps).alias("_sec")), "recording_id")
    own = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.avg("peak").alias("amp"), F.avg("duration").alias("dur"), F.avg("area").alias("auc"))
    n = F.coalesce("_n", F.lit(0))
    return every.join(own, key, "left").select(*key, n.alias("n"), (n / F.col("_sec")).alias("rate"), "amp", "dur", "auc")


def event_summary(features: DataFrame, found: DataFrame) -> DataFrame:
    """(recording_id, label, rate, rate_median, total, active, amp, dur, auc): rates over units, the rest over events."""
    key = ["recording_id", "label"]
    rates = features.groupBy(*key).agg(F.avg("rate").alias("rate"), F.median("rate").alias("rate_median"), F.sum("n").alias("total"), F.avg((F.col("n") > 0).cast("double")).alias("active"))
    events = found.groupBy(*key).agg(F.avg("peak").alias("amp"), F.avg("duration").alias("dur"), F.avg("area").alias("auc"))
    return rates.join(events, key, "left")


def paired_unit_tests(features: DataFrame, metrics: list[str], p: bool = True) -> DataFrame:
    """(recording_id, metric, n, w, ties, median[, p]): per recording the paired test of each unit's metric in the high window against the low one."""
    at = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    wide = features.groupBy(*UNIT).agg(*[at(label, c).alias(f"{c}_{label}") for c in metrics for label in ("low", "high")])
    parts = [wide.select("recording_id", F.lit(c).alias("metric"), F.col(f"{c}_high").alias("_h"), F.col(f"{c}_low").alias("_l")) for c in metrics]
    return signrank(reduce(DataFrame.unionByName, parts), ["recording_id", "metric"], "_h", "_l", p)


def pooled_event_tests(features: DataFrame, found: DataFrame, p: bool = True) -> DataFrame:
    """(metric, n1, n2, w, z[, p]): rank-sum tests of low against high, pooled over recordings: rates over units, amplitude, duration and area over events."""
    rates = features.select(F.lit("rate").alias("metric"), "label", F.col("rate").alias("value"))
    parts = [found.select(F.lit(m).alias("metric"), "label", F.col(c).alias("value")) for m, c in (("amp", "peak"), ("dur", "duration"), ("auc", "area"))]
    return ranksum(reduce(DataFrame.unionByName, [rates, *parts]), ["metric"], "label", "low", "value", p)


def pooled_active_test(features: DataFrame) -> DataFrame:
    """(a, b, c, d, p): active and silent units of the low window over those of the high one."""
    return fisher_table(features.withColumn("_f", F.lit(1)), ["_f"], F.col("label") == "low", F.col("n") > 0).drop("_f")


def change_correlation(features: DataFrame, activity: DataFrame, metric: str, p: bool = True) -> DataFrame:
    """(r, n[, p]): Spearman correlation over recordings of the change in activity (recording_id, label, activity) with the median change of the units' metric, high less low."""
    at = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    unit = features.groupBy(*UNIT).agg((at("high", metric) - at("low", metric)).alias("_d")).groupBy("recording_id").agg(F.median("_d").alias("_y"))
    rec = activity.groupBy("recording_id").agg((at("high", "activity") - at("low", "activity")).alias("_x"))
    both = rec.join(unit, "recording_id").withColumn("_f", F.lit(1))
    return correlation(both, ["_f"], "_x", "_y", True, p).drop("_f")


def trial_windows(peri: DataFrame, d: int) -> DataFrame:
    """(recording_id, unit_id, base, stim, tone): means over lags -d to -1, 0 to d - 1 and d to 2d - 1 around the stimuli."""
    mean = lambda a, b: F.avg(F.when(F.col("lag").between(a, b - 1), F.col("value")))
    return peri.groupBy(*UNIT).agg(mean(-d, 0).alias("base"), mean(0, d).alias("stim"), mean(d, 2 * d).alias("tone"))


def condition_windows(peri: DataFrame, stims: DataFrame, d: int) -> DataFrame:
    """(recording_id, unit_id, stim, trials, base, stim_mean, tone): the trial-averaged trace of each condition of the stimuli (recording_id, frame, stim), averaged over the windows of ``trial_windows``."""
    own = peri.join(stims.select("recording_id", F.col("frame").alias("event"), "stim"), ["recording_id", "event"])
    mean = own.groupBy(*UNIT, "stim", "lag").agg(F.avg("value").alias("value"), F.count("value").alias("_n"))
    over = lambda a, b: F.avg(F.when(F.col("lag").between(a, b - 1), F.col("value")))
    return mean.groupBy(*UNIT, "stim").agg(F.max("_n").alias("trials"), over(-d, 0).alias("base"), over(0, d).alias("stim_mean"), over(d, 2 * d).alias("tone"))
