"""Analyses of recordings by their parameter objects: the operators in order, seconds turned into frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, events, latent, pairs, rows, signal, stats, windows
from ..operators.clean import UNIT
from . import low_high as windows_by_activity
from . import oscillators
from . import parameters as P


def low_high(onsets: DataFrame, n_frames: int, fps: float, p: P.LowHighWindows | P.ManifoldWindows = P.LowHighWindows()) -> DataFrame:
    """(recording_id, label, n, start, end): the windows with the fewest and the most onsets."""
    return windows_by_activity.low_high_windows(onsets, n_frames, P.Parameters.frames(p.window_minutes * 60, fps), P.Parameters.frames(p.step_minutes * 60, fps))


def manifold(arrays: DataFrame, onsets: DataFrame, n_frames: int, fps: float, p: P.ManifoldWindows = P.ManifoldWindows()) -> tuple[DataFrame, DataFrame]:
    """Components fitted on the low and high windows, of units with few enough missing values in both, which are filled: see ``latent.window_latents``."""
    picked = low_high(onsets, n_frames, fps, p)
    known = lambda t: F.size(F.filter(t, lambda x: x.isNotNull()))
    cut = windows_by_activity.window_slices(arrays, picked).groupBy(*UNIT).agg(F.min(known(F.col("trace")) / F.size("trace")).alias("_k"))
    good = arrays.join(cut.filter(F.col("_k") >= 1 - p.missing).select(*UNIT), UNIT, "left_semi")
    return latent.window_latents(rows.fill_missing(good), picked, p.components)


def phase_reset(arrays: DataFrame, onsets: DataFrame, n_frames: int, fps: float, p: P.PhaseReset = P.PhaseReset()) -> DataFrame:
    """Curves of ``events.event_curves`` around onsets that lie far enough apart and inside the recording; recordings with too few of them are left out."""
    reach = P.Parameters.frames(p.around, fps)
    kept = clean.peri_margin(clean.min_interval_thin(clean.valid_frames(onsets, n_frames), P.Parameters.frames(p.least_gap, fps)), reach, n_frames)
    if p.least_events is not None:
        kept = clean.min_count_gate(kept, p.least_events)
    lags = [P.Parameters.lags(s, fps) for s in (p.pre, p.post, p.peak)]
    return events.event_curves(events.phase_signals(arrays, fps, *p.band, p.order), kept, fps, reach, reach, *lags)


def mad_events(arrays: DataFrame, fps: float, p: P.MadEvents = P.MadEvents()) -> DataFrame:
    return events.mad_events(arrays, fps, p.height, p.prominence, p.gap, p.quantile, p.least)


def noise_model_events(arrays: DataFrame, bins: int = 1000, p: P.NoiseModelEvents = P.NoiseModelEvents()) -> DataFrame:
    """(recording_id, unit_id, start, end): runs of significant transients of traces sampled at ``p.rate``, short gaps filled and short runs dropped."""
    scaled = events.scaled_by_noise(arrays, events.baseline_noise(arrays))
    flags = events.significant_transients(scaled, events.odds_maps(scaled, p.rate, bins, p.confidence, p.decay), bins)
    on = flags.select(*UNIT, F.posexplode("trace").alias("frame", "flag")).withColumn("on", F.col("flag") > 0)
    return windows.merge_and_delete(on, "on", round(p.merge * p.rate), round(p.delete * p.rate))


def loops(latents: DataFrame, fps: float, p: P.Loops = P.Loops()) -> DataFrame:
    """Loops of the path of the first three components (recording_id, pc, frame, value), its radius smoothed."""
    path = windows.moving_mean(latent.trajectory(latents, fps), P.Parameters.frames(p.smooth, fps), ["recording_id"], "radius")
    return latent.loops(path, fps, p.low, p.peak, p.least)


def inter_hemisphere(arrays: DataFrame, positions: DataFrame, axis: str, fps: float, p: P.InterHemisphere = P.InterHemisphere()) -> DataFrame:
    """Cross-correlation of the mean traces of the two sides that ``signal.hemisphere_split`` finds on an axis."""
    own = rows.zscored(arrays) if p.zscored else arrays
    long = own.select(*UNIT, F.posexplode("trace").alias("frame", "value"))
    return signal.side_xcorr(long, signal.hemisphere_split(positions, axis), P.Parameters.frames(p.lag, fps), P.Parameters.frames(p.area, fps))


def corr_by_distance(arrays: DataFrame, positions: DataFrame, p: P.CorrByDistance = P.CorrByDistance()) -> tuple[DataFrame, DataFrame]:
    """(recording_id, bin, edge, r, pairs) on bins of each recording's own span, and (recording_id, bin, null_mean, null_sem) of shuffled positions on the same bins."""
    edges = pairs.distance_edges(positions, p.bins, p.least, p.fallback)
    return pairs.corr_between_edges(arrays, positions, edges), pairs.shuffled_between_edges(arrays, positions, edges, p.shuffles)


def condition_metrics(signals: DataFrame, fps: float, angle: bool = False, p: P.ConditionStats = P.ConditionStats()) -> DataFrame:
    """Behaviour metrics per subject and condition of raw signals (subject_id, cond, frame, value)."""
    moved = events.movement(signals, fps, p.smooth, angle)
    return events.quantify_by_condition(moved, p.k, P.Parameters.frames(p.least_bout, fps), fps, pooled=p.pooled)


def rhythm_against_noise(arrays: DataFrame, fps: float, band: tuple[float, float], welch_frames: int, lags: tuple[int, int], p: P.RhythmAgainstNoise = P.RhythmAgainstNoise()) -> DataFrame:
    """(recording_id, kind, metric, z, passed): a recording's representative signal against its surrogates."""
    window, step = P.Parameters.frames(p.window, fps), P.Parameters.frames(p.step, fps)
    one = signal.representative_signal(arrays, p.signal, fps, *band, welch_frames)
    of = lambda df, keys: signal.rhythm_metrics(df, fps, *band, window, step, welch_frames, lags, keys)
    made = [of(signal.surrogates(one, kind, p.surrogates, ["recording_id"]).filter("error is null"), ["recording_id", "seed"]).withColumn("kind", F.lit(kind)) for kind in ("phase", "ar1")]
    seen = of(one, ["recording_id"]).filter(F.col("metric").isin(*stats.SCORED))
    return stats.surrogate_scores(seen, made[0].unionByName(made[1]), ["window_cv", "inst_cv"])


def ensembles(arrays: DataFrame, fps: float, welch_frames: int, p: P.EnsembleComparison = P.EnsembleComparison()) -> DataFrame:
    return oscillators.ensembles(arrays, fps, list(p.ks), p.replicates, P.Parameters.frames(p.acf[1], fps), welch_frames, p.band)


def k_sweep(arrays: DataFrame, onsets: DataFrame, test: oscillators.OscillatorTest, p: P.KSweep = P.KSweep()) -> tuple[DataFrame, DataFrame]:
    """The sweep over an epoch of each recording; events outside it do not count."""
    first, last = (round(m * 60 * test.fps) for m in p.epoch_minutes)
    cut = arrays.select(*UNIT, F.slice("trace", first + 1, last - first).alias("trace"))
    inside = onsets.filter(F.col("frame").between(first, last - 1)).withColumn("frame", F.col("frame") - first)
    return oscillators.k_sweep(cut, inside, list(p.ks), test)
