"""Oscillators of a population: the test of one recording, the choice of K, and the comparison of ensembles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import latent, signal, windows
from ..operators.clean import UNIT
from ..operators.pairs import _standardised
from ..sources.staging import staged


@dataclass(frozen=True)
class OscillatorTest:
    """Parameters of the test of one recording; times in seconds, frequencies in Hz."""

    fps: float
    components: int = 6
    band: tuple[float, float] = (0.01, 0.10)
    welch: float = 120.0
    quantile: float = 0.20
    locked: float = 0.70
    window: float = 600.0
    step: float = 120.0
    least_samples: int = 20

    def frames(self, seconds: float) -> int:
        return max(1, round(seconds * self.fps))


def components(arrays: DataFrame, most: int) -> DataFrame:
    return latent.pca(arrays, most)


def summaries_of_ks(arrays: DataFrame, pcs: DataFrame, events: DataFrame, ks: list[int], p: OscillatorTest) -> tuple[DataFrame, DataFrame]:
    """For every K the measures of a recording's first K components, and the mode of each unit among them.

    (recording_id, k, share, occupied, pairs, freq_cv, plv, groups, sliding_mean, sliding_most, separation,
    label) and (recording_id, unit_id, k, mode, sign, strength). What belongs to a component (spectrum, phases,
    loadings) or to a pair of them (products, locking) is found once; each K reads its leading part.
    """
    spark, rec = arrays.sparkSession, "recording_id"
    key, (low, high) = [rec, "k"], p.band
    of_ks = lambda df, col: df.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k > F.col(col))))
    pcs = pcs.filter(F.col("pc") < max(ks))
    arr = staged(spark, latent.latent_arrays(pcs), "oscillator-latents")
    long = arr.select(rec, "pc", F.posexplode("trace").alias("frame", "value"))
    pairs = latent.leading_pairs(latent.lagged_products(long), ks, p.fps, low, high)
    welch = p.frames(p.welch)
    dom = signal.dominant_freq(signal.welch_spectra(arr, p.fps, welch, welch // 2, welch, keys=[rec, "pc"]), low, high, [rec, "pc"])
    freqs = of_ks(dom, "pc").groupBy(*key).agg((F.stddev_samp("dom") / F.avg("dom")).alias("freq_cv"))
    phases = signal.long_phases(signal.analytic_signal(signal.bandpass(arr, p.fps, low, high, keys=[rec, "pc"]), [rec, "pc"]), [rec, "pc"])
    locks = of_ks(staged(spark, latent.phase_locking(phases, p.quantile, p.least_samples), "oscillator-locks"), "b")
    plv = locks.groupBy(*key).agg(F.avg("plv").alias("plv"))
    # a recording under one K is a graph of its own
    groups = latent.phase_components(locks.select(graph_key(rec), "a", "b", "plv"), of_ks(pcs, "pc").select(graph_key(rec), "pc"), p.locked).groupBy(rec).agg(F.count_distinct("component").alias("groups"))
    split = lambda df, *columns: df.select(F.regexp_extract(rec, "^[0-9]+/(.*)$", 1).cast(dict(arrays.dtypes)[rec]).alias(rec), F.regexp_extract(rec, "^([0-9]+)/", 1).cast("int").alias("k"), *columns)
    groups = split(groups, "groups")
    cut = latent.sliding_windows_of(arr, max(20, p.frames(p.window)), p.frames(p.step)).select(rec, "start", "pc", F.posexplode("trace").alias("frame", "value"))
    sliding = latent.leading_pairs(latent.lagged_products(cut, [rec, "start"]), ks, p.fps, low, high, keys=[rec, "start"])
    sliding = sliding.groupBy(*key).agg(F.avg("pairs").alias("sliding_mean"), F.max("pairs").alias("sliding_most"))
    load = of_ks(latent.loadings(arrays, pcs, unit_norm=True), "pc")
    best = load.groupBy(*UNIT, "k").agg(F.max(F.struct(F.abs("loading").alias("a"), (-F.col("pc")).alias("m"), F.signum("loading").alias("s"))).alias("b"))
    modes = staged(spark, best.select(*UNIT, "k", (-F.col("b.m")).alias("mode"), F.col("b.s").cast("int").alias("sign"), F.col("b.a").alias("strength")), "oscillator-modes")
    sizes = modes.groupBy(*key, "mode").agg(F.count(F.lit(1)).alias("units"))
    sums = latent.group_frame_sums(arrays.join(modes.select(*UNIT, "k", "mode"), UNIT).select(*key, "mode", "trace"), [*key, "mode"])
    means = sums.join(sizes, [*key, "mode"]).select(graph_key(rec), "mode", F.posexplode(F.transform("y", lambda x: x / F.col("units"))).alias("frame", "value"))
    dominant = windows.dominant_mode_per_frame(means)
    points = latent.frame_points(of_ks(long.filter(F.col("pc") < 3), "pc").select(graph_key(rec), "pc", "frame", "value"), dominant)
    separation = split(latent.geometry_separation(points, 5), "separation")
    shares = of_ks(pcs, "pc").groupBy(*key).agg(F.sum("share").alias("share"))
    occupied = modes.groupBy(*key).agg(F.count_distinct("mode").alias("occupied"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [shares, occupied, pairs, freqs, plv, groups, sliding, separation])
    label = latent.interpretation(F.col("pairs"), F.col("plv"), F.col("freq_cv"), F.col("groups"), F.col("sliding_most"))
    return out.withColumn("label", label), modes


def graph_key(rec: str) -> Column:
    """A recording under one K as a recording of its own."""
    return F.concat_ws("/", "k", rec).alias(rec)


def summaries(arrays: DataFrame, pcs: DataFrame, events: DataFrame, p: OscillatorTest) -> tuple[DataFrame, DataFrame]:
    """The same for the number of components that ``p`` names, without the column k."""
    found, modes = summaries_of_ks(arrays, pcs, events, [p.components], p)
    return found.drop("k"), modes.drop("k")


def k_sweep(arrays: DataFrame, events: DataFrame, ks: list[int], p: OscillatorTest) -> tuple[DataFrame, DataFrame]:
    """The test for each number of components: measures per K and recording with the stability against the K before, and the selection of K."""
    spark = arrays.sparkSession
    per, modes = summaries_of_ks(arrays, components(arrays, max(ks)), events, ks, p)
    stable = latent.assignment_stability(modes.select("k", *UNIT, "mode"), ks).select("recording_id", "k", F.col("equal").alias("stability"), F.col("jaccard").alias("kept"))
    per = per.join(stable, ["recording_id", "k"], "left")
    per = per.withColumn("has_pair", (F.col("pairs") > 0).cast("double")).withColumn("transient", (F.col("sliding_most") > 0).cast("double"))
    per = staged(spark, per, "sweep-all")
    return per, latent.k_selection(per, ["share", "plv", "has_pair", "transient", "separation", "stability"], ["groups", "freq_cv"])


def ensembles(arrays: DataFrame, fps: float, ks: list[int], seeds: int, acf_lags: int, welch_frames: int, band: tuple[float, float]) -> DataFrame:
    """(recording_id, method, k, clusters, used, within, acf_within, freq_cv, silhouette, score): ways to group units, evaluated alike and ranked within each recording.

    k-means and varimax-rotated components of the traces and of their autocorrelations, for each K and the K that holds
    80 % of the variance, and modes of the frames' cosine similarity.
    """
    spark = arrays.sparkSession
    acfs = staged(spark, signal.acf(arrays, acf_lags).filter("error is null").select(*UNIT, F.col("acf").alias("trace")), "ensemble-acf")
    spectra = signal.welch_spectra(arrays, fps, welch_frames, welch_frames // 2, welch_frames)
    dom = staged(spark, signal.dominant_freq(spectra, *band), "ensemble-dom")
    # a recording's traces and its autocorrelations are recordings of their own, so that all goes through the same passes
    named = lambda df, name: _standardised(df).withColumn("recording_id", F.concat_ws("/", F.lit(name), "recording_id"))
    both = staged(spark, named(arrays, "trace").unionByName(named(acfs, "acf")), "ensemble-units")
    pcs = latent.pca(both, max(8, *ks), standardise=False)
    load = staged(spark, latent.loading_rows(latent.loadings(both, pcs, unit_norm=True, standardise=False)), "ensemble-loadings")
    ways = F.array(*[F.struct(F.lit("varimax").alias("way"), F.lit(k).alias("k")) for k in ks], F.struct(F.lit("varimax 80 %").alias("way"), F.col("q").alias("k")))
    load = load.join(latent.varimax_components(pcs), "recording_id").select("recording_id", "unit_id", "l", F.explode(ways).alias("w"))
    modes = latent.varimax_modes(load.select(F.concat_ws("/", "w.way", "w.k", "recording_id").alias("recording_id"), "unit_id", F.slice("l", F.lit(1), F.col("w.k")).alias("l")))
    kind, part = dict(arrays.dtypes)["recording_id"], lambda n, i: F.split("recording_id", "/", n)[i]
    columns = lambda n, way, k, mode: [part(n, n - 1).cast(kind).alias("recording_id"), F.concat_ws(" ", part(n, n - 2), way).alias("method"), k.cast("int").alias("k"), "unit_id", F.col(mode).cast("int").alias("cluster")]
    found = [latent.kmeans_rows(both, ks, seeds).select(columns(2, F.lit("k-means"), F.col("k"), "cluster")), modes.select(columns(4, part(4, 0), part(4, 1), "mode"))]
    best = lambda k: F.max(F.when(F.col("pc") < k, F.struct(F.abs("loading").alias("a"), (-F.col("pc")).alias("m"))))["m"]
    cosine = latent.cosine_correlations(arrays, max(ks)).groupBy(*UNIT).agg(F.array(*[F.struct(F.lit(k).alias("k"), (-best(k)).cast("int").alias("cluster")) for k in ks]).alias("c"))
    found.append(cosine.select("recording_id", F.lit("cosine modes").alias("method"), "unit_id", F.inline("c")).select("recording_id", "method", "k", "unit_id", "cluster"))
    solutions = staged(spark, reduce(DataFrame.unionByName, found).withColumn("solution", F.concat_ws("/", "method", "k")), "ensemble-labels")
    quality = latent.cluster_eval(arrays, solutions, acfs, dom)
    return latent.cluster_ranking(quality.join(solutions.select("recording_id", "solution", "method", "k").distinct(), ["recording_id", "solution"]).drop("solution"))
