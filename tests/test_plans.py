"""Parameter objects, and analyses that take them, on signals with known answers."""

from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tracemill.operators import events as E
from tracemill.operators import pairs as N
from tracemill.operators import ranks
from tracemill.plans import analyses
from tracemill.plans import parameters as P
from tracemill.plans.oscillators import OscillatorTest


def arrays(spark, x, recording=1):
    return spark.createDataFrame([(recording, i, row.tolist()) for i, row in enumerate(x)], "recording_id int, unit_id long, trace array<double>")


def test_defaults():
    reset = {"band": (0.01, 0.05), "around": 120.0, "pre": (-40.0, -5.0), "post": (5.0, 40.0), "peak": (0.0, 40.0), "least_events": 8, "least_gap": 20.0, "order": 3}
    want = {
        P.EnsembleComparison: {"ks": (2, 3, 4, 5, 6), "replicates": 20, "share": 0.8, "most": 8, "acf": (0.0, 120.0), "band": (0.005, 0.2), "prominence": 0.13},
        P.RhythmAgainstNoise: {"window": 300.0, "step": 60.0, "surrogates": 100, "signal": "pc1"},
        P.KSweep: {"ks": (3, 4, 5, 6, 8), "epoch_minutes": (2.0, 27.0)},
        P.LowHighWindows: {"window_minutes": 20.0, "step_minutes": 5.0, "missing": 0.20},
        P.ManifoldWindows: {"window_minutes": 20.0, "step_minutes": 5.0, "components": 10, "missing": 0.05},
        P.PhaseReset: reset, P.SensoryReset: reset | {"least_events": None},
        P.NoiseModelEvents: {"rate": 4.0, "decay": 2.0, "confidence": 0.99, "merge": 0.5, "delete": 0.5},
        P.MadEvents: {"height": 4.0, "gap": 3.5, "prominence": 2.5, "quantile": 0.9, "least": 10.0},
        P.Loops: {"smooth": 0.5, "low": 0.5, "peak": 1.0, "least": 1.0},
        P.InterHemisphere: {"lag": 120.0, "area": 10.0, "zscored": True},
        P.CorrByDistance: {"bins": 50, "least": 50.0, "fallback": 100.0, "shuffles": 100},
        P.ConditionStats: {"smooth": 0.10, "k": 4.0, "least_bout": 0.20, "pooled": True},
    }
    assert all(asdict(family()) == values for family, values in want.items()) and len(want) == 13
    o = OscillatorTest(10.0)
    assert (o.components, o.band, o.welch, o.quantile, o.locked, o.window, o.step, o.least_samples) == (6, (0.01, 0.10), 120.0, 0.20, 0.70, 600.0, 120.0, 20)


def test_bad_parameters_fail():
    for bad in (lambda: P.PhaseReset(band=(0.05, 0.01)), lambda: P.LowHighWindows(missing=1.5), lambda: P.MadEvents(gap=-1.0)):
        with pytest.raises(ValueError):
            bad()


def test_frequency_around_events_of_a_chirp(spark):
    """A rhythm that turns from 0.5 to 1 Hz at each event, with the same phase there."""
    fps, n = 20.0, 4000
    at = np.arange(400, 3700, 400)
    freq = np.where((np.arange(n) % 400) < 200, 1.0, 0.5)
    phase = 2 * np.pi * np.cumsum(freq) / fps
    x = np.cos(phase)
    events = spark.createDataFrame([(1, int(a)) for a in at], "recording_id int, frame int")
    signals = arrays(spark, x[None]).withColumn("phase", F.array(*[F.lit(float(v)) for v in np.angle(np.exp(1j * phase))]))
    got = E.event_curves(signals, events, fps, 100, 100, (-90, -30), (30, 90), (0, 90)).first()
    assert got.n == len(at) and abs(got.pre_freq - 0.5) < 1e-6 and abs(got.post_freq - 1.0) < 1e-6 and abs(got.delta_freq - 0.5) < 1e-6
    assert np.allclose(got.itpc, 1) and np.allclose(got.mean, x[at[0] - 100 : at[0] + 101])
    p = P.PhaseReset(band=(0.2, 2.0), around=5.0, pre=(-4.5, -1.5), post=(1.5, 4.5), peak=(0.0, 4.5), least_events=len(at), least_gap=10.0)
    real = analyses.phase_reset(arrays(spark, x[None]), events, n, fps, p).first()
    assert abs(real.pre_freq - 0.5) < 0.05 and abs(real.post_freq - 1.0) < 0.05 and real.n == len(at)
    assert analyses.phase_reset(arrays(spark, x[None]), events, n, fps, P.PhaseReset(band=(0.2, 2.0), around=5.0, pre=(-4.5, -1.5), post=(1.5, 4.5), peak=(0.0, 4.5), least_events=99, least_gap=10.0)).count() == 0


def test_components_of_the_windows_alone(spark):
    """A rhythm that only the high window has must lead there, and a drift outside of both must not count."""
    rng, t = np.random.default_rng(2), np.arange(300)
    weight = rng.normal(size=(40, 2))
    x = 0.05 * rng.normal(size=(40, 300))
    x[:, 200:260] += 3 * weight[:, :1] * np.sin(0.6 * t[200:260])
    x[:, 100:160] += weight[:, 1:] * np.sin(0.3 * t[100:160])
    x[:, :90] += 50 * rng.normal(size=(40, 1)) * np.linspace(1, 0, 90)
    picked = spark.createDataFrame([(1, "low", 100, 159), (1, "high", 200, 259)], "recording_id int, label string, start int, end int")
    from tracemill.operators.latent import window_latents

    pcs, cut = window_latents(arrays(spark, x), picked, 2)
    got = {(r.label, r.pc): np.array(r.trace) for r in cut.collect()}
    z = np.concatenate([x[:, 100:160], x[:, 200:260]], axis=1)
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, ddof=1, keepdims=True)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    for i in range(2):
        whole = np.concatenate([got["low", i], got["high", i]])
        assert abs(abs(whole @ v[i]) / s[i] - 1) < 1e-6
    assert got["high", 0].std() > 3 * got["low", 0].std() and pcs.count() == 2


def test_farthest_pair_and_hulls(spark):
    rng = np.random.default_rng(1)
    for points in (rng.normal(size=(500, 2)), rng.integers(0, 5, (60, 2)), np.zeros((4, 2)), np.array([[1.0, 2.0]]), np.column_stack([np.arange(9.0), np.arange(9.0)]), np.column_stack([np.cos(np.arange(200)), np.sin(np.arange(200))])):
        far = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)).max()
        assert abs(N.widest(N.hull(np.asarray(points, float))) - far) < 1e-12
    rows = [(r, i, float(x), float(y)) for r in range(3) for i, (x, y) in enumerate(rng.normal(size=(400, 2)) * 20 * (r + 1))] + [(7, 1, 1.0, 1.0), (7, 2, None, 3.0)]
    got = {r.recording_id: r for r in N.span(spark.createDataFrame(rows, "recording_id int, unit_id int, x double, y double").repartition(5)).collect()}
    for r in range(3):
        own = np.array([(x, y) for q, _, x, y in rows if q == r])
        assert got[r].units == 400 and abs(got[r].top - np.hypot(*(own[:, None] - own[None]).transpose(2, 0, 1)).max()) < 1e-9
    assert got[7].units == 1 and got[7].top == 0


@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (8, 3), (2, 1)])
def test_medians_of_pairs_by_counting(spark, bins, few):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 12))
    x[7], x[9] = x[3], x[3]  # equal correlations
    frame = arrays(spark, x).unionByName(arrays(spark, x[:2], 2)).unionByName(arrays(spark, x[:5] * 0 + np.arange(12), 3))
    band = spark.createDataFrame([(r, u) for r, u in [(1, 2), (1, 3), (1, 7), (1, 11), (1, 9), (2, 0), (3, 1), (3, 2)]], "recording_id int, unit_id long")
    got = {r.recording_id: r for r in N.band_vs_rest(frame, band, bins=bins, few=few).collect()}
    r, inside = np.corrcoef(x), np.isin(np.arange(30), [2, 3, 7, 11, 9])
    upper = np.triu(np.ones((30, 30), bool), 1)
    for name, members in (("within", 2), ("across", 1)):
        own = r[upper & (inside[:, None].astype(int) + inside[None] == members)]
        assert abs(got[1][f"{name}_median"] - np.median(own)) < 1e-12 and abs(got[1][name] - own.mean()) < 1e-12 and got[1][f"{name}_pairs"] == len(own)
    assert got[2].within_pairs == 0 and got[2].within_median is None and got[2].across_pairs == 1
    assert got[3].within_pairs == 1 and abs(got[3].within_median - 1) < 1e-12 and got[3].across_pairs == 6


def test_ranks_in_two_levels(spark):
    rng = np.random.default_rng(5)
    values = [(int(g), None if rng.random() < 0.02 else float(np.round(rng.normal() * (1 if g else 0.001), 2 if g else 6)), i) for i, g in enumerate(rng.integers(0, 3, 6000))]
    frame = spark.createDataFrame(values, "g int, v double, i int").repartition(4)
    got = {r.i: r for r in ranks.mean_rank(ranks.places(frame, ["g"], F.col("v"), [F.col("v").asc_nulls_last(), "i"], "k", ranges=7), ["g"], "v", ranges=7).collect()}
    med = {r.g: r for r in ranks.group_median(frame, ["g"], "v", ranges=7).collect()}
    for g in range(3):
        own = sorted(((v is None, v or 0.0, i) for q, v, i in values if q == g))
        known = np.array([v for none, v, _ in own if not none])
        assert abs(med[g].median - np.median(known)) < 1e-12 and med[g].n == len(known)
        for place, (none, v, i) in enumerate(own, 1):
            assert got[i].k == place and got[i].k_all == len(own)
            assert got[i]["rank"] is None if none else abs(got[i]["rank"] - ((known < v).sum() + ((known == v).sum() + 1) / 2)) < 1e-9
    none_by = ranks.group_median(frame.filter("g = 1"), [], "v").first()
    assert abs(none_by.median - med[1].median) < 1e-12


def test_no_task_ranks_a_large_recording_alone(spark):
    """One recording: the largest range that a window orders is a small part of its units."""
    frame = spark.range(200_000).select(F.lit(1).alias("g"), (F.rand(3) ** 4).alias("v"))
    told = ranks.running(frame, ["g"], F.col("v"), ["v"], {"k": F.lit(1)}, ranges=64)
    assert told.agg(F.max("k")).first()[0] == 200_000
    cuts = frame.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], ranks.ACCURACY)).first()[0]
    sizes = np.histogram([r.v for r in frame.collect()], bins=[-1, *cuts, 2])[0]
    assert sizes.max() < 3 * 200_000 / 64


def test_inter_hemisphere_and_loops(spark):
    t = np.arange(600)
    x = np.concatenate([np.repeat(np.sin(0.05 * t)[None], 6, 0), np.repeat(np.sin(0.05 * (t - 10))[None], 6, 0)]) + 0.01 * np.random.default_rng(0).normal(size=(12, 600))
    places = spark.createDataFrame([(1, i, float(i // 6 * 10 + i % 6 * 0.1)) for i in range(12)], "recording_id int, unit_id long, x double")
    got = analyses.inter_hemisphere(arrays(spark, x), places, "x", 2.0, P.InterHemisphere(lag=20.0)).first()
    assert abs(abs(got.peak_lag) - 10) <= 1 and got.peak > 0.95
    turns = spark.createDataFrame([(1, pc, int(i), float(v)) for pc, row in enumerate((np.cos(0.1 * t) * (1 + np.sin(0.02 * t)), np.sin(0.1 * t) * (1 + np.sin(0.02 * t)), 0.01 * np.cos(t))) for i, v in enumerate(row)], "recording_id int, pc int, frame int, value double")
    assert analyses.loops(turns, 2.0).count() >= 1
