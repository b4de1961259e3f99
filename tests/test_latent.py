import numpy as np
import pytest
from pyspark.sql import functions as F
from tracemill.operators import latent as L
from tracemill.operators import signal as R
from tracemill.operators import stats as S


def arrays(spark, x, recording=1):
    return spark.createDataFrame([(recording, i, row.tolist()) for i, row in enumerate(x)], "recording_id int, unit_id long, trace array<double>")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 80)) + 0.2 * rng.normal(size=(30, 80))
    z = x - x.mean(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    s = np.linalg.svd(z, compute_uv=False)
    p = L.pca(arrays(spark, x).repartition(3), 4)
    rows = p.orderBy("pc").collect()
    assert np.allclose([r.share for r in rows], s[:4] ** 2 / 30, atol=1e-3)
    v = np.linalg.svd(z, full_matrices=False)[2][:3]
    assert all(abs(abs(np.array(r.score) @ v[r.pc]) - 1) < 1e-3 for r in rows[:3])
    load = L.loadings(arrays(spark, x), p).filter("pc = 0").orderBy("unit_id").collect()
    assert np.allclose([r.loading for r in load], z @ np.array(rows[0].score), atol=1e-6)


def test_lds_finds_rotation(spark):
    w, r, fps = 2 * np.pi * 0.05, 0.995, 10.0
    rng = np.random.default_rng(1)
    x = np.zeros((2, 3000))
    x[:, 0] = 1
    a = r * np.array([[np.cos(w), -np.sin(w)], [np.sin(w), np.cos(w)]])
    for t in range(2999):
        x[:, t + 1] = a @ x[:, t] + 0.05 * rng.normal(size=2)
    rows = [(1, pc, t, float(x[pc, t])) for pc in range(2) for t in range(3000)]
    latent = spark.createDataFrame(rows, "recording_id int, pc int, frame int, value double")
    got = L.lds_fit(latent, fps, 0.1, 1.0).collect()
    assert len(got) == 2 and all(abs(g.magnitude - r) < 0.01 and abs(g.freq - 0.05 * fps) < 0.02 and g.pairs == 1 for g in got)


def test_phase_locking_and_components(spark):
    t = np.arange(400)
    rng = np.random.default_rng(2)
    ph = {0: 0.1 * t, 1: 0.1 * t + 1.0, 2: rng.uniform(-np.pi, np.pi, 400)}
    rows = [(1, pc, int(i), float(v[i]), 1.0 + int(i) % 7) for pc, v in ph.items() for i in t]
    phases = spark.createDataFrame(rows, "recording_id int, pc int, frame int, phase double, amp double")
    plv = L.phase_locking(phases)
    got = {(r.a, r.b): r for r in plv.collect()}
    assert got[0, 1].plv == pytest.approx(1) and got[0, 1].lag == pytest.approx(-1) and got[0, 2].plv < 0.3
    assert {r.pc: r.component for r in L.phase_components(plv, phases).collect()} == {0: 0, 1: 0, 2: 2}


def test_varimax_recovers_simple_structure(spark):
    truth = np.repeat(np.eye(3), 10, axis=0) + 0.02 * np.random.default_rng(3).normal(size=(30, 3))
    q = np.linalg.qr(np.random.default_rng(4).normal(size=(3, 3)))[0]
    mixed = truth @ q
    load = spark.createDataFrame([(1, u, c, float(mixed[u, c])) for u in range(30) for c in range(3)], "recording_id int, unit_id int, pc int, loading double").repartition(3)
    mode = {r.unit_id: r["mode"] for r in L.varimax_assign(load).collect()}
    groups = [{mode[u] for u in range(10 * g, 10 * g + 10)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_kmeans_rows(spark):
    t = np.arange(60)
    x = np.array([np.sin(0.3 * t + (0 if u < 8 else 1.5)) + 0.1 * np.random.default_rng(u).normal(size=60) for u in range(16)])
    got = L.kmeans_rows(arrays(spark, x), [2, 3], 4).collect()
    c = {r.unit_id: r.cluster for r in got if r.k == 2}
    assert len({c[u] for u in range(8)}) == len({c[u] for u in range(8, 16)}) == 1 and c[0] != c[8]
    assert len({r.cluster for r in got if r.k == 3}) == 3 and len(got) == 32


def test_passes_agree_with_the_exact_solution(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 50)) + 0.3 * rng.normal(size=(40, 50))
    frame = arrays(spark, x, 1).unionByName(arrays(spark, x[:, :20] + 1, 2))
    exact = {(r.recording_id, r.pc): r for r in L.pca(frame, 3).collect()}
    passed = {(r.recording_id, r.pc): r for r in L.pca(frame, 3, gram_frames=30).collect()}
    assert set(exact) == set(passed) and len(exact) == 6
    for key, r in exact.items():
        assert passed[key].share == pytest.approx(r.share, abs=1e-6) and np.allclose(passed[key].score, r.score, atol=1e-3)


def test_time_components_against_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(25, 12))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
    c = z - z.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    patterns, scores = L.pca_time(arrays(spark, x), 3)
    for r in patterns.collect():
        assert r.variance == pytest.approx(s[r.pc] ** 2 / 24, rel=1e-6)
        assert np.allclose(np.abs(r.pattern), np.abs(vt[r.pc]) * s[r.pc] / np.sqrt(24), atol=1e-6)
    got = {(r.unit_id, r.pc): r.score for r in scores.collect()}
    assert all(abs(got[i, p]) == pytest.approx(abs(u[i, p] * s[p]), abs=1e-6) for i in range(25) for p in range(3))


def test_cosine_modes_against_numpy(spark):
    x = np.random.default_rng(11).normal(size=(20, 30))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
    y = z / np.linalg.norm(z, axis=0)
    u, s, _ = np.linalg.svd(y.T @ y)
    r = np.array([[np.corrcoef(row, u[:, j])[0, 1] for j in range(3)] for row in z])
    got = {g.unit_id: g for g in L.cosine_assign(arrays(spark, x), 3).collect()}
    for i in range(20):
        best = int(np.abs(r[i]).argmax())
        assert got[i]["mode"] == best and abs(got[i].r) == pytest.approx(abs(r[i, best]), abs=1e-6)


def test_varimax_against_the_whole_matrix(spark):
    """The rotation found from moments gives the labels of the rotation of the whole coefficient matrix."""
    x = np.random.default_rng(12).normal(size=(30, 40))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, ddof=1, keepdims=True)
    coefficients = np.linalg.svd(z, full_matrices=False)[0][:, :4]
    rot, was = np.eye(4), 0.0
    for _ in range(100):
        turned = coefficients @ rot
        u, s, vt = np.linalg.svd(coefficients.T @ (turned**3 - turned * (turned**2).sum(axis=0) / 30))
        rot = u @ vt
        if was and s.sum() / was < 1 + 1e-6:
            break
        was = s.sum()
    want = np.abs(coefficients @ rot).argmax(axis=1)
    pcs = L.pca(arrays(spark, x), 4)
    got = {r.unit_id: r["mode"] for r in L.varimax_assign(L.loadings(arrays(spark, x), pcs, unit_norm=True)).collect()}
    assert [got[i] for i in range(30)] == want.tolist()
    q = L.varimax_components(L.pca(arrays(spark, x), 8)).first().q
    share = np.cumsum(np.linalg.svd(z, compute_uv=False) ** 2) / (z**2).sum()
    assert q == min(8, max(2, int(np.argmax(share >= 0.8)) + 1))


def test_windows_of_fixed_latents(spark):
    t = np.arange(400) / 10.0
    rows = [(1, 0, np.sin(2 * np.pi * 0.5 * t).tolist()), (1, 1, np.cos(2 * np.pi * 0.5 * t).tolist())]
    latent = spark.createDataFrame(rows, "recording_id int, pc int, trace array<double>")
    picked = spark.createDataFrame([(1, "low", 0, 199), (1, "high", 200, 399)], "recording_id int, label string, start int, end int")
    got = {r.label: r for r in L.fixed_latent_windows(latent, picked, 10.0, 0.2, 1.0, 100).collect()}
    assert set(got) == {"full", "low", "high"}
    for r in got.values():
        assert r.pairs == 1 and r.freq_cv == pytest.approx(0, abs=1e-9) and r.plv > 0.95 and sum(r.fractions) == pytest.approx(1)
        assert all(abs(f - 0.5) < 0.06 for f in r.freqs)
    events = spark.createDataFrame([(1, 5), (1, 105), (1, 399)], "recording_id int, frame int")
    slid = {r.start: r for r in L.sliding_oscillators(latent, events, 10.0, 100, 100, 0.2, 1.0, 100).collect()}
    assert sorted(slid) == [0, 100, 200, 300] and [slid[s].events for s in sorted(slid)] == [1, 1, 0, 1]
    assert slid[100].centre == 15.0 and all(r.pairs == 1 for r in slid.values())


def test_labels_of_recordings(spark):
    rows = [(1, 0.9, 0.0, 1, 0, L.ONE), (1, None, 0.0, 1, 0, L.MIXED), (2, 0.9, 0.2, 1, 0, L.SEVERAL), (2, 0.5, 0.0, 1, 0, L.SEVERAL), (2, None, 0.0, 2, 0, L.SEVERAL), (2, 0.8, 0.1, 1, 3, L.TRANSIENT), (0, 0.5, None, 1, 1, L.MIXED)]
    df = spark.createDataFrame(rows, "pairs int, plv double, cv double, groups int, sliding int, want string")
    from pyspark.sql import functions as F

    got = df.select("want", L.interpretation(F.col("pairs"), F.col("plv"), F.col("cv"), F.col("groups"), F.col("sliding")).alias("label")).collect()
    assert all(r.want == r.label for r in got)


def test_trajectory_of_a_circle(spark):
    a = 2 * np.pi * np.arange(101) / 50
    rows = [(1, pc, i, float(v)) for i in range(101) for pc, v in enumerate((np.cos(a[i]), np.sin(a[i]), 0.0))]
    path = L.trajectory(spark.createDataFrame(rows, "recording_id int, pc int, frame int, value double"), 10.0)
    s = L.trajectory_summary(path, 10.0).first()
    assert s.rotations == pytest.approx(2, abs=0.02) and s.radius == pytest.approx(1, abs=0.03)


def test_bad_trace_is_reported_not_fatal(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0]), (1, 1, [])], "recording_id int, unit_id long, trace array<double>")
    got = {r.unit_id: r for r in R.acf(df, 2).collect()}
    assert got[0].error is None and len(got[0].acf) == 3 and got[1].acf is None and got[1].error
    band = {r.unit_id: r for r in R.bandpass(df, 10.0, 1.0, 2.0).collect()}
    assert band[0].error is None and len(band[0].trace) == 3 and band[1].trace is None and band[1].error == "empty trace"


def test_events_of_traces(spark):
    from tracemill.operators import events as E

    rng = np.random.default_rng(13)
    t = np.arange(600)
    x = 0.2 * rng.normal(size=(12, 600)) + 3
    for start in (100, 350):
        x += np.where(t >= start, 3 * np.exp(-np.maximum(t - start, 0) / 12), 0)
    frame = arrays(spark, x)
    noise = {r.unit_id: r for r in E.baseline_noise(frame).collect()}
    assert all(abs(n.mu - 3) < 0.15 and abs(n.sigma - 0.2) < 0.08 for n in noise.values())
    own = E.scaled_by_noise(frame, E.baseline_noise(frame))
    maps = E.odds_maps(own, 4.0, 300)
    raster = np.stack([r.trace for r in E.significant_transients(own, maps, 300).orderBy("unit_id").collect()])
    assert raster[:, 102:110].mean() > 0.8 and raster[:, :95].mean() < 0.02 and raster[:, 200:340].mean() < 0.02
    cells = E.significant_cells(E.transition_counts(own, 300), maps, 300).collect()
    zero = maps.first()
    assert cells and all(c.gi > (0 - zero.low) / (zero.high - zero.low) * 299 - 60 for c in cells)


def test_p_values(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1.1, 2.2, 3.3, 4.4, 5.5]] + [(2, float(v)) for v in range(-20, 30)], "g int, v double")
    got = {r.g: r.p for r in S.signrank(df, ["g"], "v").collect()}
    assert got[1] == pytest.approx(0.0625) and 0 < got[2] < 0.1
    chi = spark.createDataFrame([(5.991, 2.0), (3.841, 1.0)], "x double, d double").select(S.chi2_p("x", "d").alias("p")).collect()
    assert all(abs(r.p - 0.05) < 1e-3 for r in chi)
    t = spark.createDataFrame([(0.6, 12), (0.0, 9)], "r double, n int").select(S.corr_p("r", "n").alias("p")).collect()
    assert t[0].p == pytest.approx(0.0391, abs=1e-3) and t[1].p == pytest.approx(1)
    f = spark.createDataFrame([(8, 2, 1, 5)], "a int, b int, c int, d int").select(S.fisher_p("a", "b", "c", "d").alias("p")).first()
    assert f.p == pytest.approx(0.034965, abs=1e-5)


def _likelihood(rows, ratio):
    """Log likelihood at the best coefficients, from the whole covariance matrix."""
    s, x, y = (np.array(c) for c in zip(*rows))
    v = np.eye(len(y)) + ratio * (s[:, None] == s[None])
    w, design = np.linalg.inv(v), np.stack([np.ones(len(x)), x], axis=1)
    b = np.linalg.solve(design.T @ w @ design, design.T @ w @ y)
    var = (y - design @ b) @ w @ (y - design @ b) / len(y)
    return b, -0.5 * (len(y) * np.log(2 * np.pi * var) + np.linalg.slogdet(v)[1] + len(y)), np.sqrt(np.linalg.inv(design.T @ w @ design)[1, 1] * var)


def test_random_intercept(spark):
    """Three groups fitted together against the whole covariance matrix; groups without spread or rows."""
    rng = np.random.default_rng(5)
    rows = []
    for g, spread in enumerate((1.0, 0.3, 2.0)):
        for s in range(25):
            u = rng.normal(0, spread)
            rows += [(g, s, float(x), float(2 + 0.7 * x + u + 0.5 * rng.normal())) for x in rng.normal(size=rng.integers(3, 12))]
    more = [(3, s, 1.0, float(s)) for s in range(4)] + [(0, None, 1.0, 2.0), (None, 1, 1.0, 2.0), (1, 2, None, 2.0), (1, 2, 1.0, None)]
    frame = spark.createDataFrame(rows + more, "g int, s int, x double, y double")
    fits = {r.g: r for r in S.random_intercept(frame, ["g"], "s", "x", "y").collect()}
    assert set(fits) == {0, 1, 2, 3} and fits[3].b1 is None and fits[3].ll is None and fits[3].lr is None and fits[3].n == 4
    for g in range(3):
        fit, own = fits[g], [r[1:] for r in rows if r[0] == g]
        b, ll, se = _likelihood(own, fit.ratio)
        assert (fit.b0, fit.b1) == pytest.approx(tuple(b)) and fit.ll == pytest.approx(ll) and fit.se == pytest.approx(se) and fit.n == len(own)
        assert all(_likelihood(own, fit.ratio * f)[1] <= ll + 1e-6 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
        assert abs(fit.b1 - 0.7) < 0.15 and fit.p < 1e-6 and fit.lr_p < 1e-6
    whole = S.random_intercept(frame.filter("g = 0"), [], "s", "x", "y").collect()
    assert len(whole) == 1 and whole[0].b1 == pytest.approx(fits[0].b1)
    assert S.random_intercept(frame.limit(0), ["g"], "s", "x", "y").count() == 0


def test_surrogates_are_seeded(spark):
    x = np.random.default_rng(6).normal(size=(2, 64))
    a = R.surrogates(arrays(spark, x), "phase", 2).orderBy("unit_id", "seed").collect()
    b = R.surrogates(arrays(spark, x), "phase", 2).orderBy("unit_id", "seed").collect()
    assert a == b and a[0].trace != a[1].trace


def test_partial_sums_meet_in_a_tree(spark, monkeypatch):
    """64 tasks with a part of one recording: at least 8 salts, none with more parts than their square root."""
    x = np.random.default_rng(4).normal(size=(256, 40))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = arrays(spark, x).repartition(64).select("recording_id", "unit_id", "trace")
        parts = L._sums(rows, "trace", lambda t: np.stack(t.column(2).to_pylist()).sum(axis=0))
        salts = {r.salt: r.n for r in parts.select("salt", F.spark_partition_id().alias("p")).groupBy("salt").agg(F.count_distinct("p").alias("n")).collect()}
        assert len(salts) >= 8 and max(salts.values()) <= 8
        assert np.allclose(L._added_up(parts).first().y, x.sum(axis=0))
        assert np.allclose(L.frame_sums(rows, 2).first().y, (x * x).sum(axis=0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("frames", [256, 2049])
def test_long_recordings_against_numpy(spark, frames):
    """Noise, whose values lie close together: the passes end when no component moves."""
    x = np.random.default_rng(8).normal(size=(60 if frames > 2048 else 400, frames))
    got = {r.pc: r for r in L.pca(arrays(spark, x), 6, gram_frames=100 if frames < 2048 else L.GRAM_FRAMES).collect()}
    z = x - x.mean(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    for i in range(6):
        assert abs(got[i].share - s[i] ** 2 / len(x)) < 1e-9
        assert abs(abs(np.dot(got[i].score, v[i])) - 1) < 1e-6
