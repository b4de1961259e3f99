import numpy as np
from tracemill.functions import kernels as k

FS = 10.0
T = np.arange(2000) / FS


def test_welch_peak_and_variance():
    x = np.sin(2 * np.pi * 0.5 * T) + 3
    f, p = k.welch(x - x.mean(), FS, k.hann(400), 200, 400)
    assert abs(f[np.argmax(p)] - 0.5) <= f[1]
    noise = np.random.default_rng(0).normal(size=20000)
    f, p = k.welch(noise, FS, k.hann(256), 128, 256)
    assert abs(p.sum() * f[1] - noise.var()) < 0.05


def test_acf_of_sine_and_peaks():
    r = k.acf(np.sin(2 * np.pi * 0.5 * T), 100)
    at, prom = k.find_peaks(r, prominence=0.5)
    assert r[0] == 1 and at[0] == 20 and (prom > 0.5).all()


def test_find_peaks_rules():
    x = np.array([0, 1, 1, 0, 3, 0, 2, 0, 5.0])
    assert k.find_peaks(x)[0].tolist() == [1, 4, 6]
    assert k.find_peaks(x)[1].tolist() == [1, 3, 2]
    assert k.find_peaks(x, height=2)[0].tolist() == [4, 6]
    assert k.find_peaks(x, distance=3)[0].tolist() == [1, 4]
    assert k.find_peaks(x, prominence=2.5)[0].tolist() == [4]


def test_bandpass_keeps_band_and_phase():
    keep, drop = np.sin(2 * np.pi * 0.5 * T), np.sin(2 * np.pi * 3 * T)
    y = k.filtfilt(k.butter_bandpass(3, 0.3, 0.8, FS), keep + drop + 2)[0]
    mid = slice(300, -300)
    assert np.abs(y[mid] - keep[mid]).max() < 0.03


def test_low_band_is_stable():
    x = np.random.default_rng(1).normal(size=4000)
    y = k.filtfilt(k.butter_bandpass(3, 0.01, 0.1, 14.64), x)[0]
    assert np.isfinite(y).all() and y.std() < x.std()


def test_analytic_phase_and_amplitude():
    z = k.analytic(2 * np.cos(2 * np.pi * 0.5 * T))
    assert np.allclose(np.abs(z), 2, atol=1e-6)
    assert np.allclose(np.unwrap(np.angle(z)), 2 * np.pi * 0.5 * T, atol=1e-6)


def test_xcorr_lag():
    x = np.random.default_rng(2).normal(size=500)
    lags, r = k.xcorr(np.roll(x, 7), x, 20)
    assert lags[np.argmax(r)] == 7


def test_resample_keeps_slow_sine():
    x = np.sin(2 * np.pi * 0.2 * T)
    y = k.resample(x, FS, 4.0)
    assert len(y) == 800 and np.abs(y[20:-20] - np.sin(2 * np.pi * 0.2 * np.arange(800) / 4)[20:-20]).max() < 0.02


def test_surrogates():
    x = np.random.default_rng(3).normal(size=400).cumsum()
    s = k.phase_randomised(x, 1)
    assert np.allclose(np.abs(np.fft.rfft(s)), np.abs(np.fft.rfft(x)), atol=1e-6)
    a = k.ar1_surrogate(x, 1)
    v = a - a.mean()
    assert v[:-1] @ v[1:] / (v[:-1] @ v[:-1]) > 0.9 and (k.ar1_surrogate(x, 1) == a).all()


def test_rhythm_metrics_tell_sine_from_noise():
    sine = k.rhythm_metrics(np.sin(2 * np.pi * 0.5 * T), FS, 0.2, 1.0, 400, 200, 400, (5, 200))
    noise = k.rhythm_metrics(np.random.default_rng(4).normal(size=2000), FS, 0.2, 1.0, 400, 200, 400, (5, 200))
    assert abs(sine["peak_freq"] - 0.5) < 0.03 and sine["peak_power"] > noise["peak_power"]
    assert sine["inst_cv"] < noise["inst_cv"] and sine["acf_prominence"] > noise["acf_prominence"]


def test_rows_at_once_equal_rows_one_by_one():
    x = np.random.default_rng(5).normal(size=(4, 300))
    sections = k.butter_bandpass(3, 0.3, 0.8, FS)
    for fn in (lambda v: k.welch(v, FS, k.hann(64), 32, 64)[1], lambda v: k.acf(v, 50), k.analytic, lambda v: k.resample(v, FS, 4.0), lambda v: k.filtfilt(sections, v)):
        assert np.allclose(fn(x), np.stack([fn(r).reshape(fn(x).shape[1:]) for r in x]))


def test_pairwise_corr_with_gaps():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(5, 40)) + 100, rng.normal(size=(3, 40))
    x[rng.random(x.shape) < 0.2] = np.nan
    y[rng.random(y.shape) < 0.2] = np.nan
    y[2] = 7.0  # no spread
    x[4, 1:] = np.nan  # one value
    r = k.pairwise_corr(x, y)
    for i in range(5):
        for j in range(3):
            both = np.isfinite(x[i]) & np.isfinite(y[j])
            if i == 4 or j == 2:
                assert np.isnan(r[i, j])
            else:
                assert abs(r[i, j] - np.corrcoef(x[i][both], y[j][both])[0, 1]) < 1e-9


def test_baseline_noise():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(1, 0.5, 4000), rng.normal(5, 1, 300)])
    mu, sigma = k.baseline_noise(x)
    assert abs(mu - 1) < 0.15 and abs(sigma - 0.5) < 0.15
    assert k.baseline_noise(np.ones(5)) == (0.0, 1.0) and k.baseline_noise(np.ones(50)) == (1.0, 1.0)


def test_events_stand_out_of_noise():
    rng = np.random.default_rng(8)
    z = rng.normal(size=(20, 1500))
    t = np.arange(1500)
    for start in (200, 700, 1100):
        z += np.where(t >= start, 9 * np.exp(-np.maximum(t - start, 0) / 30), 0)
    low, high, size = -5, 13, 400
    cell = np.round((z - low) / (high - low) * (size - 1)).astype(int).clip(0, size - 1)
    counts = np.zeros((size, size))
    np.add.at(counts, (cell[:, 1:].ravel(), cell[:, :-1].ravel()), 1)
    odds = k.transition_odds(counts, low, high, 0.0, 0.99)
    zero = int(-low / (high - low) * (size - 1))
    assert not odds[zero, zero] and odds[cell[0, 201], cell[0, 201]]
    raster = k.event_raster(z, k.joint_map(odds, low, high, 10.0, 3.0), low, high)
    assert raster[:, 202:215].mean() > 0.9 and raster[:, :195].mean() < 0.01 and raster[:, 500:690].mean() < 0.01


def test_blob_is_the_leftmost_region_that_meets_the_column():
    flags = np.zeros((8, 8), bool)
    flags[0, 3] = flags[1, 4] = flags[2, 5] = True  # a diagonal
    flags[6, 1:6] = True
    want = np.zeros((8, 8), bool)
    want[6, 1:6] = True
    assert (k.blob_at(flags, 4) == want).all()
    assert not k.blob_at(flags, 7).any()
