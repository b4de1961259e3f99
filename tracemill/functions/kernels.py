"""Small numpy kernels over one trace, or over the rows of a matrix of traces; Spark brings the traces."""

from __future__ import annotations

import math

import numpy as np


def finite(x: np.ndarray) -> np.ndarray:
    """Gaps of each row filled linearly, ends by the nearest value, nothing known as zeros."""
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    if ok.all():
        return x
    if x.ndim > 1:
        out = x.copy()
        for i in np.flatnonzero(~ok.all(axis=1)):
            out[i] = finite(x[i])
        return out
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok]) if ok.any() else np.zeros(len(x))


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window with zero ends."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))


def welch(x: np.ndarray, fs: float, window: np.ndarray, overlap: int, nfft: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectral density of the rows, averaged over whole segments; a short trace is one shortened segment."""
    length = x.shape[-1]
    n = min(len(window), length)
    w = window if n == len(window) else hann(n)
    starts = range(0, length - n + 1, max(1, n - min(overlap, n - 1)))
    power = sum(np.abs(np.fft.rfft(x[..., s : s + n] * w, max(nfft, n), axis=-1)) ** 2 for s in starts) / (len(starts) * fs * (w**2).sum())
    power[..., 1 : -1 if max(nfft, n) % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(max(nfft, n), 1 / fs), power


def acf(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Normalised autocorrelation of the mean-free rows, lags 0 to ``max_lag``."""
    x = x - x.mean(axis=-1, keepdims=True)
    length = x.shape[-1]
    f = np.fft.rfft(x, 2 ** math.ceil(math.log2(2 * length)), axis=-1)
    r = np.fft.irfft(np.abs(f) ** 2, axis=-1)[..., : min(max_lag, length - 1) + 1]
    first = r[..., :1]
    return np.divide(r, first, out=np.zeros(r.shape), where=first > 0)


def xcorr(x: np.ndarray, y: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised cross-correlation of mean-free traces; at lag k, x is k samples behind y."""
    x, y = x - x.mean(), y - y.mean()
    n = 2 ** math.ceil(math.log2(2 * len(x)))
    r = np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(y, n)))
    lags = np.arange(-max_lag, max_lag + 1)
    scale = math.sqrt((x @ x) * (y @ y))
    return lags, r[lags] / scale if scale > 0 else np.zeros(len(lags))


def find_peaks(x: np.ndarray, height: float = -np.inf, prominence: float = 0.0, distance: int = 0, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, prominences): local maxima by height, then prominence, then tallest first at a distance.

    A plateau counts at its first sample; the ends are never peaks. With ``digits`` prominences are compared as rounded to them.
    """
    if len(x) < 3:
        return np.zeros(0, int), np.zeros(0)
    change = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    v = x[change]
    at = change[1:-1][(v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])] if len(v) > 2 else np.zeros(0, int)
    at = at[x[at] >= height]
    proms = np.empty(len(at))
    for k, p in enumerate(at):
        left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
        a, b = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] if len(right) else len(x))
        proms[k] = x[p] - max(x[a : p + 1].min(), x[p:b].min())
    keep = (proms if digits is None else np.floor(proms * 10.0**digits + 0.5) / 10.0**digits) >= prominence
    at, proms = at[keep], proms[keep]
    if distance > 0 and len(at):
        alive = np.ones(len(at), bool)
        for k in np.argsort(-x[at], kind="stable"):
            if alive[k]:
                near = np.abs(at - at[k]) < distance
                near[k] = False
                alive &= ~near
        at, proms = at[alive], proms[alive]
    return at, proms


def butter_bandpass(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass by the bilinear transform."""
    lo, hi = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    width, centre = hi - lo, lo * hi
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre + 0j)
    analog = np.concatenate([poles + root, poles - root])
    digital = (2 * fs + analog) / (2 * fs - analog)
    upper = sorted(digital[digital.imag > 1e-14], key=lambda z: abs(z))
    real = sorted(digital[np.abs(digital.imag) <= 1e-14].real)
    pairs = [(-2 * z.real, abs(z) ** 2) for z in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    sections = np.array([[1.0, 0.0, -1.0, 1.0, a1, a2] for a1, a2 in pairs])
    mid = np.exp(2j * np.pi * math.sqrt(low * high) / fs)
    for s in sections:
        s[:3] /= abs((s[0] + s[1] / mid + s[2] / mid**2) / (s[3] + s[4] / mid + s[5] / mid**2))
    # exact gain of 1 at the centre of the warped band
    w0 = 2 * math.atan(math.sqrt(centre) / (2 * fs))
    z = np.exp(1j * w0)
    gain = np.prod([abs((s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2)) for s in sections])
    sections[0, :3] /= gain
    return sections


def _sos(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cascade along time, in direct form II transposed, started in its steady state for x[0]; rows are traces."""
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sections:
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        first = y[:, 0].copy()
        z1, z2 = first * (dc - b0), first * (b2 - a2 * dc)
        for t in range(y.shape[1]):
            v = y[:, t].copy()
            out = b0 * v + z1
            z1, z2 = b1 * v - a1 * out + z2, b2 * v - a2 * out
            y[:, t] = out
    return y


def filtfilt(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of the rows of x, with odd reflection at the ends."""
    x = np.atleast_2d(x)
    pad = min(x.shape[1] - 1, 3 * (2 * len(sections) + 1))
    ext = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    y = _sos(sections, ext)
    y = _sos(sections, y[:, ::-1])[:, ::-1]
    return y[:, pad : pad + x.shape[1]]


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal of the rows of x."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def resample(x: np.ndarray, rate_in: float, rate_out: float) -> np.ndarray:
    """Windowed-sinc resampling of the rows with anti-aliasing."""
    length = x.shape[-1]
    n = int(round(length * rate_out / rate_in))
    cut = min(1.0, rate_out / rate_in)
    half = int(math.ceil(10 / cut))
    t = np.arange(n) * rate_in / rate_out
    base = np.floor(t).astype(int)
    k = np.arange(-half, half + 1)
    at = base[:, None] + k[None]
    d = t[:, None] - at
    weight = cut * np.sinc(cut * d) * np.where(np.abs(d) <= half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0)
    weight /= weight.sum(axis=1, keepdims=True)
    at = np.clip(at, 0, length - 1)
    return sum(x[..., at[:, i]] * weight[:, i] for i in range(len(k)))


def phase_randomised(x: np.ndarray, seed: int) -> np.ndarray:
    """Random phases under the same amplitudes."""
    f = np.fft.rfft(x - x.mean())
    turn = np.exp(2j * np.pi * np.random.default_rng(seed).random(len(f)))
    turn[0] = 1
    if len(x) % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(f * turn, len(x)) + x.mean()


def ar1_parameters(x: np.ndarray) -> tuple[float, float]:
    """Coefficient, held inside 0.995, and residual sd of a first-order autoregression of the mean-free trace."""
    v = x - x.mean()
    s = v[:-1] @ v[:-1]
    phi = float(np.clip(v[:-1] @ v[1:] / s if s > 0 else 0.0, -0.995, 0.995))
    return phi, float(np.std(v[1:] - phi * v[:-1], ddof=1))


def ar1_surrogate(x: np.ndarray, seed: int) -> np.ndarray:
    """First-order autoregressive noise with the trace's coefficient and residual spread."""
    phi, spread = ar1_parameters(x)
    e = np.random.default_rng(seed).normal(0, spread, len(x))
    out = np.empty(len(x))
    out[0] = e[0]
    for t in range(1, len(x)):
        out[t] = phi * out[t - 1] + e[t]
    return out + x.mean()


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / max(t @ t, 1e-300)


def _cv(v: np.ndarray, least: int) -> float:
    v = v[np.isfinite(v)]
    return float(v.std(ddof=1) / v.mean()) if len(v) >= least and v.mean() > 0 else math.nan


def rhythm_metrics(x: np.ndarray, fs: float, low: float, high: float, window: int, step: int, welch_frames: int, lags: tuple[int, int]) -> dict[str, float]:
    """Peak power, its frequency and Q in a band; largest prominence and number of autocorrelation peaks
    between two lags; spread of the frequency over windows and from sample to sample."""
    x = finite(x)

    def spectrum(seg):
        n = min(max(16, welch_frames), len(seg))
        f, p = welch(seg, fs, hann(n), round(n / 2), max(256, 2 ** math.ceil(math.log2(n))))
        band = (f >= low) & (f <= high)
        return f[band], p[band]

    f, p = spectrum(x)
    power = freq = q = math.nan
    if len(p):
        i = int(np.argmax(p))
        wide = f[p >= p[i] / 2]
        power, freq, q = p[i], f[i], f[i] / (wide[-1] - wide[0]) if wide[-1] > wide[0] else math.nan
    at, prom = find_peaks(acf(x, lags[1])[lags[0] :])
    per = []
    for s in range(0, max(1, len(x) - window + 1), step):
        f, p = spectrum(x[s : s + window])
        per.append(f[np.argmax(p)] if len(p) else math.nan)
    z = analytic(filtfilt(butter_bandpass(3, low, high, fs), x)[0])
    inst = np.diff(np.unwrap(np.angle(z))) * fs / (2 * np.pi)
    inst = inst[(inst >= low / 4) & (inst <= high * 4)]
    return {
        "peak_power": float(power), "peak_freq": float(freq), "q": float(q), "acf_prominence": float(prom.max()) if len(prom) else 0.0,
        "acf_peaks": float(len(at)), "window_cv": _cv(np.array(per), 2), "inst_cv": _cv(inst, 5),
    }


def mad_scores(x: np.ndarray) -> np.ndarray:
    """(x - median) / MAD, with the sd, or 1, where the MAD is 0."""
    gap = x - np.median(x)
    mad, sd = float(np.median(np.abs(gap))), float(x.std(ddof=1)) if len(x) > 1 else 0.0
    return gap / (mad if mad > 0 else sd if sd > 0 else 1.0)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Values rounded to so many digits, halves away from zero, as SQL does."""
    scaled = values * 10.0**digits
    whole = np.trunc(scaled)
    return (whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)) / 10.0**digits


def hazen(values: np.ndarray, share: float) -> float:
    """Percentile at plotting position (i - 0.5) / n, linear between neighbours."""
    v = np.sort(values)
    return float(np.interp(share * len(v) + 0.5, np.arange(1, len(v) + 1), v))


def pairwise_corr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlations of the rows of x with those of y over the places where both have values; NaN without two of them or without spread."""
    mx, my = np.isfinite(x), np.isfinite(y)
    # around each row's own mean, so that sums of squares do not cancel
    centre = lambda a, m: np.where(m, a - (np.where(m, a, 0).sum(axis=1) / np.maximum(m.sum(axis=1), 1))[:, None], 0.0)
    a, b = centre(x, mx), centre(y, my)
    with np.errstate(invalid="ignore", divide="ignore"):
        if mx.all() and my.all():
            cov, va, vb, n = a @ b.T, (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None], np.full((len(a), len(b)), x.shape[1])
        else:
            fx, fy = mx.astype(float), my.astype(float)
            n, sa, sb = fx @ fy.T, a @ fy.T, fx @ b.T
            cov, va, vb = a @ b.T - sa * sb / n, (a * a) @ fy.T - sa * sa / n, fx @ (b * b).T - sb * sb / n
        floor = 1e-12 * np.maximum((a * a).sum(axis=1)[:, None], 1e-300), 1e-12 * np.maximum((b * b).sum(axis=1)[None], 1e-300)
        r = np.where((n >= 2) & (va > floor[0]) & (vb > floor[1]), cov / np.sqrt(va * vb), np.nan)
    return np.clip(r, -1, 1)


def baseline_noise(x: np.ndarray) -> tuple[float, float]:
    """(mu, sigma) of the noise below a trace's events.

    A parabola fitted to the log density left of its peak, where it exceeds a fifth of the peak; the mean and sd
    within two sd of zero where that gives no width; (0, 1) for fewer than ten values.
    """
    x = x[np.isfinite(x)]
    if len(x) < 10:
        return 0.0, 1.0
    spread = float(np.median(np.abs(x - np.median(x)))) / 0.6745 or float(x.max() - x.min())
    mu = sigma = math.nan
    if spread > 0:
        bw = spread * (4 / (3 * len(x))) ** 0.2
        at = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 100)
        density = np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
        left = slice(0, int(np.argmax(density)) + 1)
        keep = density[left] > 0.2 * density[left].max()
        if keep.sum() >= 3:
            a2, a1, _ = np.polyfit(at[left][keep], np.log(density[left][keep]), 2)
            if a2 < 0:
                sigma = math.sqrt(-1 / (2 * a2))
                mu = a1 * sigma**2
    if not (math.isfinite(sigma) and sigma > 0):
        inside = x[np.abs(x) <= 2 * x.std(ddof=1)]
        sigma, mu = (float(inside.std(ddof=1)), float(inside.mean())) if len(inside) > 1 else (math.nan, math.nan)
    if not (math.isfinite(sigma) and sigma > 0):
        sigma = float(x.std(ddof=1))
    if not (math.isfinite(sigma) and sigma > 0):
        sigma = 1.0
    return float(mu) if math.isfinite(mu) else float(x.mean()), sigma


def whittaker(y: np.ndarray, strength: float) -> np.ndarray:
    """Columns smoothed by penalised first and second differences."""
    n = len(y)
    d1 = np.diff(np.eye(n), axis=0)
    d2 = np.diff(d1, axis=0)
    return np.linalg.solve(np.eye(n) + strength**2 * d2.T @ d2 + 2 * strength * d1.T @ d1, y)


def neighbour_distance(counts: np.ndarray, nearest: int) -> np.ndarray:
    """Mean distance, in cells, from each cell to its nearest points, from the counts in growing squares around it.

    A square of half width h stands for the disc of equal area.
    """
    size = len(counts)
    table = np.zeros((size + 1, size + 1))
    table[1:, 1:] = counts.cumsum(axis=0).cumsum(axis=1)
    place = np.arange(size)
    total = np.zeros(counts.shape)
    held = np.zeros(counts.shape)
    wanted = min(nearest, counts.sum())
    half = 0.0
    while True:
        low, high = np.maximum(place - int(half), 0), np.minimum(place + int(half) + 1, size)
        inside = np.minimum(table[high][:, high] - table[low][:, high] - table[high][:, low] + table[low][:, low], wanted)
        total += (inside - held) * (0.5 if half < 1 else (2 * half + 1) / math.sqrt(math.pi) * 0.9)
        held = inside
        if half >= size or (held >= wanted).all():
            return total / max(wanted, 1)
        half = max(half + 1, int(half * 1.5))


def transition_odds(counts: np.ndarray, low: float, high: float, covariance: float, confidence: float, nearest: int = 100, strength: float = 8.0) -> np.ndarray:
    """Cells [next, current] where noise explains at most 1 - confidence of the transitions.

    ``counts`` [next, current] on an even grid from low to high. Each count is spread by a Gaussian whose
    width grows with the distance to its nearest points; noise is the bivariate normal density of unit
    variances and the given covariance. Both are smoothed along each axis and scaled to sum 1.
    """
    size = len(counts)
    spread = neighbour_distance(counts, nearest)
    sigma = spread / (8 * max(spread.min(), 1e-9))
    step = np.full(counts.shape, -1)
    rows, columns = np.nonzero(counts)
    step[rows, columns] = np.round(np.log(np.maximum(sigma[rows, columns], 0.125) / 0.125) / math.log(1.5)).astype(int)
    data = np.zeros(counts.shape)
    for level in np.unique(step[rows, columns]):
        width = 0.125 * 1.5**level
        half = min(math.ceil(8 * width) // 2, size - 1)
        part = np.where(step == level, counts, 0.0)
        if half:
            kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / width) ** 2)
            n = 2 ** math.ceil(math.log2(size + 2 * half))
            f = np.fft.rfft(kernel / kernel.sum(), n)
            for axis in (0, 1):
                shape = [1, 1]
                shape[axis] = len(f)
                part = np.take(np.fft.irfft(np.fft.rfft(part, n, axis=axis) * f.reshape(shape), n, axis=axis), range(half, half + size), axis=axis)
        data += part
    at = np.linspace(low, high, size)
    c = min(max(covariance, -0.999), 0.999)
    noise = np.exp(-(at[:, None] ** 2 - 2 * c * at[:, None] * at[None] + at[None] ** 2) / (2 * (1 - c * c)))
    data, noise = (whittaker(whittaker(m, strength).T, strength).T for m in (np.maximum(data, 0), noise))
    return noise / noise.sum() <= (1 - confidence) * data / max(data.sum(), 1e-300)


def blob_at(flags: np.ndarray, column: int) -> np.ndarray:
    """The connected region (with diagonals) of set cells that meets a column; of several the one that begins leftmost, then highest."""
    best, done = np.zeros(flags.shape, bool), np.zeros(flags.shape, bool)
    first = None
    for row in np.flatnonzero(flags[:, column]):
        if done[row, column]:
            continue
        region = np.zeros(flags.shape, bool)
        region[row, column] = True
        r0, r1, c0, c1 = row, row + 1, column, column + 1
        while True:
            r0, r1, c0, c1 = max(r0 - 1, 0), min(r1 + 1, len(flags)), max(c0 - 1, 0), min(c1 + 1, flags.shape[1])
            own = region[r0:r1, c0:c1]
            wide = np.pad(own, 1)
            tall = wide[:-2] | wide[1:-1] | wide[2:]
            new = (tall[:, :-2] | tall[:, 1:-1] | tall[:, 2:]) & flags[r0:r1, c0:c1]
            if (new == own).all():
                break
            region[r0:r1, c0:c1] = new
        done |= region
        rows, columns = np.nonzero(region)
        begin = (columns.min(), rows[columns == columns.min()].min())
        if first is None or begin < first:
            best, first = region, begin
    return best


def joint_map(odds: np.ndarray, low: float, high: float, fps: float, decay: float, bias: float = 1.5) -> np.ndarray:
    """Cells [next, current] of transitions that belong to events: outside the noise region around zero, not
    beyond the grid, and not falling faster than the indicator's decay allows."""
    size = len(odds)
    at = np.linspace(low, high, size)
    zero = int(np.argmax(at > 0))
    joint = ~blob_at(~odds, zero)
    joint[-1] = False
    factor = math.exp(-1 / (fps * decay))
    return joint & ~(at[:, None] < factor * (at[None] - bias) - bias)


def event_raster(z: np.ndarray, joint: np.ndarray, low: float, high: float) -> np.ndarray:
    """Frames of the rows of z with two transitions in a row inside the map, around or at the frame."""
    size, length = len(joint), z.shape[1]
    cell = np.clip(np.floor((z - low) / (high - low) * (size - 1) + 1e-9).astype(int), 0, size - 1)
    step = joint[cell[:, 1:], cell[:, :-1]]  # from frame t to t + 1
    out = np.zeros(z.shape, bool)
    if length >= 5:
        t = np.arange(2, length - 2)
        out[:, t] = (step[:, t] & step[:, t - 1]) | (step[:, t - 1] & step[:, t - 2]) | (step[:, t + 1] & step[:, t])
    return out
