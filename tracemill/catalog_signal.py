"""Registered queries of spectra, rates, latent modes and surrogates; DuckDB SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog_core import HAZEN, PEAKS, UNITW, _r, rounded, with_
from .functions import kernels
from .operators import clean as P
from .operators import latent as L
from .operators import pairs as N
from .operators import signal as R
from .operators import stats as S
from .operators import windows as W
from .plans import low_high
from .plans import oscillators as O
from .sources import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict = {}
T, A = fx.traces, fx.trace_arrays


def add(name: str, fn, fixtures: str = "", sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = with_(fixtures, sql.strip()) if fixtures else sql.strip()


def spectra(s, d):
    """Hann windows of 32 frames, half overlapping."""
    return R.welch_spectra(A(s, d), fx.FPS, 32, 16, 32)


SPEC = """w AS (SELECT CAST(i AS INTEGER) AS i, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS w FROM range(32) q(i)),
  ft AS (SELECT recording_id, unit_id, sg, k, sum(value * w.w * cos(2 * pi() * k * w.i / 32)) AS re, sum(value * w.w * sin(2 * pi() * k * w.i / 32)) AS im
         FROM traces t, range(3) a(sg), w, range(17) b(k) WHERE t.frame = sg * 16 + w.i GROUP BY ALL),
  sp AS (SELECT recording_id, unit_id, k * 2.0 / 32 AS f, avg(re * re + im * im) / (2 * (SELECT sum(w * w) FROM w)) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS pxx FROM ft GROUP BY recording_id, unit_id, k)"""
add("r3_resample", lambda s, d: rounded(fx.explode_traces(R.resample_rate(A(s, d), 2.0, 1.0)), 5))
add("r3_resample_half", lambda s, d: rounded(fx.explode_traces(R.resample_rate(A(s, d), 2.0, 1.0)), 5), "traces",
    """WITH k AS (SELECT CAST(i AS INTEGER) AS k, CASE WHEN i = 0 THEN 1 ELSE sin(pi() * i / 2) / (pi() * i / 2) END * (0.5 + 0.5 * cos(pi() * i / 20)) AS w FROM range(-20, 21) q(i)), g AS (SELECT CAST(n AS INTEGER) AS frame, CAST(least(greatest(2 * n + k, 0), 63) AS INTEGER) AS f, w / (SELECT sum(w) FROM k) AS w FROM k, range(32) q(n))
       SELECT recording_id, unit_id, g.frame, round(sum(value * w), 5) + 0.0 AS value FROM traces t JOIN g ON g.f = t.frame GROUP BY 1, 2, 3""")
add("r4_acf", lambda s, d: rounded(R.long_acf(A(s, d), 8)), "traces",
    f"""WITH c AS (SELECT recording_id, unit_id, frame, value - avg(value) OVER (PARTITION BY recording_id, unit_id) AS v FROM traces)
        SELECT a.recording_id, a.unit_id, CAST(k AS INTEGER) AS lag, {_r('sum(a.v * b.v) / any_value(n.s)', 'r')} FROM c a JOIN range(9) q(k) ON true JOIN c b ON b.recording_id = a.recording_id AND b.unit_id = a.unit_id AND b.frame = a.frame + k
        JOIN (SELECT recording_id, unit_id, sum(v * v) AS s FROM c GROUP BY 1, 2) n ON n.recording_id = a.recording_id AND n.unit_id = a.unit_id GROUP BY 1, 2, 3""")
ACF = """SELECT a.recording_id, a.unit_id, CAST(k AS INTEGER) AS frame, sum(a.v * b.v) / any_value(n.s) AS v FROM (SELECT recording_id, unit_id, frame, value - avg(value) OVER (PARTITION BY recording_id, unit_id) AS v FROM traces) a
    JOIN range({first}, {last} + 1) q(k) ON true JOIN (SELECT recording_id, unit_id, frame, value - avg(value) OVER (PARTITION BY recording_id, unit_id) AS v FROM traces) b ON b.recording_id = a.recording_id AND b.unit_id = a.unit_id AND b.frame = a.frame + k
    JOIN (SELECT recording_id, unit_id, var_pop(value) * count(*) AS s FROM traces GROUP BY 1, 2) n ON n.recording_id = a.recording_id AND n.unit_id = a.unit_id GROUP BY 1, 2, 3"""


def acf_peaks_sql(first: int, prominence: float, select: str) -> str:
    """Peaks of the autocorrelation from a lag up to 30, and something of them."""
    peaks = PEAKS.format(src=ACF.format(first=first, last=30), height=-9, prominence=prominence, distance=0)
    return f"WITH RECURSIVE f AS ({peaks}) {select}"


add("r5_acf_peak_filter", lambda s, d: R.acf_peak_filter(A(s, d), fx.FPS, 1, 15, 0.08, 2).select("recording_id", "unit_id"), "traces",
    acf_peaks_sql(2, 0.08, "SELECT recording_id, unit_id FROM f GROUP BY 1, 2 HAVING count(*) >= 2"))
add("r6_acf_first_peak", lambda s, d: rounded(R.acf_peaks(A(s, d), fx.FPS, 0.5, 15, 0.05).select("recording_id", "unit_id", "n_peaks", "first_lag", "first_freq")), "traces",
    acf_peaks_sql(1, 0.05, f"SELECT u.recording_id, u.unit_id, count(f.frame) AS n_peaks, {_r('min(f.frame) / 2.0', 'first_lag')}, {_r('2.0 / min(f.frame)', 'first_freq')} FROM (SELECT DISTINCT recording_id, unit_id FROM traces) u LEFT JOIN f ON f.recording_id = u.recording_id AND f.unit_id = u.unit_id GROUP BY 1, 2"))
add("r7_welch", lambda s, d: rounded(spectra(s, d)), "traces", f"WITH {SPEC} SELECT recording_id, unit_id, f, {_r('pxx', 'pxx')} FROM sp")
add("r8_dominant_freq", lambda s, d: rounded(R.dominant_freq(spectra(s, d), 0.1, 0.9)), "traces",
    f"WITH {SPEC} SELECT recording_id, unit_id, {_r('f', 'dom')}, {_r('pxx', 'power')} FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_id ORDER BY pxx DESC, f) AS k FROM sp WHERE f BETWEEN 0.1 AND 0.9) WHERE k = 1")
add("r9_band_power", lambda s, d: rounded(R.band_power(spectra(s, d), 0.1, 0.5)), "traces", f"WITH {SPEC} SELECT recording_id, unit_id, {_r('sum(pxx)', 'power')} FROM sp WHERE f BETWEEN 0.1 AND 0.5 GROUP BY 1, 2")
add("r10_normalise_spectrum", lambda s, d: rounded(R.normalise_spectrum(spectra(s, d), "area", 0.1, 0.5)), "traces",
    f"""WITH {SPEC}, ar AS (SELECT recording_id, unit_id, sum((f - pf) * (pxx + pp) / 2) AS a FROM (SELECT *, lag(f) OVER w AS pf, lag(pxx) OVER w AS pp FROM sp WHERE f BETWEEN 0.1 AND 0.5 WINDOW w AS (PARTITION BY recording_id, unit_id ORDER BY f)) GROUP BY 1, 2)
        SELECT recording_id, unit_id, f, {_r('pxx / greatest(a, 1e-12)', 'pxx')} FROM sp JOIN ar USING (recording_id, unit_id)""")
add("r11_freq_to_hz", lambda s, d: rounded(R.freq_to_hz(spectra(s, d).withColumn("f", F.col("f") / 2), fx.FPS)), "traces", f"WITH {SPEC} SELECT recording_id, unit_id, f, {_r('pxx', 'pxx')} FROM sp")
add("r12_q_factor", lambda s, d: rounded(R.q_factor(spectra(s, d), 0.1, 0.9)), "traces",
    f"""WITH {SPEC}, dm AS (SELECT recording_id, unit_id, f AS dom, pxx / 2 AS h FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_id ORDER BY pxx DESC, f) AS k FROM sp WHERE f BETWEEN 0.1 AND 0.9) WHERE k = 1),
        c AS (SELECT sp.recording_id, sp.unit_id, dom, h, f, pxx, lead(f) OVER w AS f1, lead(pxx) OVER w AS p1 FROM sp JOIN dm ON dm.recording_id = sp.recording_id AND dm.unit_id = sp.unit_id WINDOW w AS (PARTITION BY sp.recording_id, sp.unit_id ORDER BY f)),
        g AS (SELECT recording_id, unit_id, dom, max(CASE WHEN f1 <= dom AND pxx <= h AND p1 > h THEN f + (h - pxx) * (f1 - f) / (p1 - pxx) END) AS l, min(CASE WHEN f >= dom AND pxx > h AND p1 <= h THEN f + (h - pxx) * (f1 - f) / (p1 - pxx) END) AS r FROM c GROUP BY 1, 2, 3)
        SELECT recording_id, unit_id, {_r('dom', 'dom')}, {_r('r - l', 'fwhm')}, {_r('CASE WHEN r - l > 0 THEN dom / (r - l) END', 'q')} FROM g""")
add("r13_q_simple", lambda s, d: rounded(R.q_factor_simple(spectra(s, d), 0.1, 0.9)), "traces",
    f"""WITH {SPEC}, b AS (SELECT *, max(pxx) OVER (PARTITION BY recording_id, unit_id) AS m FROM sp WHERE f BETWEEN 0.1 AND 0.9), g AS (SELECT recording_id, unit_id, min(f) FILTER (pxx = m) AS dom, max(f) FILTER (pxx >= m / 2) - min(f) FILTER (pxx >= m / 2) AS w FROM b GROUP BY 1, 2)
        SELECT recording_id, unit_id, {_r('CASE WHEN w > 0 THEN dom / w END', 'q')} FROM g""")
add("r14_occupied_bandwidth", lambda s, d: rounded(R.occupied_bandwidth(spectra(s, d), 0.1, 0.9, 0.9)), "traces",
    f"""WITH {SPEC}, c AS (SELECT *, sum(pxx) OVER (PARTITION BY recording_id, unit_id ORDER BY f) / sum(pxx) OVER (PARTITION BY recording_id, unit_id) AS c FROM sp WHERE f BETWEEN 0.1 AND 0.9)
        SELECT recording_id, unit_id, {_r('min(f) FILTER (c >= 1 - (1 - 0.9) / 2) - min(f) FILTER (c >= (1 - 0.9) / 2)', 'obw')} FROM c GROUP BY 1, 2""")
add("r15_windowed_peak_freq", lambda s, d: rounded(R.windowed_peak_freq(A(s, d), fx.FPS, 32, 16, 0.1, 0.9)), "traces",
    f"""WITH w AS (SELECT CAST(i AS INTEGER) AS i, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS w FROM range(32) q(i)),
        ft AS (SELECT recording_id, unit_id, st, k, sum(value * w.w * cos(2 * pi() * k * w.i / 32)) AS re, sum(value * w.w * sin(2 * pi() * k * w.i / 32)) AS im FROM traces t, (SELECT unnest([0, 16, 32]) AS st) a, w, range(2, 15) b(k) WHERE t.frame = st + w.i GROUP BY ALL)
        SELECT recording_id, unit_id, st AS start, {_r('k * 2.0 / 32', 'freq')} FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_id, st ORDER BY re * re + im * im DESC, k) AS o FROM ft) WHERE o = 1""")
add("r16_bout_peak_freq", lambda s, d: rounded(R.bout_peak_freq(T(s, d), W.drop_short_runs(T(s, d).withColumn("active", F.col("value") > 0), "active", 4), fx.FPS, 0.0, 1.0).drop("error")), "traces",
    f"""WITH f AS (SELECT recording_id, unit_id, frame, value, value > 0 AS act, lag(value > 0) OVER {UNITW}) AS was FROM traces), g AS (SELECT *, sum(CAST(act AND NOT coalesce(was, false) AS INTEGER)) OVER {UNITW}) AS run FROM f),
        b AS (SELECT recording_id, unit_id, run, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY recording_id, unit_id, run) AS n, value - avg(value) OVER (PARTITION BY recording_id, unit_id, run) AS v FROM g WHERE act WINDOW w AS (PARTITION BY recording_id, unit_id, run ORDER BY frame)),
        c AS (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x, CAST(pow(2, ceil(log2(greatest(n, 8)))) AS BIGINT) AS m FROM b WHERE n >= 4),
        ft AS (SELECT recording_id, unit_id, run, m, k, any_value(n) AS n, sum(x * cos(2 * pi() * k * i / m)) AS re, sum(x * sin(2 * pi() * k * i / m)) AS im FROM c, range(33) q(k) WHERE k <= m / 2 GROUP BY 1, 2, 3, 4, 5)
        SELECT recording_id, unit_id, CAST(run AS BIGINT) AS run, {_r('k * 2.0 / m', 'freq')} FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_id, run ORDER BY round((re * re + im * im) * CASE WHEN k IN (0, m / 2) THEN 1 ELSE 2 END, 12) DESC, k) AS o FROM ft) WHERE o = 1""")
add("r17_bandpass", lambda s, d: rounded(fx.explode_traces(R.bandpass(A(s, d), fx.FPS, 0.1, 0.4)), 5))
add("r18_analytic", lambda s, d: rounded(R.analytic_signal(R.bandpass(A(s, d), fx.FPS, 0.1, 0.4)).select("recording_id", "unit_id", F.explode(F.arrays_zip("phase", "amp")).alias("z")).select("recording_id", "unit_id", F.cos("z.phase").alias("c"), F.col("z.amp").alias("amp")), 5))
add("r18_analytic_of_traces", lambda s, d: rounded(R.long_phases(R.analytic_signal(A(s, d))).select("recording_id", "unit_id", "frame", (F.cos("phase") * F.col("amp")).alias("re"), (F.sin("phase") * F.col("amp")).alias("im")), 5), "traces",
    """WITH f AS (SELECT recording_id, unit_id, k, sum(value * cos(2 * pi() * k * frame / 64)) AS c, sum(value * sin(2 * pi() * k * frame / 64)) AS s FROM traces, range(1, 32) q(k) GROUP BY 1, 2, 3)
       SELECT t.recording_id, t.unit_id, t.frame, round(any_value(value), 5) + 0.0 AS re, round(sum(c * sin(2 * pi() * k * frame / 64) - s * cos(2 * pi() * k * frame / 64)) / 32, 5) + 0.0 AS im FROM traces t JOIN f ON f.recording_id = t.recording_id AND f.unit_id = t.unit_id GROUP BY 1, 2, 3""")
SIDES = """so AS (SELECT recording_id, unit_id, x, row_number() OVER w AS i, sum(x) OVER w AS s, sum(x) OVER (PARTITION BY recording_id) AS t, count(*) OVER (PARTITION BY recording_id) AS m FROM positions WINDOW w AS (PARTITION BY recording_id ORDER BY x, unit_id ROWS UNBOUNDED PRECEDING)),
  cu AS (SELECT recording_id, i AS c FROM (SELECT recording_id, i, row_number() OVER (PARTITION BY recording_id ORDER BY round(s * s / i + (t - s) ** 2 / (m - i), 9) DESC, i) AS k FROM so WHERE i < m) WHERE k = 1),
  sd AS (SELECT so.recording_id, unit_id, CAST(i > c AS INTEGER) AS side FROM so JOIN cu ON cu.recording_id = so.recording_id)"""


def sides(s, d):
    return R.hemisphere_split(fx.positions(s, d), "x").select("recording_id", "unit_id", "side")


add("r20_hemisphere_split", sides, "positions", f"WITH {SIDES} SELECT * FROM sd")
add("r19_side_xcorr", lambda s, d: rounded(R.side_xcorr(T(s, d), sides(s, d), 20, 5).select("recording_id", "zero", "peak", "peak_lag", "auc")), "traces positions",
    f"""WITH {SIDES}, m AS (SELECT t.recording_id, frame, avg(value) FILTER (side = 0) AS a, avg(value) FILTER (side = 1) AS b FROM traces t JOIN sd ON sd.recording_id = t.recording_id AND sd.unit_id = t.unit_id GROUP BY 1, 2),
        z AS (SELECT recording_id, frame, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM m WINDOW w AS (PARTITION BY recording_id)), n AS (SELECT recording_id, sqrt(sum(a * a) * sum(b * b)) AS s FROM z GROUP BY 1),
        x AS (SELECT p.recording_id, k AS lag, sum(p.a * q.b) / any_value(n.s) AS r FROM z p JOIN range(-20, 21) g(k) ON true JOIN z q ON q.recording_id = p.recording_id AND q.frame = p.frame - k JOIN n ON n.recording_id = p.recording_id GROUP BY 1, 2),
        y AS (SELECT *, lag(r) OVER (PARTITION BY recording_id ORDER BY lag) AS pr FROM x)
        SELECT recording_id, {_r('max(r) FILTER (lag = 0)', 'zero')}, {_r('max(r)', 'peak')}, CAST(arg_max(lag, round(r, 12)) AS INTEGER) AS peak_lag, {_r('sum((r + pr) / 2) FILTER (lag BETWEEN -4 AND 5)', 'auc')} FROM y GROUP BY 1""")
add("r19_zero_lag", lambda s, d: rounded(R.side_xcorr(T(s, d), sides(s, d), 20, 5).select("recording_id", "zero")), "traces positions",
    f"""WITH {SIDES}, m AS (SELECT t.recording_id, frame, avg(value) FILTER (side = 0) AS a, avg(value) FILTER (side = 1) AS b FROM traces t JOIN sd ON sd.recording_id = t.recording_id AND sd.unit_id = t.unit_id GROUP BY 1, 2) SELECT recording_id, {_r('corr(a, b)', 'zero')} FROM m GROUP BY 1""")
add("r21_beat_rate", lambda s, d: rounded(R.beat_rate(A(s, d), fx.FPS, 3, digits=6).select("recording_id", "unit_id", "beats", "rate")), "traces",
    "WITH RECURSIVE sm AS (SELECT recording_id, unit_id, frame, avg(value) OVER " + UNITW + " ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM traces), fl AS (SELECT recording_id, unit_id, mad(v) * 0.5 AS least FROM sm GROUP BY 1, 2), f AS ("
    + PEAKS.format(src="SELECT * FROM sm", height=-9, prominence=0, distance=1)
    + f""") SELECT fl.recording_id, fl.unit_id, count(f.frame) AS beats, {_r('CASE WHEN count(f.frame) > 1 THEN 2.0 * (count(f.frame) - 1) / (max(f.frame) - min(f.frame)) END', 'rate')}
        FROM fl LEFT JOIN f ON f.recording_id = fl.recording_id AND f.unit_id = fl.unit_id AND f.prominence >= fl.least GROUP BY 1, 2""")
add("r22_speed", lambda s, d: rounded(R.speed(T(s, d), 3, fx.FPS).select("recording_id", "unit_id", "frame", "speed")), "traces",
    f"""WITH m AS (SELECT recording_id, unit_id, frame, avg(value) OVER {UNITW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM traces)
        SELECT recording_id, unit_id, frame, {_r(f'abs(coalesce((lead(v) OVER {UNITW}) - lag(v) OVER {UNITW})) / 2, lead(v) OVER {UNITW}) - v, v - lag(v) OVER {UNITW}))) * 2', 'speed')} FROM m""")
add("r23_vigor", lambda s, d: rounded(T(s, d).withColumn("value", R.vigor(F.col("value"), (0.01, 1.0, 2.0)))), "traces", f"SELECT recording_id, unit_id, frame, {_r('greatest(0.01 + value + 2 * value * value, 0)', 'value')} FROM traces")
add("r22_activity", lambda s, d: rounded(R.activity(T(s, d), 3).select("recording_id", "unit_id", "frame", "activity")), "traces", f"SELECT recording_id, unit_id, frame, {_r(f'avg(abs(value)) OVER {UNITW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 'activity')} FROM traces")
add("r23_predicted_distance", lambda s, d: rounded(R.predicted_distance(R.speed(T(s, d), 3, fx.FPS), (0.01, 1.0, -2.0), fx.FPS, 3)), "traces",
    f"""WITH m AS (SELECT recording_id, unit_id, frame, avg(value) OVER {UNITW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM traces),
        g AS (SELECT recording_id, unit_id, frame, abs(coalesce((lead(v) OVER {UNITW}) - lag(v) OVER {UNITW})) / 2, lead(v) OVER {UNITW}) - v, v - lag(v) OVER {UNITW}))) * 2 AS sp FROM m),
        y AS (SELECT recording_id, unit_id, frame, greatest(0.01 + q - 2 * q * q, 0) AS y FROM (SELECT *, avg(sp) OVER {UNITW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS q FROM g))
        SELECT recording_id, unit_id, {_r('sum(p)', 'distance')} FROM (SELECT recording_id, unit_id, (y + lag(y) OVER {UNITW})) / 4 AS p FROM y) GROUP BY 1, 2""")


def _two_angles(s, d):
    """Each sample as one tail angle and the next sample as another, with the speed between them."""
    nxt = F.coalesce(F.lead("value").over(Window.partitionBy("recording_id", "unit_id").orderBy("frame")), F.lit(0.0))
    return T(s, d).withColumn("other", nxt).withColumn("speed", F.abs(F.col("other") - F.col("value")))


add("r24_tail_signal", lambda s, d: rounded(_two_angles(s, d).select("recording_id", "unit_id", "frame", R.tail_signal(F.col("value"), F.col("other"), F.col("speed")).alias("v"), R.tail_signal(F.col("value"), F.col("other"), F.col("speed"), half_wave=True).alias("half"))), "traces",
    f"""WITH o AS (SELECT *, coalesce(lead(value) OVER {UNITW}), 0) AS o FROM traces), v AS (SELECT *, CASE WHEN abs(o - value) > 0.1 THEN value + o ELSE 0 END AS v FROM o)
        SELECT recording_id, unit_id, frame, {_r('abs(v)', 'v')}, {_r('greatest(v, 0)', 'half')} FROM v""")
add("r27_threshold_onsets", lambda s, d: R.threshold_onsets(T(s, d), 1.5, 2), "traces",
    f"""WITH th AS (SELECT recording_id, unit_id, median(value) + 1.5 * mad(value) AS th FROM traces GROUP BY 1, 2), f AS (SELECT recording_id, unit_id, frame, value > th AS act FROM traces JOIN th USING (recording_id, unit_id)),
        g AS (SELECT *, sum(CAST(act AND NOT coalesce(was, false) AS INTEGER)) OVER {UNITW}) AS run FROM (SELECT *, lag(act) OVER {UNITW}) AS was FROM f))
        SELECT recording_id, unit_id, min(frame) AS start FROM g WHERE act GROUP BY recording_id, unit_id, run HAVING count(*) >= 2""")
add("r28_rasterise", lambda s, d: rounded(R.rasterise(fx.event_train(s, d).select("recording_id", (F.col("frame") / 2.0).alias("t"), "amp"), fx.event_train(s, d).select("recording_id").distinct().withColumn("n_frames", F.lit(720)), 2.0)), "ev",
    f"SELECT r.recording_id, CAST(k AS INTEGER) AS frame, {_r('coalesce(max(amp), 0)', 'amp')} FROM (SELECT DISTINCT recording_id FROM ev) r CROSS JOIN range(720) q(k) LEFT JOIN ev e ON e.recording_id = r.recording_id AND e.frame = k GROUP BY r.recording_id, k")


def welch_sql(src: str, key: str, n: int, segments: int, name: str, window: str = "0.5 - 0.5") -> str:
    """Spectra f, pxx of rows (key, frame, value): n-frame windows, half overlapping."""
    return f"""{name}w AS (SELECT CAST(i AS INTEGER) AS i, {window} * cos(2 * pi() * i / {n - 1}) AS w FROM range({n}) q(i)),
      {name}f AS (SELECT {key}, sg, k, sum(value * w * cos(2 * pi() * k * i / {n})) AS re, sum(value * w * sin(2 * pi() * k * i / {n})) AS im FROM {src} t, range({segments}) a(sg), {name}w, range({n // 2 + 1}) b(k) WHERE t.frame = sg * {n // 2} + i GROUP BY ALL),
      {name} AS (SELECT {key}, k * 2.0 / {n} AS f, avg(re * re + im * im) / (2 * (SELECT sum(w * w) FROM {name}w)) * CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END AS pxx FROM {name}f GROUP BY {key}, k)"""


UK = "recording_id, unit_id"
add("r29_two_pass", lambda s, d: rounded(R.two_pass_refine(A(s, d), P.unit_qc_finite(T(s, d), 64), fx.FPS, 16, 0.1, 0.5)), "traces",
    f"""WITH {welch_sql('traces', UK, 16, 7, 's1')}, {welch_sql('traces', UK, 32, 3, 's2')},
        d1 AS (SELECT {UK} FROM (SELECT *, row_number() OVER (PARTITION BY {UK} ORDER BY pxx DESC, f) AS o FROM s1) WHERE o = 1 AND f BETWEEN 0.1 AND 0.5), ok AS (SELECT {UK} FROM traces GROUP BY 1, 2 HAVING count(value) >= 0.95 * 64 AND stddev_samp(value) > 0)
        SELECT {UK}, {_r('f', 'dom')}, {_r('pxx', 'power')} FROM (SELECT s2.*, row_number() OVER (PARTITION BY {UK} ORDER BY pxx DESC, f) AS o FROM s2 JOIN d1 USING ({UK}) JOIN ok USING ({UK}) WHERE f BETWEEN 0.1 AND 0.5) WHERE o = 1""")

add("r29_in_band_counts", lambda s, d: R.in_band_counts(A(s, d), R.in_band_units(A(s, d), P.unit_qc_finite(T(s, d), 64), fx.FPS, 16, 0.1, 0.5)), "traces",
    f"""WITH {welch_sql('traces', UK, 16, 7, 's1')}, d1 AS (SELECT {UK} FROM (SELECT *, row_number() OVER (PARTITION BY {UK} ORDER BY pxx DESC, f) AS o FROM s1) WHERE o = 1 AND f BETWEEN 0.1 AND 0.5), ok AS (SELECT {UK} FROM traces GROUP BY 1, 2 HAVING count(value) >= 0.95 * 64 AND stddev_samp(value) > 0)
        SELECT u.recording_id, count(*) AS units, count(d1.unit_id) FILTER (ok.unit_id IS NOT NULL) AS in_band FROM (SELECT DISTINCT {UK} FROM traces) u LEFT JOIN d1 USING ({UK}) LEFT JOIN ok USING ({UK}) GROUP BY 1""")


def acf_spectra(s, d):
    """Spectra of autocorrelations, which tell rhythms that channels share."""
    return R.welch_spectra(R.acf(A(s, d), 48).select("recording_id", "unit_id", F.col("acf").alias("trace")), fx.FPS, 32, 16, 32, "hamming")


def crosstalk(s, d):
    spectra = acf_spectra(s, d)
    return R.dominant_freq(spectra, 0.0, 1.0).join(R.occupied_bandwidth(spectra, 0.0, 1.0, 0.9), ["recording_id", "unit_id"])


add("e24_crosstalk", lambda s, d: rounded(crosstalk(s, d)), "traces",
    f"""WITH ac AS (SELECT recording_id, unit_id, frame, v AS value FROM ({ACF.format(first=0, last=48)})), {welch_sql('ac', UK, 32, 2, 'sp', '0.54 - 0.46')},
        c AS (SELECT *, sum(pxx) OVER (PARTITION BY {UK} ORDER BY f) / sum(pxx) OVER (PARTITION BY {UK}) AS c, row_number() OVER (PARTITION BY {UK} ORDER BY pxx DESC, f) AS o FROM sp WHERE f <= 1)
        SELECT {UK}, {_r('max(f) FILTER (o = 1)', 'dom')}, {_r('max(pxx)', 'power')}, {_r('min(f) FILTER (c >= 1 - (1 - 0.9) / 2) - min(f) FILTER (c >= (1 - 0.9) / 2)', 'obw')} FROM c GROUP BY 1, 2""")



def half_spectra(s, d, first):
    """Spectra of one half of each trace, windows of 16 frames."""
    half = A(s, d).withColumn("trace", F.slice("trace", first + 1, 32))
    return R.welch_spectra(half, fx.FPS, 16, 8, 16)


add("n13_halves_stability", lambda s, d: rounded(N.spectrum_stability(half_spectra(s, d, 0), half_spectra(s, d, 32))), "traces",
    f"""WITH lo AS (SELECT recording_id, unit_id, frame, value FROM traces WHERE frame < 32), hi AS (SELECT recording_id, unit_id, frame - 32 AS frame, value FROM traces WHERE frame >= 32), {welch_sql('lo', UK, 16, 3, 'sa')}, {welch_sql('hi', UK, 16, 3, 'sb')},
        b AS (SELECT recording_id, unit_id, sa.pxx AS x, sb.pxx AS y FROM sa JOIN sb USING (recording_id, unit_id, f)),
        g AS (SELECT recording_id, count(DISTINCT unit_id) AS units, avg((x - y) ** 2) AS mse, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy, greatest(max(x), max(y)) - least(min(x), min(y)) AS rg FROM b GROUP BY 1 HAVING count(DISTINCT unit_id) >= 2)
        SELECT recording_id, units, {_r('mse', 'mse')}, {_r('(2 * mx * my + (0.01 * rg) ** 2) * (2 * cxy + (0.03 * rg) ** 2) / ((mx ** 2 + my ** 2 + (0.01 * rg) ** 2) * (vx + vy + (0.03 * rg) ** 2))', 'ssim')} FROM g""")

# periods


def periods(s, d):
    """Each trace in four periods of 15 frames and their shared ends, from frame 3 on."""
    t = P.fixed_periods(T(s, d), 3, 15)
    return R.collect_traces(t, ["recording_id", "unit_id", "period"])


add("r30_period_acf", lambda s, d: rounded(R.period_acf(periods(s, d), 12, 9)), "traces",
    f"""WITH p AS (SELECT recording_id, unit_id, CAST(p AS INTEGER) AS period, frame - 3 - p * 15 AS i, value - avg(value) OVER (PARTITION BY recording_id, unit_id, p) AS v FROM traces, range(4) q(p) WHERE frame BETWEEN 3 + p * 15 AND 18 + p * 15),
        n AS (SELECT recording_id, unit_id, period, sum(v * v) AS s FROM p GROUP BY 1, 2, 3), r AS (SELECT a.recording_id, a.unit_id, a.period, lag, sum(a.v * b.v) / any_value(n.s) AS r FROM p a JOIN range(13) g(lag) ON true JOIN p b USING (recording_id, unit_id, period) JOIN n USING (recording_id, unit_id, period) WHERE b.i = a.i + lag GROUP BY 1, 2, 3, 4)
        SELECT a.recording_id, a.unit_id, a.period, CAST(k AS INTEGER) AS k, {_r('a.r + (k * 12 / 8.0 - a.lag) * coalesce(b.r - a.r, 0)', 'r')} FROM range(9) g(k) JOIN r a ON a.lag = least(floor(k * 12 / 8.0), 11) JOIN r b ON b.recording_id = a.recording_id AND b.unit_id = a.unit_id AND b.period = a.period AND b.lag = a.lag + 1""")
PERIOD = f"""pr AS (SELECT recording_id, unit_id, CAST(p AS INTEGER) AS period, CAST(frame - 3 - p * 15 AS INTEGER) AS frame, value FROM traces, range(4) q(p) WHERE frame BETWEEN 3 + p * 15 AND 18 + p * 15), {welch_sql('pr', UK + ', period', 16, 1, 'sp')},
  dm AS (SELECT {UK}, period FROM (SELECT *, row_number() OVER (PARTITION BY {UK}, period ORDER BY pxx DESC, f) AS o FROM sp) WHERE o = 1 AND f BETWEEN 0.1 AND 0.5), pw AS (SELECT {UK}, period, max(pxx) AS power FROM sp JOIN dm USING ({UK}, period) WHERE f BETWEEN 0.1 AND 0.5 GROUP BY ALL)"""
add("r30_period_power", lambda s, d: rounded(R.period_power(periods(s, d), fx.FPS, 16, 0.1, 0.5)), "traces", f"WITH {PERIOD} SELECT {UK}, period, {_r('power', 'power')} FROM pw")
add("r30_pooled_power", lambda s, d: rounded(R.pooled_by_period(R.period_power(periods(s, d), fx.FPS, 16, 0.1, 0.5))), "traces", f"WITH {PERIOD} SELECT period, {_r('avg(power)', 'mean')}, {_r('stddev_samp(power) / sqrt(count(power))', 'sem')}, count(power) AS n FROM pw GROUP BY 1")

add("r30_pooled_limits", lambda s, d: rounded(R.pooled_limits(R.period_power(periods(s, d), fx.FPS, 16, 0.1, 0.5))), "traces",
    f"WITH {PERIOD}, vals AS (SELECT 1 AS g, power AS v FROM pw), {HAZEN.replace('0.05, 0.25, 0.5, 0.9', '0.01, 0.99')} SELECT {_r('max(q) FILTER (p = 0.01)', 'low')}, {_r('max(q) FILTER (p = 0.99)', 'high')} FROM h")

# latent modes


def components(s, d):
    return L.pca(A(s, d), 6)


def real_latents(s, d):
    """Scores of the first components as arrays."""
    return L.latent_arrays(components(s, d))


def latent(s, d):
    """Latents by an arithmetic rule (means of residue classes of units), so that any engine agrees."""
    return T(s, d).groupBy("recording_id", (F.col("unit_id") % 4).cast("int").alias("pc"), "frame").agg(F.avg("value").alias("value"))


WINDOWS = """se AS (SELECT DISTINCT recording_id, frame FROM ev WHERE frame BETWEEN 0 AND 63), wins AS (SELECT recording_id, CAST(k * 8 AS INTEGER) AS start, CAST(k * 8 + 23 AS INTEGER) AS "end" FROM (SELECT DISTINCT recording_id FROM se), range(6) q(k)),
  counts AS (SELECT w.recording_id, w.start, w."end", count(e.frame) AS n FROM wins w LEFT JOIN se e ON e.recording_id = w.recording_id AND e.frame BETWEEN w.start AND w."end" GROUP BY ALL),
  picked AS (SELECT recording_id, 'low' AS label, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n, start) AS k FROM counts) WHERE k = 1
    UNION ALL SELECT recording_id, 'high', start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, start) AS k FROM counts) WHERE k = 1)"""
LT = "lt AS (SELECT recording_id, CAST(unit_id % 4 AS INTEGER) AS pc, frame, avg(value) AS value FROM traces GROUP BY ALL)"
add("n14_pca_share", lambda s, d: rounded(components(s, d).select("recording_id", "pc", "share")))
ENERGY = "z AS (SELECT recording_id, unit_id, frame, value - avg(value) OVER w AS v, sum(value * value) OVER w - count(*) OVER w * pow(avg(value) OVER w, 2) AS s FROM traces WINDOW w AS (PARTITION BY recording_id, unit_id))"


def energy(s, d):
    """What all components of a recording hold, frame by frame."""
    pcs = L.pca(A(s, d), 64)
    rows = pcs.select("recording_id", "share", "n", F.posexplode("score").alias("frame", "v"))
    return rows.groupBy("recording_id", "frame").agg(F.sum(F.col("share") * F.col("n") * F.col("v") ** 2).alias("energy"))


add("n14_energy", lambda s, d: rounded(energy(s, d), 5), "traces", f"WITH {ENERGY} SELECT recording_id, frame, round(sum(v * v / s), 5) + 0.0 AS energy FROM z GROUP BY 1, 2")
add("n15_pca_time", lambda s, d: rounded(L.pca_time(A(s, d), 3)[0].select("recording_id", "pc", "variance", F.posexplode("pattern").alias("frame", "value"))))

def whole_patterns(s, d):
    """Per frame the summed squares of the patterns of all components over time."""
    patterns = L.pca_time(A(s, d), 64)[0]
    return patterns.select("recording_id", F.posexplode("pattern").alias("frame", "v")).groupBy("recording_id", "frame").agg(F.sum(F.col("v") ** 2).alias("variance"))


# all patterns together hold the variance of the z-scored units at each frame
add("n15_variance", lambda s, d: rounded(whole_patterns(s, d), 5), "traces",
    "WITH z AS (SELECT recording_id, frame, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS v FROM traces WINDOW w AS (PARTITION BY recording_id, unit_id)) SELECT recording_id, frame, round(var_samp(v), 5) + 0.0 AS variance FROM z GROUP BY 1, 2")


def cosine_energy(s, d):
    """Per frame what all modes of the frames' cosine similarity hold."""
    m = L.cosine_modes(A(s, d), 64).select("recording_id", "share", "n", F.posexplode("score").alias("frame", "v"))
    return m.groupBy("recording_id", "frame").agg(F.sum(F.col("share") * F.col("n") * F.col("v") ** 2).alias("energy"))


# frames have length 1 over the units, so all modes together hold 1 of each
add("n32_cosine_energy", lambda s, d: rounded(cosine_energy(s, d), 5), "traces", "SELECT recording_id, frame, 1.0 AS energy FROM traces GROUP BY 1, 2")
add("n15_time_scores", lambda s, d: rounded(L.pca_time(A(s, d), 3)[1]))
add("n16_mode_assignment", lambda s, d: L.mode_assignment(L.loadings(A(s, d), components(s, d))).groupBy("recording_id", "mode").agg(F.count("*").alias("n")))
add("n16_mode_traces", lambda s, d: rounded(L.mode_traces(T(s, d), fx.positions(s, d).select("recording_id", "unit_id", (F.col("unit_id") % 5).alias("mode")))), "traces", f"SELECT recording_id, unit_id % 5 AS mode, frame, {_r('avg(value)', 'value')} FROM traces GROUP BY ALL")


def phases(s, d):
    return latent(s, d).select("recording_id", "pc", "frame", (F.col("value") * 20).alias("phase"), F.round(F.abs("value"), 9).alias("amp"))


PLV = """ph AS (SELECT recording_id, pc, frame, value * 20 AS phase, round(abs(value), 9) AS amp FROM lt), o AS (SELECT recording_id, pc, amp, row_number() OVER (PARTITION BY recording_id, pc ORDER BY amp) AS i, count(*) OVER (PARTITION BY recording_id, pc) AS n, lead(amp) OVER (PARTITION BY recording_id, pc ORDER BY amp) AS nx FROM ph),
  qa AS (SELECT recording_id, pc, amp + coalesce((0.2 * n + 0.5 - i) * (nx - amp), 0) AS q FROM o WHERE floor(0.2 * n + 0.5) = i), st AS (SELECT ph.* FROM ph JOIN qa USING (recording_id, pc) WHERE amp >= q),
  pl AS (SELECT a.recording_id, a.pc AS a, b.pc AS b, sqrt(pow(avg(cos(a.phase - b.phase)), 2) + pow(avg(sin(a.phase - b.phase)), 2)) AS plv, atan2(avg(sin(a.phase - b.phase)), avg(cos(a.phase - b.phase))) AS lag, count(*) AS n FROM st a JOIN st b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.pc < b.pc GROUP BY ALL)"""
add("n17_phase_locking", lambda s, d: rounded(L.phase_locking(phases(s, d))), "traces", f"WITH {LT}, {PLV} SELECT recording_id, a, b, {_r('CASE WHEN n >= 20 THEN plv END', 'plv')}, {_r('CASE WHEN n >= 20 THEN lag END', 'lag')}, n FROM pl")
add("n18_phase_components", lambda s, d: L.phase_components(L.phase_locking(phases(s, d)), phases(s, d), 0.3), "traces",
    f"""WITH RECURSIVE {LT}, {PLV}, e AS (SELECT recording_id, a AS x, b AS y FROM pl WHERE n >= 20 AND plv >= 0.3 UNION SELECT recording_id, b, a FROM pl WHERE n >= 20 AND plv >= 0.3),
        reach AS (SELECT DISTINCT recording_id, pc AS x, pc AS y FROM lt UNION SELECT r.recording_id, r.x, e.y FROM reach r JOIN e ON e.recording_id = r.recording_id AND e.x = r.y)
        SELECT recording_id, x AS pc, min(y) AS component FROM reach GROUP BY 1, 2""")


def real_phases(s, d):
    """Phases of the band-passed components."""
    key = ["recording_id", "pc"]
    return R.long_phases(R.analytic_signal(R.bandpass(real_latents(s, d), fx.FPS, 0.05, 0.5, keys=key), key), key)


add("n17_component_locking", lambda s, d: rounded(L.phase_locking(real_phases(s, d)), 5))
add("n19_lagged_products", lambda s, d: rounded(L.lagged_products(latent(s, d))), "traces",
    f"""WITH {LT}, x AS (SELECT *, lead(value) OVER (PARTITION BY recording_id, pc ORDER BY frame) AS nx FROM lt) SELECT a.recording_id, a.pc AS i, b.pc AS j, {_r('sum(a.value * b.value)', 's0')}, {_r('sum(a.nx * b.value)', 's1')} FROM x a JOIN x b ON a.recording_id = b.recording_id AND a.frame = b.frame WHERE a.nx IS NOT NULL GROUP BY 1, 2, 3""")
add("n19_lds_fit", lambda s, d: rounded(L.lds_fit(latent(s, d), fx.FPS, 0.05, 0.5).select("recording_id", "magnitude", "freq", "candidate", "pairs"), 5))
add("n20_sliding", lambda s, d: rounded(L.sliding_oscillators(real_latents(s, d), P.valid_frames(fx.event_train(s, d), 64), fx.FPS, 32, 8, 0.05, 0.5, 32).withColumn("freqs", F.array_join(F.transform("freqs", lambda x: F.format_string("%.4f", x)), ",")), 5))
add("n23_fixed_latents", lambda s, d: rounded(L.fixed_latent_windows(real_latents(s, d), picked_windows(s, d), fx.FPS, 0.05, 0.5, 24).select("recording_id", "label", "pairs", "freq_cv", "plv", F.posexplode("fractions").alias("pc", "fraction")), 5))
add("n21_interpretation", lambda s, d: fx.positions(s, d).select("recording_id", "unit_id", L.interpretation(F.col("z") % 4, F.col("x") / 37, F.col("y") / 50, F.col("z") % 3, F.col("x") % 3).alias("label")), "positions",
    f"""SELECT recording_id, unit_id, CASE WHEN z % 4 <= 1 AND x / 37 > 0.8 THEN '{L.ONE}' WHEN z % 4 >= 2 AND (y / 50 > 0.15 OR x / 37 < 0.7 OR z % 3 >= 2) THEN '{L.SEVERAL}' WHEN x % 3 >= 2 THEN '{L.TRANSIENT}' ELSE '{L.MIXED}' END AS label FROM positions""")
TEST = O.OscillatorTest(fx.FPS, band=(0.05, 0.5), welch=16.0, window=16.0, step=4.0)


def clock_events(s, d):
    return P.valid_frames(fx.event_train(s, d), 64)


add("n21_recordings", lambda s, d: rounded(O.summaries(A(s, d), components(s, d), clock_events(s, d), TEST)[0], 5))


def arithmetic_latents(s, d):
    """The arithmetic latents as arrays."""
    return R.collect_traces(latent(s, d), ["recording_id", "pc"])


add("n20_window_events", lambda s, d: rounded(L.sliding_oscillators(arithmetic_latents(s, d), clock_events(s, d), fx.FPS, 32, 8, 0.05, 0.5, 32).select("recording_id", "start", "centre", "events")), "traces ev",
    """WITH se AS (SELECT DISTINCT recording_id, frame FROM ev WHERE frame BETWEEN 0 AND 63), w AS (SELECT recording_id, CAST(k * 8 AS INTEGER) AS start FROM (SELECT DISTINCT recording_id FROM traces), range(5) q(k))
       SELECT w.recording_id, start, (start + 16) / 2.0 AS centre, count(frame) AS events FROM w LEFT JOIN se ON se.recording_id = w.recording_id AND frame >= start AND frame < start + 32 GROUP BY 1, 2""")
add("n23_fractions", lambda s, d: rounded(L.fixed_latent_windows(arithmetic_latents(s, d), picked_windows(s, d), fx.FPS, 0.05, 0.5, 24).select("recording_id", "label", F.posexplode("fractions").alias("pc", "fraction"))), "traces ev",
    f"""WITH {LT}, {WINDOWS}, b AS (SELECT recording_id, label, start, "end" FROM picked UNION ALL SELECT DISTINCT recording_id, 'full', 0, 63 FROM traces), v AS (SELECT lt.recording_id, label, pc, var_samp(value) AS v FROM lt JOIN b ON b.recording_id = lt.recording_id AND frame BETWEEN start AND "end" GROUP BY 1, 2, 3)
        SELECT recording_id, label, pc, {_r('v / sum(v) OVER (PARTITION BY recording_id, label)', 'fraction')} FROM v""")


def arithmetic_modes(s, d):
    """Modes of units by a rule, for several K; each K leaves some units out."""
    u = fx.positions(s, d).select("recording_id", "unit_id")
    return reduce(DataFrame.unionByName, [u.filter(F.col("unit_id") % (k + 2) != 0).select(F.lit(k).alias("k"), "recording_id", "unit_id", (F.col("unit_id") * 31 % k).alias("mode")) for k in (3, 4, 6)])


add("n25_stability_of_rules", lambda s, d: rounded(L.assignment_stability(arithmetic_modes(s, d), [3, 4, 6])), "positions",
    f"""WITH m AS (SELECT recording_id, unit_id, k, unit_id * 31 % k AS mode FROM positions, (SELECT unnest([3, 4, 6]) AS k) WHERE unit_id % (k + 2) <> 0), p AS (SELECT * FROM (VALUES (3, 4), (4, 6)) t(was, k)),
        a AS (SELECT p.k, recording_id, unit_id, mode FROM m JOIN p ON p.was = m.k), b AS (SELECT m.k, recording_id, unit_id, mode FROM m WHERE k <> 3)
        SELECT coalesce(a.k, b.k) AS k, coalesce(a.recording_id, b.recording_id) AS recording_id, count(CASE WHEN a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL THEN 1 END) AS common, {_r('avg(CASE WHEN a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL THEN CAST(a.mode = b.mode AS DOUBLE) END)', 'equal')},
          {_r('count(CASE WHEN a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL THEN 1 END) / count(*)', 'jaccard')} FROM a FULL JOIN b ON a.k = b.k AND a.recording_id = b.recording_id AND a.unit_id = b.unit_id GROUP BY 1, 2""")
add("n25_assignment_stability", lambda s, d: rounded(L.assignment_stability(swept_modes(s, d), [3, 4, 5, 6, 8])))
add("n26_k_sweep", lambda s, d: rounded(O.k_sweep(A(s, d), clock_events(s, d), [3, 4, 5, 6, 8], TEST)[1], 5))
add("n22_variance_fraction", lambda s, d: rounded(L.variance_fraction(latent(s, d), 10, 40)), "traces",
    f"WITH {LT} SELECT recording_id, pc, {_r('var_samp(value) / sum(var_samp(value)) OVER (PARTITION BY recording_id)', 'fraction')} FROM lt WHERE frame BETWEEN 10 AND 40 GROUP BY 1, 2")


def unit_points(s, d):
    p = fx.positions(s, d).withColumn("mode", (F.col("unit_id") * 7 % 3))
    return p.select("recording_id", "mode", F.col("unit_id").alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("dim"), F.col("x").alias("v")), F.struct(F.lit(1).alias("dim"), F.col("y").alias("v")))).alias("s")).select("recording_id", "mode", "id", "s.dim", "s.v")


add("n24_geometry", lambda s, d: rounded(L.geometry_separation(unit_points(s, d))), "positions",
    f"""WITH p AS (SELECT recording_id, unit_id * 7 % 3 AS mode, x, y FROM positions), c AS (SELECT recording_id, mode, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1, 2 HAVING count(*) >= 3),
        w AS (SELECT recording_id, avg(s) AS within FROM (SELECT p.recording_id, p.mode, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS s FROM p JOIN c ON c.recording_id = p.recording_id AND c.mode = p.mode GROUP BY 1, 2) GROUP BY 1),
        b AS (SELECT a.recording_id, avg(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)) AS between FROM c a JOIN c b ON a.recording_id = b.recording_id AND a.mode < b.mode GROUP BY 1) SELECT recording_id, {_r('CASE WHEN within > 0 THEN "between" / within END', 'separation')} FROM b JOIN w USING (recording_id)""")
add("n26_k_selection", lambda s, d: rounded(L.k_selection(fx.positions(s, d).select((F.col("unit_id") % 5).alias("k"), F.col("x").alias("plv"), F.col("y").alias("cv")), ["plv"], ["cv"])), "positions",
    f"""WITH g AS (SELECT unit_id % 5 AS k, avg(x) AS plv, avg(y) AS cv FROM positions GROUP BY 1), z AS (SELECT *, CASE WHEN stddev_samp(plv) OVER () > 0 THEN (plv - avg(plv) OVER ()) / stddev_samp(plv) OVER () ELSE 0 END AS z_plv, CASE WHEN stddev_samp(cv) OVER () > 0 THEN (cv - avg(cv) OVER ()) / stddev_samp(cv) OVER () ELSE 0 END AS z_cv FROM g)
        SELECT k, {_r('plv', 'plv')}, {_r('cv', 'cv')}, {_r('z_plv', 'z_plv')}, {_r('z_cv', 'z_cv')}, {_r('z_plv - z_cv', 'score')} FROM z""")
PATH = """q AS (SELECT recording_id, frame, max(value) FILTER (pc = 0) AS a, max(value) FILTER (pc = 1) AS b, max(value) FILTER (pc = 2) AS c FROM lt GROUP BY 1, 2),
  p AS (SELECT recording_id, frame, a - avg(a) OVER (PARTITION BY recording_id) AS x, b - avg(b) OVER (PARTITION BY recording_id) AS y, c - avg(c) OVER (PARTITION BY recording_id) AS z FROM q),
  v AS (SELECT *, (lead(x) OVER w - x) * 2 AS vx, (lead(y) OVER w - y) * 2 AS vy, (lead(z) OVER w - z) * 2 AS vz, x * x + y * y + z * z AS r2 FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY frame))"""


def picked_windows(s, d):
    """The least and the most eventful of the windows of each recording."""
    return low_high.low_high_windows(clock_events(s, d), 64, 24, 8)


def swept_modes(s, d):
    """Modes of units for several numbers of components."""
    load = L.loadings(A(s, d), L.pca(A(s, d), 8))
    return reduce(DataFrame.unionByName, [L.mode_assignment(load.filter(F.col("pc") < k)).select(F.lit(k).alias("k"), "recording_id", "unit_id", "mode") for k in (3, 4, 5, 6, 8)])


def window_energy(s, d):
    """Per frame of the picked windows the summed squares of all components that were fitted on the windows."""
    cut = L.window_latents(A(s, d), picked_windows(s, d), 48)[1]
    return cut.select("recording_id", "label", F.posexplode("trace").alias("frame", "v")).groupBy("recording_id", "label", "frame").agg((F.sum(F.col("v") ** 2) / 47).alias("energy"))


def path(s, d):
    return L.trajectory(latent(s, d), fx.FPS)


# all components together hold what the standardised windows hold, frame by frame
add("n27_window_energy", lambda s, d: rounded(window_energy(s, d), 5), "traces ev",
    f"""WITH {WINDOWS}, c AS (SELECT t.recording_id, label, unit_id, frame - start AS frame, value FROM traces t JOIN picked p ON p.recording_id = t.recording_id AND t.frame BETWEEN p.start AND p."end"),
        z AS (SELECT recording_id, label, unit_id, frame, value - avg(value) OVER w AS v, sum(value * value) OVER w - count(*) OVER w * pow(avg(value) OVER w, 2) AS s FROM c WINDOW w AS (PARTITION BY recording_id, unit_id))
        SELECT recording_id, label, CAST(frame AS INTEGER) AS frame, round(sum(v * v / s), 5) + 0.0 AS energy FROM z GROUP BY 1, 2, 3""")
add("n27_trajectory", lambda s, d: rounded(path(s, d)), "traces",
    f"WITH {LT}, {PATH} SELECT recording_id, frame, {_r('x', 'x')}, {_r('y', 'y')}, {_r('z', 'z')}, {_r('sqrt(r2)', 'radius')}, {_r('sqrt(vx * vx + vy * vy + vz * vz)', 'speed')}, {_r('CASE WHEN r2 > 0 THEN sqrt((y * vz - z * vy) ** 2 + (z * vx - x * vz) ** 2 + (x * vy - y * vx) ** 2) / r2 END', 'angular')} FROM v")
SUMMARY = """w2 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, lead(r2) OVER w AS r1 FROM v WINDOW w AS (PARTITION BY recording_id ORDER BY frame))"""
add("n27_trajectory_summary", lambda s, d: rounded(L.trajectory_summary(path(s, d), fx.FPS)), "traces",
    f"""WITH {LT}, {PATH}, {SUMMARY} SELECT recording_id, {_r('avg(sqrt(r2))', 'radius')}, {_r('avg(sqrt(vx * vx + vy * vy + vz * vz))', 'speed')}, {_r('avg(CASE WHEN r2 > 0 THEN sqrt((y * vz - z * vy) ** 2 + (z * vx - x * vz) ** 2 + (x * vy - y * vx) ** 2) / r2 END)', 'angular')},
        {_r('sum(CASE WHEN x1 IS NOT NULL THEN acos(least(greatest((x * x1 + y * y1 + z * z1) / (sqrt(r2) * sqrt(r1)), -1), 1)) END) / (2 * pi())', 'rotations')} FROM w2 GROUP BY 1""")
LOOPS = """sd AS (SELECT recording_id, frame, x, y, z, sqrt(r2) AS radius, stddev_samp(sqrt(r2)) OVER (PARTITION BY recording_id) AS sd FROM v), ou AS (SELECT *, radius >= 3.5 * sd AS act, lag(radius >= 3.5 * sd) OVER (PARTITION BY recording_id ORDER BY frame) AS was FROM sd),
  lo AS (SELECT *, sum(CAST(act AND NOT coalesce(was, false) AS INTEGER)) OVER (PARTITION BY recording_id ORDER BY frame) AS loop FROM ou), li AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(z) OVER w AS z1, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM lo WHERE act WINDOW w AS (PARTITION BY recording_id, loop ORDER BY frame)),
  lp AS (SELECT recording_id, CAST(loop AS BIGINT) AS loop, min(frame) AS start, max(frame) AS "end", max(radius) AS peak, sum(sqrt((x1 - x) ** 2 + (y1 - y) ** 2 + (z1 - z) ** 2)) AS length, sum((x * coalesce(y1, y0) - coalesce(x1, x0) * y) / 2) AS area, max(sd) AS sd, count(*) / 2.0 AS duration FROM li GROUP BY 1, 2),
  lk AS (SELECT * FROM lp WHERE peak >= 4.0 * sd AND duration >= 1)"""
add("n28_loops", lambda s, d: rounded(L.loops(path(s, d), fx.FPS, 3.5, 4.0, 1.0)), "traces",
    f"""WITH {LT}, {PATH}, {LOOPS} SELECT recording_id, loop, start, "end", {_r('peak', 'peak')}, {_r('length', 'length')}, {_r('area', 'area')}, {_r('duration', 'duration')}, area > 0 AS ccw FROM lk""")
add("n28_loop_normals", lambda s, d: rounded(L.loop_normals(path(s, d), L.loops(path(s, d), fx.FPS, 3.5, 4.0, 1.0)), 4))
add("n29_loop_summary", lambda s, d: rounded(L.loop_summary(L.loops(path(s, d), fx.FPS, 3.5, 4.0, 1.0))), "traces",
    f"WITH {LT}, {PATH}, {LOOPS} SELECT recording_id, count(*) AS n, {_r('median(duration)', 'duration')}, {_r('median(peak)', 'peak')}, {_r('median(length)', 'length')}, {_r('avg(CAST(area > 0 AS DOUBLE))', 'ccw')} FROM lk GROUP BY 1")


def varimax_modes(s, d):
    """Each recording with the number of components that hold 80 % of its variance, 2 to 8."""
    pcs = L.pca(A(s, d), 8)
    q = L.varimax_components(pcs)
    load = L.loadings(A(s, d), pcs, unit_norm=True).join(q, "recording_id").filter(F.col("pc") < F.col("q")).drop("q")
    return L.varimax_assign(load)


add("n30_kmeans", lambda s, d: L.kmeans_rows(A(s, d), [2, 3, 4, 5, 6]))


def cluster_cost(units, labels):
    """(recording_id, k, cost): summed distance of standardised rows to the direction of their cluster's mean, from sums of vectors."""
    z = N._standardised(units)
    own = labels.join(z, ["recording_id", "unit_id"])
    sums = L.group_frame_sums(own.select("recording_id", "k", "cluster", "trace"), ["recording_id", "k", "cluster"])
    length = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, x: a + x * x))
    return sums.groupBy("recording_id", "k").agg(F.sum(length).alias("held")).join(own.groupBy("recording_id", "k").agg(F.count("*").alias("units")), ["recording_id", "k"]).select("recording_id", "k", "units", (F.col("units") - F.col("held")).alias("cost"))


def kmeans_against_rule(s, d):
    """Whether k-means groups the units at no higher cost than their ids modulo K do, and whether it uses every cluster."""
    found = L.kmeans_rows(A(s, d), [2, 3, 4, 5, 6])
    rule = fx.positions(s, d).select("recording_id", "unit_id", F.explode(F.array(*[F.lit(k) for k in (2, 3, 4, 5, 6)])).alias("k")).withColumn("cluster", (F.col("unit_id") % F.col("k")).cast("int"))
    used = found.groupBy("recording_id", "k").agg(F.count_distinct("cluster").alias("clusters"))
    a, b = cluster_cost(A(s, d), found), cluster_cost(A(s, d), rule).select("recording_id", "k", F.col("cost").alias("rule"))
    return a.join(b, ["recording_id", "k"]).join(used, ["recording_id", "k"]).select("recording_id", "k", "units", "clusters", (F.col("cost") <= F.col("rule") + 1e-9).alias("no_worse"))


add("n30_kmeans_against_rule", kmeans_against_rule, "traces", "SELECT recording_id, CAST(k AS INTEGER) AS k, count(DISTINCT unit_id) AS units, CAST(any_value(k) AS BIGINT) AS clusters, true AS no_worse FROM traces, range(2, 7) q(k) GROUP BY 1, 2")
add("n31_varimax", varimax_modes)
add("n32_unit_mode_corr", lambda s, d: rounded(L.cosine_assign(A(s, d), 3)))
CL = "cl AS (SELECT recording_id, unit_id, unit_id * 7 % 3 AS cluster, unit_id * 37 % 128 / 1000.0 AS dom FROM traces GROUP BY 1, 2)"
PAIRS_OF = "{0} AS (SELECT a.recording_id, a.unit_id AS u, b.unit_id AS v, corr(a.value, b.value) AS r FROM {1} a JOIN {1} b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.unit_id <> b.unit_id GROUP BY ALL)"


def clusters(s, d):
    return fx.positions(s, d).select("recording_id", F.lit("rule").alias("solution"), "unit_id", (F.col("unit_id") * 7 % 3).alias("cluster"))


def acf_arrays(s, d, lags: int = 20):
    return R.acf(A(s, d), lags).select("recording_id", "unit_id", F.col("acf").alias("trace"))


add("n33_cluster_eval", lambda s, d: rounded(L.cluster_eval(A(s, d), clusters(s, d), acf_arrays(s, d), fx.positions(s, d).select("recording_id", "unit_id", (F.col("unit_id") * 37 % 128 / 1000.0).alias("dom"))).drop("solution")), "traces",
    f"""WITH ac AS (SELECT recording_id, unit_id, frame, v AS value FROM ({ACF.format(first=0, last=20)})), {PAIRS_OF.format('cr', 'traces')}, {PAIRS_OF.format('ca', 'ac')}, {CL},
        g AS (SELECT cr.recording_id, u, p.cluster AS cu, q.cluster AS cv, avg(1 - r) AS d, sum(r) AS sr, count(*) AS n FROM cr JOIN cl p ON p.recording_id = cr.recording_id AND p.unit_id = u JOIN cl q ON q.recording_id = cr.recording_id AND q.unit_id = v GROUP BY ALL),
        ga AS (SELECT ca.recording_id, p.cluster AS c, avg(r) AS r FROM ca JOIN cl p ON p.recording_id = ca.recording_id AND p.unit_id = u JOIN cl q ON q.recording_id = ca.recording_id AND q.unit_id = v AND q.cluster = p.cluster GROUP BY 1, 2),
        pc AS (SELECT recording_id, cu AS c, sum(sr) / sum(n) AS r FROM g WHERE cu = cv GROUP BY 1, 2), fr AS (SELECT recording_id, cluster AS c, count(*) AS size, CASE WHEN count(dom) FILTER (dom > 0) >= 2 THEN stddev_samp(dom) FILTER (dom > 0) / avg(dom) FILTER (dom > 0) END AS cv FROM cl GROUP BY 1, 2),
        s AS (SELECT recording_id, u, max(d) FILTER (cu = cv) AS a, min(d) FILTER (cu <> cv) AS b FROM g GROUP BY 1, 2), si AS (SELECT recording_id, avg((b - a) / greatest(a, b)) AS sil FROM s GROUP BY 1)
        SELECT fr.recording_id, count(*) AS clusters, count(*) FILTER (size >= 2) AS used, {_r('avg(pc.r) FILTER (size >= 2)', 'within')}, {_r('avg(ga.r) FILTER (size >= 2)', 'acf_within')}, {_r('avg(cv) FILTER (size >= 2)', 'freq_cv')}, {_r('CASE WHEN count(*) >= 2 AND min(size) >= 2 THEN any_value(sil) END', 'silhouette')}
        FROM fr LEFT JOIN pc ON pc.recording_id = fr.recording_id AND pc.c = fr.c LEFT JOIN ga ON ga.recording_id = fr.recording_id AND ga.c = fr.c LEFT JOIN si ON si.recording_id = fr.recording_id GROUP BY 1""")
add("n33_cluster_acf", lambda s, d: rounded(L.cluster_acf(acf_arrays(s, d), clusters(s, d))), "traces",
    f"""WITH ac AS ({ACF.format(first=0, last=20)}), {CL} SELECT ac.recording_id, cluster, count(*) AS size, frame AS lag, {_r('avg(v)', 'r')} FROM ac JOIN cl ON cl.recording_id = ac.recording_id AND cl.unit_id = ac.unit_id GROUP BY 1, 2, 4""")
add("n34_ensembles", lambda s, d: rounded(O.ensembles(A(s, d), fx.FPS, [2, 3, 4, 5, 6], 20, 30, 32, (0.05, 0.9)), 5))
add("n34_cluster_ranking", lambda s, d: rounded(L.cluster_ranking(fx.positions(s, d).groupBy((F.col("unit_id") % 6).alias("sol")).agg(F.avg("x").alias("within"), F.avg("y").alias("acf_within"), F.avg("z").alias("freq_cv"), F.max("x").alias("silhouette")), []).select("sol", "score")), "positions",
    f"""WITH g AS (SELECT unit_id % 6 AS sol, avg(x) AS a, avg(y) AS b, avg(z) AS c, max(x) AS e FROM positions GROUP BY 1) SELECT sol, {_r('+ '.join(f"{sg} CASE WHEN stddev_samp({v}) OVER () > 0 THEN ({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () ELSE 0 END " for v, sg in (('a', ''), ('b', ''), ('c', '-'), ('e', ''))), 'score')} FROM g""")


def rule_quality(s, d):
    """Groupings of the units by rule for several K, evaluated on their traces, autocorrelations and dominant frequencies: recording_id, k and the columns of ``cluster_eval``."""
    rules = fx.positions(s, d).select("recording_id", "unit_id", F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("solution")).withColumn("cluster", F.col("unit_id") * 7 % F.col("solution"))
    quality = L.cluster_eval(A(s, d), rules, acf_arrays(s, d), R.dominant_freq(spectra(s, d), 0.1, 0.9).select("recording_id", "unit_id", "dom"))
    return quality.withColumn("k", F.col("solution").cast("int")).drop("solution")


RULE_QUALITY = f"""{SPEC}, dm AS (SELECT recording_id, unit_id, f AS dom FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_id ORDER BY pxx DESC, f) AS k FROM sp WHERE f BETWEEN 0.1 AND 0.9) WHERE k = 1),
  ac AS (SELECT recording_id, unit_id, frame, v AS value FROM ({ACF.format(first=0, last=20)})), {PAIRS_OF.format('cr', 'traces')}, {PAIRS_OF.format('ca', 'ac')},
  cl AS (SELECT recording_id, unit_id, k, unit_id * 7 % k AS cluster FROM (SELECT DISTINCT recording_id, unit_id FROM traces), (SELECT CAST(unnest([2, 3, 4]) AS INTEGER) AS k)),
  g AS (SELECT cr.recording_id, p.k, u, p.cluster AS cu, q.cluster AS cv, sum(r) AS sr, count(*) AS n FROM cr JOIN cl p ON p.recording_id = cr.recording_id AND p.unit_id = u JOIN cl q ON q.recording_id = cr.recording_id AND q.unit_id = v AND q.k = p.k GROUP BY ALL),
  ga AS (SELECT ca.recording_id, p.k, p.cluster AS c, avg(r) AS r FROM ca JOIN cl p ON p.recording_id = ca.recording_id AND p.unit_id = u JOIN cl q ON q.recording_id = ca.recording_id AND q.unit_id = v AND q.k = p.k AND q.cluster = p.cluster GROUP BY 1, 2, 3),
  gc AS (SELECT recording_id, k, cu AS c, sum(sr) / sum(n) AS r FROM g WHERE cu = cv GROUP BY 1, 2, 3),
  fr AS (SELECT cl.recording_id, k, cluster AS c, count(*) AS size, CASE WHEN count(dom) FILTER (dom > 0) >= 2 THEN stddev_samp(dom) FILTER (dom > 0) / avg(dom) FILTER (dom > 0) END AS cv FROM cl LEFT JOIN dm ON dm.recording_id = cl.recording_id AND dm.unit_id = cl.unit_id GROUP BY 1, 2, 3),
  si AS (SELECT recording_id, k, avg((b - a) / greatest(a, b)) AS sil FROM (SELECT recording_id, k, u, max(1 - sr / n) FILTER (cu = cv) AS a, min(1 - sr / n) FILTER (cu <> cv) AS b FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
  rq AS (SELECT fr.recording_id, fr.k, count(*) AS clusters, count(*) FILTER (size >= 2) AS used, avg(gc.r) FILTER (size >= 2) AS within, avg(ga.r) FILTER (size >= 2) AS acf_within, avg(cv) FILTER (size >= 2) AS freq_cv, CASE WHEN count(*) >= 2 AND min(size) >= 2 THEN any_value(sil) END AS silhouette
    FROM fr LEFT JOIN gc USING (recording_id, k, c) LEFT JOIN ga USING (recording_id, k, c) LEFT JOIN si USING (recording_id, k) GROUP BY 1, 2)"""
_MEASURES = ("within", "acf_within", "freq_cv", "silhouette")


def _z(column: str, over: str) -> str:
    return f"coalesce(CASE WHEN stddev_samp({column}) OVER {over} > 0 THEN ({column} - avg({column}) OVER {over}) / stddev_samp({column}) OVER {over} END, 0)"


add("n34_ranked_rules", lambda s, d: rounded(L.cluster_ranking(rule_quality(s, d)), 5), "traces",
    f"""WITH {RULE_QUALITY} SELECT recording_id, k, clusters, used, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _MEASURES)},
        round({' + '.join(_z(c, 'w') for c in ('within', 'acf_within', 'silhouette'))} - {_z('freq_cv', 'w')}, 5) + 0.0 AS score FROM rq WINDOW w AS (PARTITION BY recording_id)""")
add("n26_selection_of_rules", lambda s, d: rounded(L.k_selection(rule_quality(s, d), ["within", "acf_within", "silhouette"], ["freq_cv"]), 5), "traces",
    f"""WITH {RULE_QUALITY}, m AS (SELECT k, {', '.join(f'avg({c}) AS {c}' for c in _MEASURES)} FROM rq GROUP BY 1), z AS (SELECT *, {', '.join(f"{_z(c, '()')} AS z_{c}" for c in _MEASURES)} FROM m)
        SELECT k, {', '.join(f'round({c}, 5) + 0.0 AS {c}, round(z_{c}, 5) + 0.0 AS z_{c}' for c in _MEASURES)}, round(z_within + z_acf_within + z_silhouette - z_freq_cv, 5) + 0.0 AS score FROM z""")

# surrogates


def kept_moments():
    """Mean, sum of squares, and sum of products with the next sample around the circle."""
    nxt = F.concat(F.slice("trace", 2, 63), F.slice("trace", 1, 1))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    trace = F.col("trace")
    return (F.aggregate("trace", F.lit(0.0), lambda a, x: a + x) / 64).alias("mean"), dot(trace, trace).alias("energy"), dot(trace, nxt).alias("turn")


def representative(s, d):
    """Mean trace per recording."""
    return R.collect_traces(T(s, d).groupBy("recording_id", "frame").agg(F.avg("value").alias("value")), ["recording_id"])


#: Surrogates of each kind; frames of the spectra's segments; lags of the autocorrelation's peaks.
SURROGATES, SEGMENT, LAGS = 100, 32, (2, 30)


def surrogate_metrics(s, d, seeds: int = SURROGATES):
    key = ["recording_id", "seed"]
    of = lambda kind: R.rhythm_metrics(R.surrogates(representative(s, d), kind, seeds, ["recording_id"]).filter("error is null"), fx.FPS, 0.05, 0.5, 32, 16, SEGMENT, LAGS, key).withColumn("kind", F.lit(kind))
    return of("phase").unionByName(of("ar1"))


def observed_metrics(s, d):
    return R.rhythm_metrics(representative(s, d), fx.FPS, 0.05, 0.5, 32, 16, SEGMENT, LAGS, ["recording_id"])


def rhythm_scores(s, d):
    return S.surrogate_scores(observed_metrics(s, d).filter(F.col("metric").isin(*S.SCORED)), surrogate_metrics(s, d), ["window_cv", "inst_cv"])


add("t10_phase_surrogates", lambda s, d: rounded(R.surrogates(representative(s, d), "phase", SURROGATES, ["recording_id"]).select("recording_id", "seed", F.posexplode("trace").alias("frame", "value")), 5))
add("t11_ar1_surrogates", lambda s, d: rounded(R.surrogates(representative(s, d), "ar1", SURROGATES, ["recording_id"]).select("recording_id", "seed", F.posexplode("trace").alias("frame", "value")), 5))
# what surrogates must keep: the mean, and for random phases the autocorrelation at lag 1 around the circle
add("t10_kept_by_phase", lambda s, d: rounded(R.surrogates(representative(s, d), "phase", SURROGATES, ["recording_id"]).select("recording_id", "seed", *kept_moments()), 5), "traces",
    f"""WITH m AS (SELECT recording_id, frame, avg(value) AS v FROM traces GROUP BY 1, 2), c AS (SELECT a.recording_id, a.frame, a.v, b.v AS nxt FROM m a JOIN m b ON b.recording_id = a.recording_id AND b.frame = (a.frame + 1) % 64)
        SELECT recording_id, CAST(seed AS INTEGER) AS seed, round(avg(v), 5) + 0.0 AS mean, round(sum(v * v), 5) + 0.0 AS energy, round(sum(v * nxt), 5) + 0.0 AS turn FROM c, range(1, {SURROGATES + 1}) q(seed) GROUP BY 1, 2""")
add("t11_ar1_parameters", lambda s, d: rounded(R.per_trace(representative(s, d), lambda x: dict(zip(("phi", "sd"), kernels.ar1_parameters(x))), "phi double, sd double", ["recording_id"]).drop("error")), "traces",
    f"""WITH m AS (SELECT recording_id, frame, avg(value) AS v FROM traces GROUP BY 1, 2), z AS (SELECT recording_id, frame, v - avg(v) OVER (PARTITION BY recording_id) AS v FROM m), c AS (SELECT *, lead(v) OVER (PARTITION BY recording_id ORDER BY frame) AS nxt FROM z),
        f AS (SELECT recording_id, greatest(least(sum(v * nxt) / sum(v * v), 0.995), -0.995) AS phi FROM c WHERE nxt IS NOT NULL GROUP BY 1) SELECT c.recording_id, {_r('any_value(phi)', 'phi')}, {_r('stddev_samp(nxt - phi * v)', 'sd')} FROM c JOIN f ON f.recording_id = c.recording_id WHERE nxt IS NOT NULL GROUP BY 1""")
add("t12_rhythm_metrics", lambda s, d: rounded(observed_metrics(s, d), 5))
add("t12_spectral_metrics", lambda s, d: rounded(observed_metrics(s, d).filter(F.col("metric").isin("peak_power", "peak_freq", "q"))), "traces",
    f"""WITH m AS (SELECT recording_id, frame, avg(value) AS v FROM traces GROUP BY 1, 2), w AS (SELECT CAST(i AS INTEGER) AS i, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS w FROM range(32) q(i)),
        ft AS (SELECT recording_id, sg, k, sum(v * w * cos(2 * pi() * k * i / 256)) AS re, sum(v * w * sin(2 * pi() * k * i / 256)) AS im FROM m, range(3) a(sg), w, range(7, 65) b(k) WHERE frame = sg * 16 + i GROUP BY 1, 2, 3),
        sp AS (SELECT recording_id, k / 128.0 AS f, avg(re * re + im * im) / (SELECT sum(w * w) FROM w) AS p FROM ft GROUP BY 1, 2), pk AS (SELECT recording_id, max(p) AS p, arg_max(f, p) AS f FROM sp GROUP BY 1),
        q AS (SELECT sp.recording_id, any_value(pk.p) AS p, any_value(pk.f) AS f, max(sp.f) - min(sp.f) AS w FROM sp JOIN pk ON pk.recording_id = sp.recording_id AND sp.p >= pk.p / 2 GROUP BY 1)
        SELECT recording_id, 'peak_power' AS metric, {_r('p', 'value')} FROM q UNION ALL SELECT recording_id, 'peak_freq', {_r('f', 'value')} FROM q UNION ALL SELECT recording_id, 'q', {_r('CASE WHEN w > 0 THEN f / w END', 'value')} FROM q""")
add("t13_rhythm_scores", lambda s, d: rounded(rhythm_scores(s, d), 4))
add("t14_rhythm_against_noise", lambda s, d: rhythm_scores(s, d).groupBy("recording_id").agg(F.avg("z").alias("score"), F.count(F.when(F.col("passed"), 1)).alias("passes")).select("recording_id", F.round("score", 4).alias("score"), "passes", S.oscillator_class(F.col("score"), F.col("passes")).alias("cls")))
add("t15_representative_mean", lambda s, d: rounded(fx.explode_recordings(R.representative_signal(A(s, d), "mean", fx.FPS, 0.05, 0.5, 32))), "traces",
    f"""WITH m AS (SELECT recording_id, frame, avg(value) AS v FROM traces GROUP BY 1, 2) SELECT recording_id, frame, {_r('v - (regr_slope(v, frame) OVER w * frame + regr_intercept(v, frame) OVER w)', 'value')} FROM m WINDOW w AS (PARTITION BY recording_id)""")
add("t15_representative_pc1", lambda s, d: rounded(fx.explode_recordings(R.representative_signal(A(s, d), "pc1", fx.FPS, 0.05, 0.5, 32)), 5))
add("t15_representative_unit", lambda s, d: rounded(fx.explode_recordings(R.representative_signal(A(s, d), "median_unit", fx.FPS, 0.05, 0.5, 32)), 5))


def _sessions(s, d):
    """The largest hourly sum of each subject and session."""
    return fx.signals(s, d).groupBy("subject_id", "cond").agg(F.max("value").alias("value"))


QUARTILES = f"mx AS (SELECT subject_id, cond, max(value) AS v FROM sig GROUP BY 1, 2), vals AS (SELECT cond AS g, v FROM mx), {HAZEN.replace('0.05, 0.25, 0.5, 0.9', '0.25, 0.5, 0.75')}, qs AS (SELECT g, max(q) FILTER (p = 0.25) AS q25, max(q) FILTER (p = 0.5) AS q50, max(q) FILTER (p = 0.75) AS q75 FROM h GROUP BY 1)"
add("t17_paired_summary", lambda s, d: rounded(S.paired_summary(_sessions(s, d), "subject_id", "cond", "value", ["high", "mid", "low"], p=False)), "sig",
    f"""WITH {QUARTILES}, r AS (SELECT *, rank() OVER (PARTITION BY subject_id ORDER BY v) + (count(*) OVER (PARTITION BY subject_id, v) - 1) / 2.0 AS r FROM mx), c AS (SELECT cond, sum(r) AS s, count(*) AS n, sum(r * r) AS q FROM r GROUP BY 1),
        t AS (SELECT 2 * (sum(s * s) / max(n) - max(n) * 3 * 4) / (sum(q) / max(n) - 3 * 4) AS x FROM c) SELECT g AS cond, (SELECT count(*) FROM mx WHERE cond = g) AS n, {_r('q25', 'q25')}, {_r('q50', 'q50')}, {_r('q75', 'q75')}, format('friedman chi2={{:.3f}}', CAST(x AS DOUBLE)) AS test FROM qs, t""")
add("t17_two_conditions", lambda s, d: rounded(S.paired_summary(_sessions(s, d), "subject_id", "cond", "value", ["high", "low"], p=False)), "sig",
    f"""WITH {QUARTILES}, df AS (SELECT a.v - b.v AS dd FROM mx a JOIN mx b ON b.subject_id = a.subject_id AND a.cond = 'high' AND b.cond = 'low'), t AS (SELECT coalesce(sum(r) FILTER (dd > 0), 0) AS w FROM (SELECT dd, rank() OVER (ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY abs(dd)) - 1) / 2.0 AS r FROM df WHERE dd <> 0))
        SELECT g AS cond, (SELECT count(*) FROM mx WHERE cond = g) AS n, {_r('q25', 'q25')}, {_r('q50', 'q50')}, {_r('q75', 'q75')}, format('signed rank w={{:.1f}}', CAST(w AS DOUBLE)) AS test FROM qs, t WHERE g IN ('high', 'low')""")


def _fit(s, d):
    """Log of the amplitude against log of the hour of each event, subjects as random intercepts."""
    e = fx.event_train(s, d).filter("amp > 0 and frame >= 0").select("recording_id", F.log("amp").alias("y"), F.log1p("frame").alias("x"))
    return S.random_intercept(e, [], "recording_id", "x", "y").drop("n", "subjects").unpivot([], ["b0", "b1", "se", "z", "p", "ratio", "ll", "lr", "lr_p"], "term", "value")


add("t9_random_intercept", lambda s, d: rounded(_fit(s, d), 4))


def placed_levels(s, d):
    """Traces raised by their unit's place along x, with the time of each sample: recording_id, unit_id, x, y."""
    own = T(s, d).join(fx.positions(s, d).select("recording_id", "unit_id", F.col("x").alias("place")), ["recording_id", "unit_id"])
    return own.select("recording_id", "unit_id", (F.col("frame") / fx.FPS).alias("x"), (F.col("value") + F.col("place") / 200).alias("y"))


def _mixed_sql() -> str:
    """The passes of the search, each from the best ratio of the one before."""
    ctes = ["d AS (SELECT recording_id AS g, unit_id AS u, frame / 2.0 AS x, value + positions.x / 200 AS y FROM traces JOIN positions USING (recording_id, unit_id))",
            "ss AS (SELECT g, u, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM d WHERE y IS NOT NULL GROUP BY 1, 2)",
            "c0 AS (SELECT DISTINCT g, slope, CAST(-3 AS DOUBLE) AS t FROM ss, (SELECT unnest([true, false]) AS slope))"]
    for i in range(S._PASSES):
        ctes.append(f"""a{i} AS (SELECT g, slope, t, sum(n) AS n, count(*) AS subjects, sum(ln(1 + n * exp(t))) AS ld, sum(n - s * n * n) AS nn, sum(x - s * n * x) AS nx, sum(y - s * n * y) AS ny, sum(xx - s * x * x) AS xx, sum(xy - s * x * y) AS xy, sum(yy - s * y * y) AS yy
          FROM (SELECT *, exp(t) / (1 + n * exp(t)) AS s FROM (SELECT ss.*, slope, c.t + k * {S._STEP / S._SIDE**i!r} AS t FROM ss JOIN c{i} c USING (g), range({-S._SIDE}, {S._SIDE + 1}) q(k))) GROUP BY 1, 2, 3),
        b{i} AS (SELECT *, CASE WHEN slope THEN (nn * xy - nx * ny) / (nn * xx - nx * nx) ELSE 0 END AS b1 FROM a{i}), v{i} AS (SELECT *, (ny - b1 * nx) / nn AS b0, (yy - (ny - b1 * nx) / nn * ny - b1 * xy) / n AS var FROM b{i}),
        l{i} AS (SELECT *, -0.5 * (n * ln(2 * pi() * var) + ld + n) AS ll FROM v{i}), c{i + 1} AS (SELECT * FROM l{i} QUALIFY row_number() OVER (PARTITION BY g, slope ORDER BY round(ll, 8) DESC, t) = 1)""")
    last = f"c{S._PASSES}"
    return "WITH " + ", ".join(ctes) + f"""
      SELECT a.g AS recording_id, CAST(a.n AS BIGINT) AS n, a.subjects, round(a.b0, 5) + 0.0 AS b0, round(a.b1, 5) + 0.0 AS b1, round(sqrt(a.nn / (a.nn * a.xx - a.nx * a.nx) * a.var), 5) + 0.0 AS se,
        round(a.b1 / sqrt(a.nn / (a.nn * a.xx - a.nx * a.nx) * a.var), 5) + 0.0 AS z, round(exp(a.t), 5) + 0.0 AS ratio, round(a.ll, 5) + 0.0 AS ll, round(greatest(0.0, 2 * (a.ll - b.ll)), 5) + 0.0 AS lr
      FROM {last} a JOIN {last} b ON b.g = a.g AND a.slope AND NOT b.slope"""


add("t9_levels_by_place", lambda s, d: rounded(S.random_intercept(placed_levels(s, d), ["recording_id"], "unit_id", "x", "y", p=False), 5), "traces positions", _mixed_sql())
