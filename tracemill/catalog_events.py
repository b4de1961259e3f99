"""Registered queries of events, trials, tests and whole plans, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .catalog_core import HAZEN, PEAKS, RUNS, UNITW, _r, rounded, with_
from .catalog_pairs import EF, PERI, PERM, PERMUTED, RANKS, SE, SHUFFLES, THOUSAND, event_frames, peri, permuted_ranks, trace_events
from .operators import events as E
from .operators import joins as J
from .operators import signal as R
from .operators import sorts as K
from .operators import stats as S
from .plans import behaviour, low_high
from .sources import fixtures as fx
from .sources.staging import staged

QUERIES: dict = {}
ORACLE_SQL: dict = {}
T = fx.traces


def add(name: str, fn, fixtures: str = "", sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = with_(fixtures, sql.strip()) if fixtures else sql.strip()


SR = """rk AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY g, abs(dd)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY g, abs(dd)) AS t FROM df WHERE dd <> 0),
  st AS (SELECT g, count(*) AS n, coalesce(sum(r) FILTER (dd > 0), 0) AS w, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM rk GROUP BY 1), md AS (SELECT g, median(dd) AS median FROM df GROUP BY 1 HAVING count(*) >= 2)"""
add("e1_stim_class_split", lambda s, d: E.stim_class_split(event_frames(s, d)), "ev",
    f"""WITH {EF} SELECT recording_id, frame, CASE b WHEN 0 THEN 'light' WHEN 1 THEN 'tap' ELSE 'lighttap' END AS stim FROM (SELECT *, floor((k - 1) / floor(n / 3)) AS b FROM (
          SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM ef) WHERE n >= 5) WHERE b < 3""")
add("e2_stim_class", lambda s, d: fx.event_train(s, d).select("event_id", E.stim_class((F.col("event_id") % 4).cast("string")).alias("stim")), "ev",
    "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'light' WHEN 2 THEN 'tap' WHEN 3 THEN 'lighttap' END AS stim FROM ev")
add("e3_mad_scores", lambda s, d: rounded(E.mad_scores(T(s, d)).select("recording_id", "unit_id", "frame", "z")), "traces",
    f"""WITH m AS (SELECT recording_id, unit_id, median(value) AS med, mad(value) AS mad, stddev_samp(value) AS sd FROM traces GROUP BY ALL)
        SELECT t.recording_id, t.unit_id, t.frame, {_r('(value - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END', 'z')} FROM traces t JOIN m ON m.recording_id = t.recording_id AND m.unit_id = t.unit_id""")
Z_SQL = """SELECT t.recording_id, t.unit_id, t.frame, (value - med) / CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1 END AS v FROM traces t JOIN (SELECT recording_id, unit_id, median(value) AS med, mad(value) AS mad, stddev_samp(value) AS sd FROM traces GROUP BY 1, 2) m ON m.recording_id = t.recording_id AND m.unit_id = t.unit_id"""
add("e3_mad_events", lambda s, d: rounded(E.mad_events(fx.trace_arrays(s, d), fx.FPS, 1.0, 1.0, 2.0, 0.5, 1.5, digits=6).select("recording_id", "unit_id", "frame", "value")), "traces",
    "WITH RECURSIVE f AS (" + PEAKS.format(src=Z_SQL, height=1.0, prominence=1.0, distance=4) + f"""), o AS (SELECT recording_id, unit_id, value, row_number() OVER (PARTITION BY recording_id, unit_id ORDER BY value) AS i, count(*) OVER (PARTITION BY recording_id, unit_id) AS n, lead(value) OVER (PARTITION BY recording_id, unit_id ORDER BY value) AS nx FROM f),
      q AS (SELECT recording_id, unit_id, value + coalesce((least(greatest(0.5 * n + 0.5, 1), n) - i) * (nx - value), 0) AS q FROM o WHERE floor(least(greatest(0.5 * n + 0.5, 1), n)) = i)
      SELECT f.recording_id, f.unit_id, f.frame, {_r('value', 'value')} FROM f JOIN q ON q.recording_id = f.recording_id AND q.unit_id = f.unit_id WHERE value >= greatest(q, 1.5)""")


def _counted(s, d):
    return E.unit_events_in_window(fx.positions(s, d), T(s, d).filter("value > 0.2"), 8, 39, 16.0)


add("e4_active_share", lambda s, d: rounded(E.active_share(_counted(s, d))), "traces positions",
    f"""WITH u AS (SELECT p.recording_id, p.unit_id, count(t.value) AS n, sum(t.value) AS total FROM positions p LEFT JOIN traces t ON t.recording_id = p.recording_id AND t.unit_id = p.unit_id AND t.value > 0.2 AND t.frame BETWEEN 8 AND 39 GROUP BY 1, 2)
        SELECT recording_id, count(*) AS units, CAST(sum(n) AS BIGINT) AS total, {_r('avg(CAST(n > 0 AS DOUBLE))', 'active')}, {_r('avg(n / 16.0)', 'rate')}, {_r('median(n / 16.0)', 'rate_median')}, {_r('sum(total) / sum(n)', 'amplitude')} FROM u GROUP BY 1""")
add("e4_unit_events_in_window", lambda s, d: rounded(E.unit_events_in_window(fx.positions(s, d), T(s, d).filter("value > 0.2"), 8, 39, 16.0)), "traces positions",
    f"""SELECT p.recording_id, p.unit_id, count(t.value) AS n, {_r('count(t.value) / 16.0', 'rate')}, {_r('avg(t.value)', 'amplitude')} FROM positions p LEFT JOIN traces t ON t.recording_id = p.recording_id AND t.unit_id = p.unit_id AND t.value > 0.2 AND t.frame BETWEEN 8 AND 39 GROUP BY ALL""")
add("e8_run_features", lambda s, d: rounded(E.run_features(T(s, d).withColumn("active", F.col("value") > 0), "active", fx.FPS)), "traces",
    f"""WITH {RUNS}, i AS (SELECT recording_id, unit_id, CAST(run AS BIGINT) AS run, g.frame, value, (g.frame - lag(g.frame) OVER w) * (value + lag(value) OVER w) / 2 AS part FROM g JOIN traces t USING (recording_id, unit_id, frame) WHERE active WINDOW w AS (PARTITION BY recording_id, unit_id, run ORDER BY g.frame))
        SELECT recording_id, unit_id, run, min(frame) AS start, max(frame) AS "end", {_r('count(*) / 2.0', 'duration')}, {_r('max(value)', 'peak')}, {_r('coalesce(sum(part), 0) / 2', 'area')} FROM i GROUP BY ALL""")


def phases(s, d):
    return peri(s, d).withColumn("phase", F.col("value") * 12)


ITPC = "it AS (SELECT recording_id, unit_id, lag, sqrt(pow(avg(cos(value * 12)), 2) + pow(avg(sin(value * 12)), 2)) AS itpc, count(*) AS n FROM pe GROUP BY ALL)"
add("e10_itpc", lambda s, d: rounded(E.itpc(phases(s, d))), "traces ev", f"WITH {SE}, {PERI}, {ITPC} SELECT recording_id, unit_id, lag, {_r('itpc', 'itpc')}, n FROM it")
add("e10_reset_strength", lambda s, d: rounded(E.reset_strength(E.itpc(phases(s, d)), (-6, -1), (1, 6), (0, 6))), "traces ev",
    f"WITH {SE}, {PERI}, {ITPC} SELECT recording_id, unit_id, {_r('avg(itpc) FILTER (lag BETWEEN -6 AND -1)', 'pre')}, {_r('avg(itpc) FILTER (lag BETWEEN 1 AND 6)', 'post')}, {_r('max(itpc) FILTER (lag BETWEEN 0 AND 6) - avg(itpc) FILTER (lag BETWEEN -6 AND -1)', 'reset')} FROM it GROUP BY 1, 2")


def real_peri(s, d):
    """Phases of the band-passed traces around the events."""
    key = ["recording_id", "unit_id"]
    z = R.analytic_signal(R.bandpass(fx.trace_arrays(s, d), fx.FPS, 0.05, 0.5))
    return J.peri_event(z.select(*key, F.col("phase").alias("trace")), trace_events(s, d), 6, 6).withColumnRenamed("value", "phase")


add("e10_reset_of_bandpassed", lambda s, d: rounded(E.reset_strength(E.itpc(real_peri(s, d)), (-6, -1), (1, 6), (0, 6)), 5))
RESET = "rs AS (SELECT recording_id, unit_id, avg(itpc) FILTER (lag BETWEEN -6 AND -1) AS pre, avg(itpc) FILTER (lag BETWEEN 1 AND 6) AS post, max(itpc) FILTER (lag BETWEEN 0 AND 6) - avg(itpc) FILTER (lag BETWEEN -6 AND -1) AS reset FROM it GROUP BY 1, 2)"


def resets(s, d):
    return E.reset_strength(E.itpc(phases(s, d)), (-6, -1), (1, 6), (0, 6))


add("k4_reset_order", lambda s, d: K.position_in_order(resets(s, d).withColumn("reset", F.round("reset", 9)), ["recording_id"], -F.col("reset"), [F.desc("reset"), F.col("unit_id")]).select("recording_id", "unit_id", "place"), "traces ev",
    f"WITH {SE}, {PERI}, {ITPC}, {RESET} SELECT recording_id, unit_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY round(reset, 9) DESC, unit_id) - 1 AS INTEGER) AS place FROM rs")


def _curves(s, d):
    """Coherence curves on times of their own, further apart from one recording to the next."""
    return E.itpc(phases(s, d)).select("recording_id", "unit_id", (F.col("lag") / 2.0 * (1 + F.col("recording_id") * 0.1)).alias("t"), F.col("itpc").alias("value"))


add("e12_pool_on_common_time", lambda s, d: rounded(E.pool_on_common_time(_curves(s, d))), "traces ev",
    f"""WITH {SE}, {PERI}, {ITPC}, k AS (SELECT recording_id, unit_id, lag / 2.0 * (1 + recording_id * 0.1) AS t, itpc AS v FROM it), g AS (SELECT DISTINCT t FROM k WHERE recording_id = (SELECT min(recording_id) FROM k)),
        n AS (SELECT *, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM k WINDOW w AS (PARTITION BY recording_id, unit_id ORDER BY t)), u AS (SELECT DISTINCT recording_id, unit_id FROM k)
        SELECT u.recording_id, u.unit_id, {_r('g.t', 't')}, {_r('CASE WHEN n.t = g.t THEN n.v ELSE n.v + (n.nv - n.v) * (g.t - n.t) / (n.nt - n.t) END', 'value')} FROM u CROSS JOIN g LEFT JOIN n ON n.recording_id = u.recording_id AND n.unit_id = u.unit_id AND g.t >= n.t AND (g.t < n.nt OR (n.nt IS NULL AND g.t = n.t))""")
add("e11_peri_average", lambda s, d: rounded(E.peri_average(peri(s, d))), "traces ev", f"WITH {SE}, {PERI} SELECT recording_id, unit_id, lag, {_r('avg(value)', 'mean')} FROM pe GROUP BY 1, 2, 3")


def arithmetic_phases(s, d):
    """Each trace with twelve times its values as its phase."""
    return fx.trace_arrays(s, d).withColumn("phase", F.transform("trace", lambda x: x * 12))


def event_curves(s, d):
    return E.event_curves(arithmetic_phases(s, d), trace_events(s, d), fx.FPS, 6, 6, (-6, -1), (1, 6), (0, 6))


_NEAR = {i: math.exp(-0.5 * (i / 0.6) ** 2) for i in (-1, 0, 1)}
FREQ = f"""fq AS (SELECT recording_id, unit_id, frame, value, (dd - 2 * pi() * round(dd / (2 * pi()))) / pi() AS f FROM (SELECT *, value * 12 - lag(value * 12) OVER {UNITW}) AS dd FROM traces)),
  fs AS (SELECT recording_id, unit_id, frame, value, ({' + '.join(f'coalesce(lead(f, {i}) OVER {UNITW}) * {g}, 0)' for i, g in _NEAR.items())}) / ({' + '.join(f'CASE WHEN lead(f, {i}) OVER {UNITW}) IS NULL THEN 0 ELSE {g} END' for i, g in _NEAR.items())}) AS f FROM fq),
  fe AS (SELECT t.recording_id, t.unit_id, t.frame - e.frame AS lag, value, f FROM fs t JOIN se e ON t.recording_id = e.recording_id AND t.frame BETWEEN e.frame - 6 AND e.frame + 6 WHERE e.frame >= 6 AND e.frame + 6 < 64)"""
add("e11_event_curves", lambda s, d: rounded(E.long_event_curves(event_curves(s, d), 6)), "traces ev",
    f"""WITH {SE}, {FREQ} SELECT recording_id, unit_id, lag, {_r('sqrt(pow(avg(cos(value * 12)), 2) + pow(avg(sin(value * 12)), 2))', 'itpc')}, {_r('avg(f)', 'freq')}, {_r('avg(value)', 'mean')} FROM fe GROUP BY 1, 2, 3""")
add("e11_event_frequency", lambda s, d: rounded(event_curves(s, d).select("recording_id", "unit_id", "pre_freq", "post_freq", "delta_freq")), "traces ev",
    f"""WITH {SE}, {FREQ}, g AS (SELECT recording_id, unit_id, avg(f) FILTER (lag BETWEEN -6 AND -1) AS a, avg(f) FILTER (lag BETWEEN 1 AND 6) AS b FROM fe GROUP BY 1, 2) SELECT recording_id, unit_id, {_r('a', 'pre_freq')}, {_r('b', 'post_freq')}, {_r('b - a', 'delta_freq')} FROM g""")
add("e11_bandpassed_curves", lambda s, d: rounded(E.event_curves(E.phase_signals(fx.trace_arrays(s, d), fx.FPS, 0.05, 0.5), trace_events(s, d), fx.FPS, 6, 6, (-6, -1), (1, 6), (0, 6)).drop("itpc", "freq", "mean"), 5))
add("e13_subject_rollup", lambda s, d: rounded(E.subject_rollup(fx.positions(s, d), F.col("recording_id") % 3, "x")), "positions", f"SELECT recording_id % 3 AS subject_id, {_r('median(x)', 'median')}, count(x) AS n FROM positions GROUP BY 1")
add("e19_trial_extract", lambda s, d: rounded(E.trial_extract(fx.trace_arrays(s, d), trace_events(s, d), 6, 6)), "traces ev",
    f"WITH {SE}, {PERI}, o AS (SELECT recording_id, frame, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY frame) - 1 AS INTEGER) AS trial FROM se) SELECT pe.recording_id, unit_id, trial, lag AS rel_frame, {_r('value', 'value')} FROM pe JOIN o ON o.recording_id = pe.recording_id AND o.frame = event")
TPC = "tp AS (SELECT a.subject_id, a.unit_id, a.trial AS a, b.trial AS b, corr(a.value, b.value) AS r FROM trials a JOIN trials b USING (subject_id, unit_id, rel_frame) WHERE a.trial < b.trial GROUP BY 1, 2, 3, 4)"
CLIPR = "tanh(avg(atanh(least(greatest(r, -0.999999), 0.999999))))"
LOO = "lo AS (SELECT subject_id, unit_id, avg(r) AS others FROM (SELECT subject_id, unit_id, trial, corr(value, o) AS r FROM (SELECT *, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS o FROM trials WINDOW w AS (PARTITION BY subject_id, unit_id, rel_frame)) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
add("e14_trial_reliability", lambda s, d: rounded(E.trial_reliability(E.usable_trials(fx.trials(s, d), 8))), "trials",
    f"WITH {TPC}, {LOO} SELECT subject_id, unit_id, {_r(CLIPR, 'fisher')}, {_r('median(r)', 'median')}, {_r('any_value(others)', 'others')} FROM tp JOIN lo USING (subject_id, unit_id) GROUP BY 1, 2")


def scored_pairs(s, d):
    """Trial pairs with a p value by an arithmetic rule, so that any engine agrees."""
    return E.trial_pair_corr(fx.trials(s, d)).withColumn("p", F.pow(1 - F.abs("r"), 3))


FDR = """ks AS (SELECT *, max(CASE WHEN p <= i * 0.05 / m THEN i END) OVER (PARTITION BY subject_id, unit_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, unit_id ORDER BY p) AS i, count(*) OVER (PARTITION BY subject_id, unit_id) AS m FROM (SELECT *, pow(1 - abs(r), 3) AS p FROM tp)))"""
add("e15_significant_reliability", lambda s, d: rounded(E.significant_reliability(scored_pairs(s, d))), "trials", f"WITH {TPC}, {FDR} SELECT subject_id, unit_id, {_r(CLIPR, 'fisher')}, count(*) AS kept FROM ks WHERE i <= k GROUP BY 1, 2")
add("e16_real_vs_random", lambda s, d: rounded(E.significant_reliability(scored_pairs(s, d)).withColumn("train", F.lit("real")).unionByName(
    E.significant_reliability(E.trial_pair_corr(fx.trials(s, d).withColumn("rel_frame", (F.col("rel_frame") + F.col("trial")) % 8)).withColumn("p", F.pow(1 - F.abs("r"), 3))).withColumn("train", F.lit("random")))), "trials",
    f"""WITH {TPC}, {FDR}, rd AS (SELECT subject_id, unit_id, trial, (rel_frame + trial) % 8 AS rel_frame, value FROM trials), {TPC.replace('tp AS', 'tr AS').replace('FROM trials', 'FROM rd').replace('JOIN trials', 'JOIN rd')}, {FDR.replace('ks AS', 'kr AS').replace('FROM tp', 'FROM tr')}
        SELECT subject_id, unit_id, {_r(CLIPR, 'fisher')}, count(*) AS kept, 'real' AS train FROM ks WHERE i <= k GROUP BY 1, 2 UNION ALL SELECT subject_id, unit_id, round({CLIPR}, 6) + 0.0, count(*), 'random' FROM kr WHERE i <= k GROUP BY 1, 2""")


def _block(s, d, low, high):
    return fx.trials(s, d).filter(F.col("trial").between(low, high)).groupBy("subject_id", "unit_id", "rel_frame").agg(F.avg("value").alias("value"))


add("e17_split_reliability", lambda s, d: rounded(E.split_reliability(_block(s, d, 0, 3), _block(s, d, 4, 7), SHUFFLES)), "trials positions",
    f"""WITH f AS (SELECT subject_id, unit_id, rel_frame, avg(value) AS v FROM trials WHERE trial < 4 GROUP BY ALL), g AS (SELECT subject_id, unit_id, rel_frame, avg(value) AS v FROM trials WHERE trial >= 4 GROUP BY ALL), {PERM},
        o AS (SELECT subject_id, unit_id, corr(f.v, g.v) AS r FROM f JOIN g USING (subject_id, unit_id, rel_frame) GROUP BY 1, 2),
        n AS (SELECT subject_id, unit_id, avg(r) AS null_r FROM (SELECT f.subject_id, f.unit_id, seed, corr(f.v, g.v) AS r FROM f JOIN pm ON pm.recording_id = f.subject_id AND pm.unit_id = f.unit_id JOIN g ON g.subject_id = f.subject_id AND g.unit_id = pm.other AND g.rel_frame = f.rel_frame GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT subject_id, unit_id, {_r('r', 'r')}, {_r('null_r', 'null_r')} FROM o LEFT JOIN n USING (subject_id, unit_id)""")
add("e18_responsive_units", lambda s, d: rounded(E.responsive_units(fx.trials(s, d), 4, 0.3)), "trials",
    f"""SELECT subject_id, unit_id, {_r('base', 'base')}, {_r('stim', 'stim')}, CASE WHEN stim > base + 0.3 * sd THEN 1 WHEN stim < base - 0.3 * sd THEN -1 ELSE 0 END AS response FROM (
        SELECT subject_id, unit_id, avg(value) FILTER (rel_frame < 4) AS base, stddev_samp(value) FILTER (rel_frame < 4) AS sd, avg(value) FILTER (rel_frame >= 4) AS stim FROM trials GROUP BY 1, 2)""")
add("e18_signrank", lambda s, d: rounded(E.responsive_by_signrank(fx.trials(s, d), 4, p=False)), "trials",
    f"""WITH bs AS (SELECT subject_id, unit_id, trial, avg(value) FILTER (rel_frame >= 4) - avg(value) FILTER (rel_frame < 4) AS dd FROM trials GROUP BY 1, 2, 3), df AS (SELECT (subject_id, unit_id) AS g, dd FROM bs WHERE dd IS NOT NULL),
        {{SR}} SELECT md.g[1] AS subject_id, md.g[2] AS unit_id, {_r('median', 'median')}, n, {_r('w', 'w')}, ties FROM md LEFT JOIN st ON st.g = md.g""".replace("{SR}", SR))
# eight trials without ties: the exact test is significant at 5 % up to a sum of 3
add("e18_signrank_response", lambda s, d: E.responsive_by_signrank(fx.trials(s, d), 4).select("subject_id", "unit_id", "response"), "trials",
    f"""WITH bs AS (SELECT subject_id, unit_id, trial, avg(value) FILTER (rel_frame >= 4) - avg(value) FILTER (rel_frame < 4) AS dd FROM trials GROUP BY 1, 2, 3), df AS (SELECT (subject_id, unit_id) AS g, dd FROM bs WHERE dd IS NOT NULL),
        {{SR}} SELECT md.g[1] AS subject_id, md.g[2] AS unit_id, CASE WHEN least(w, 36 - w) <= 3 THEN CAST(sign(median) AS INTEGER) ELSE 0 END AS response FROM md LEFT JOIN st ON st.g = md.g""".replace("{SR}", SR))
QC = """md AS (SELECT subject_id, median(value) AS med, mad(value) AS mad FROM sig GROUP BY 1), o AS (SELECT s.*, value > med + 1.0 * greatest(mad, 1e-10) AS act FROM sig s JOIN md USING (subject_id)),
  g AS (SELECT *, sum(CAST(act AND NOT coalesce(was, false) AS INTEGER)) OVER (PARTITION BY subject_id, cond ORDER BY frame) AS run FROM (SELECT *, lag(act) OVER (PARTITION BY subject_id, cond ORDER BY frame) AS was FROM o)),
  r AS (SELECT subject_id, cond, count(*) AS bouts, sum(len) AS frames FROM (SELECT subject_id, cond, run, count(*) AS len FROM g WHERE act GROUP BY ALL) WHERE len >= 2 GROUP BY 1, 2),
  ar AS (SELECT subject_id, cond, sum(p) AS integral FROM (SELECT subject_id, cond, (frame - lag(frame) OVER w) * (value + lag(value) OVER w) / 2 AS p FROM sig WINDOW w AS (PARTITION BY subject_id, cond ORDER BY frame)) GROUP BY 1, 2),
  vals AS (SELECT subject_id || cond AS g, value AS v FROM sig)"""
add("e20_quantify_by_condition", lambda s, d: rounded(E.quantify_by_condition(fx.signals(s, d), 1.0, 2, 1.0), 4), "sig",
    f"""WITH {QC}, {HAZEN.replace('0.05, 0.25, 0.5, 0.9', '0.95')} SELECT s.subject_id, s.cond, round(avg(value), 4) + 0.0 AS mean, round(any_value(q), 4) + 0.0 AS p95, round(coalesce(any_value(frames), 0) / count(*), 4) + 0.0 AS active,
          round(coalesce(any_value(bouts), 0) * 60.0 / count(*), 4) + 0.0 AS bouts_per_min, round(any_value(integral), 4) + 0.0 AS integral
        FROM sig s JOIN h ON h.g = s.subject_id || s.cond JOIN ar USING (subject_id, cond) LEFT JOIN r USING (subject_id, cond) GROUP BY 1, 2""")
QM = QC.replace("md AS (SELECT subject_id, median(value) AS med, mad(value) AS mad FROM sig GROUP BY 1)", "sm AS (SELECT subject_id, cond, frame, avg(abs(value)) OVER (PARTITION BY subject_id, cond ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value FROM sig), md AS (SELECT subject_id, cond, median(value) AS med, mad(value) AS mad FROM sm GROUP BY 1, 2)", 1)
QM = QM.replace("FROM sig s JOIN md USING (subject_id)", "FROM sm s JOIN md USING (subject_id, cond)").replace("FROM sig WINDOW", "FROM sm WINDOW").replace("AS v FROM sig)", "AS v FROM sm)")
add("e20_movement_by_condition", lambda s, d: rounded(E.quantify_by_condition(E.movement(fx.signals(s, d), 1.0, 3.0), 1.0, 2, 1.0, pooled=False), 6), "sig",
    f"""WITH {QM}, {HAZEN.replace('0.05, 0.25, 0.5, 0.9', '0.95')} SELECT s.subject_id, s.cond, round(avg(value), 6) + 0.0 AS mean, round(any_value(q), 6) + 0.0 AS p95, round(coalesce(any_value(frames), 0) / count(*), 6) + 0.0 AS active,
          round(coalesce(any_value(bouts), 0) * 60.0 / count(*), 6) + 0.0 AS bouts_per_min, round(any_value(integral), 6) + 0.0 AS integral
        FROM sm s JOIN h ON h.g = s.subject_id || s.cond JOIN ar USING (subject_id, cond) LEFT JOIN r USING (subject_id, cond) GROUP BY 1, 2""")
add("e23_oscillator_core", lambda s, d: rounded(E.oscillator_core(T(s, d), fx.positions(s, d).select("recording_id", "unit_id", (F.col("unit_id") * 37 % 128 / 1000.0).alias("dom")), 0.01, 0.02)), "traces positions",
    f"""SELECT recording_id, frame, {_r('coalesce(avg(value) FILTER ((unit_id * 37) % 128 BETWEEN 10 AND 20), avg(value))', 'core')} FROM traces GROUP BY 1, 2""")
add("s_beats_to_bouts", lambda s, d: E.beats_to_bouts(event_frames(s, d), 2), "ev",
    f"""WITH {EF}, g AS (SELECT *, sum(CAST(coalesce(frame - p > 2, true) AS INTEGER)) OVER (PARTITION BY recording_id ORDER BY frame) AS bout FROM (SELECT *, lag(frame) OVER (PARTITION BY recording_id ORDER BY frame) AS p FROM ef))
        SELECT recording_id, CAST(bout AS BIGINT) AS bout, min(frame) AS start, max(frame) AS "end", count(*) AS beats FROM g GROUP BY 1, 2""")
add("r26_response_latency", lambda s, d: E.response_latency(fx.event_train(s, d).filter("kind = 'error'").select("recording_id", "frame").distinct(), fx.event_train(s, d).filter("kind = 'click'").select("recording_id", "frame").distinct(), 1), "ev",
    """WITH a AS (SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'error'), b AS (SELECT DISTINCT recording_id, frame AS f FROM ev WHERE kind = 'click')
       SELECT recording_id, frame, CASE WHEN dd <= 1 THEN dd END AS latency, coalesce(dd <= 1, false) AS responded FROM (SELECT a.recording_id, a.frame, min(f) - a.frame AS dd FROM a LEFT JOIN b ON b.recording_id = a.recording_id AND f >= a.frame GROUP BY 1, 2)""")



def split_errors_events(s, d):
    """Error events of each recording in three classes by their order."""
    return E.stim_class_split(fx.event_train(s, d).filter("kind = 'error'").select("recording_id", "frame").distinct())


def latencies(s, d):
    kind = lambda k: fx.event_train(s, d).filter(F.col("kind") == k).select("recording_id", "frame").distinct()
    return E.response_latency(kind("error"), kind("click"), 1)


SPLIT = "{0} AS (SELECT recording_id, frame, CASE b WHEN 0 THEN 'light' WHEN 1 THEN 'tap' ELSE 'lighttap' END AS stim FROM (SELECT *, floor((k - 1) / floor(n / 3)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM {1}) WHERE n >= 5) WHERE b < 3)"
add("r26_responder_shares", lambda s, d: rounded(E.responder_shares(latencies(s, d), split_errors_events(s, d))), "ev",
    f"""WITH a AS (SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'error'), b AS (SELECT DISTINCT recording_id, frame AS f FROM ev WHERE kind = 'click'), {SPLIT.format('st', 'a')},
        l AS (SELECT a.recording_id, a.frame, min(f) - a.frame AS dd FROM a LEFT JOIN b ON b.recording_id = a.recording_id AND f >= a.frame GROUP BY 1, 2)
        SELECT l.recording_id, stim, count(*) AS trials, count(*) FILTER (dd <= 1) AS responded, {_r('count(*) FILTER (dd <= 1) / count(*)', 'share')}, {_r('avg(dd) FILTER (dd <= 1)', 'latency')} FROM l JOIN st ON st.recording_id = l.recording_id AND st.frame = l.frame GROUP BY 1, 2""")

#: Points of the grid of transitions along each axis.
BINS = 1000


def scaled(s, d):
    """Traces in widths of their noise."""
    return E.scaled_by_noise(fx.trace_arrays(s, d), E.baseline_noise(fx.trace_arrays(s, d)))


def scaled_by_sd(s, d):
    """Traces around their mean in sds, which any engine can work out."""
    noise = T(s, d).groupBy("recording_id", "unit_id").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sigma"))
    return E.scaled_by_noise(fx.trace_arrays(s, d), noise)


SCALED = """sc AS (SELECT recording_id, unit_id, frame, (value - mu) / sd AS x FROM traces JOIN (SELECT recording_id, unit_id, avg(value) AS mu, stddev_samp(value) AS sd FROM traces GROUP BY 1, 2) USING (recording_id, unit_id) WHERE sd > 0),
  tr AS (SELECT recording_id, unit_id, frame, x, lead(x) OVER (PARTITION BY recording_id, unit_id ORDER BY frame) AS y FROM sc), gr AS (SELECT recording_id, floor(min(x)) AS lo, ceil(max(x)) AS hi FROM sc GROUP BY 1)"""
add("e5_baseline_noise", lambda s, d: rounded(E.baseline_noise(fx.trace_arrays(s, d)).drop("error"), 5))
add("e6_transition_counts", lambda s, d: E.transition_counts(scaled_by_sd(s, d), BINS), "traces",
    f"WITH {SCALED} SELECT recording_id, CAST(floor((x - lo) / (hi - lo) * {BINS - 1} + 0.5) AS INTEGER) AS gi, CAST(floor((y - lo) / (hi - lo) * {BINS - 1} + 0.5) AS INTEGER) AS gj, count(*) AS n FROM tr JOIN gr USING (recording_id) WHERE y IS NOT NULL GROUP BY 1, 2, 3")
add("e6_noise_covariance", lambda s, d: rounded(E.noise_covariance(scaled_by_sd(s, d))), "traces", f"WITH {SCALED} SELECT recording_id, {_r('coalesce(covar_samp(x, y), 0)', 'covariance')} FROM tr WHERE x < 0 AND y < 0 GROUP BY 1")


def maps(own):
    return E.odds_maps(own, fx.FPS, BINS)


def significant_cells(s, d):
    own = scaled(s, d)
    return E.significant_cells(E.transition_counts(own, BINS), maps(own), BINS)


def transient_flags(s, d):
    """(recording_id, unit_id, trace): 1.0 at frames of significant transients, else 0.0."""
    own = scaled(s, d)
    return E.significant_transients(own, maps(own), BINS)


def transients(s, d):
    """Frames of significant transients."""
    on = transient_flags(s, d).select("recording_id", "unit_id", F.posexplode("trace").alias("frame", "flag"))
    return on.filter("flag > 0").select("recording_id", "unit_id", "frame")


def raster(s, d):
    """Traces with their significant transients: recording_id, unit_id, frame, value, on. Staged, as the features of events read it many times."""
    flags = transient_flags(s, d).withColumnRenamed("trace", "flags")
    both = fx.trace_arrays(s, d).join(flags, ["recording_id", "unit_id"]).select("recording_id", "unit_id", F.arrays_zip("trace", "flags").alias("samples"))
    rows = staged(s, both, "transients").select("recording_id", "unit_id", F.posexplode("samples").alias("frame", "sample"))
    return rows.select("recording_id", "unit_id", "frame", F.col("sample.trace").alias("value"), (F.col("sample.flags") > 0).alias("on"))


add("e6_significant_cells", significant_cells)
add("e7_significant_transients", transients)

# low against high windows


def picked(s, d):
    return low_high.low_high_windows(trace_events(s, d), 64, 24, 8)


def simple_raster(s, d):
    """Frames above 0.1, which any engine can tell."""
    return T(s, d).withColumn("on", F.col("value") > 0.1)


def found_events(s, d, samples=simple_raster):
    return E.window_events(samples(s, d), picked(s, d), fx.FPS, 8)


def event_features(s, d, found=None):
    return E.unit_event_features(found_events(s, d) if found is None else found, fx.positions(s, d), picked(s, d), fx.FPS)


def transient_summary(s, d):
    found = found_events(s, d, raster)
    return E.event_summary(event_features(s, d, found), found)


PICKED = f"""{SE}, wins AS (SELECT recording_id, CAST(k * 8 AS INTEGER) AS start, CAST(k * 8 + 23 AS INTEGER) AS "end" FROM (SELECT DISTINCT recording_id FROM se), range(6) q(k)),
  counts AS (SELECT w.recording_id, w.start, w."end", count(e.frame) AS n FROM wins w LEFT JOIN se e ON e.recording_id = w.recording_id AND e.frame BETWEEN w.start AND w."end" GROUP BY ALL),
  picked AS (SELECT recording_id, 'low' AS label, n, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n, start) AS k FROM counts) WHERE k = 1
    UNION ALL SELECT recording_id, 'high', n, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, start) AS k FROM counts) WHERE k = 1)"""
EVENTS = f"""{PICKED}, el AS (SELECT t.recording_id, label, t.unit_id, frame, value, value > 0.1 AS act FROM traces t JOIN picked p ON p.recording_id = t.recording_id AND t.frame BETWEEN p.start AND p."end"),
  eg AS (SELECT *, sum(CAST(act AND NOT coalesce(was, false) AS INTEGER)) OVER w2 AS run FROM (SELECT *, lag(act) OVER w1 AS was FROM el WINDOW w1 AS (PARTITION BY recording_id, label, unit_id ORDER BY frame)) WINDOW w2 AS (PARTITION BY recording_id, label, unit_id ORDER BY frame)),
  ep AS (SELECT *, (value + lag(value) OVER (PARTITION BY recording_id, label, unit_id, run ORDER BY frame)) / 2 AS part FROM eg WHERE act),
  fe AS (SELECT recording_id, label, unit_id, run, count(*) / 2.0 AS duration, max(value) AS peak, coalesce(sum(part), 0) / 2 AS area FROM ep GROUP BY 1, 2, 3, 4),
  ft AS (SELECT u.recording_id, p.label, u.unit_id, count(run) AS n, count(run) / 12.0 AS rate, avg(peak) AS amp, avg(duration) AS dur, avg(area) AS auc FROM positions u JOIN picked p ON p.recording_id = u.recording_id LEFT JOIN fe ON fe.recording_id = u.recording_id AND fe.label = p.label AND fe.unit_id = u.unit_id GROUP BY 1, 2, 3)"""
NAMES = "traces positions ev"
add("e9_event_features", lambda s, d: rounded(event_features(s, d)), NAMES, f"WITH {EVENTS} SELECT recording_id, label, unit_id, n, {', '.join(_r(c, c) for c in ('rate', 'amp', 'dur', 'auc'))} FROM ft")
add("e9_event_summary", lambda s, d: rounded(E.event_summary(event_features(s, d), found_events(s, d))), NAMES,
    f"""WITH {EVENTS}, a AS (SELECT recording_id, label, avg(rate) AS rate, median(rate) AS rate_median, CAST(sum(n) AS BIGINT) AS total, avg(CAST(n > 0 AS DOUBLE)) AS active FROM ft GROUP BY 1, 2), b AS (SELECT recording_id, label, avg(peak) AS amp, avg(duration) AS dur, avg(area) AS auc FROM fe GROUP BY 1, 2)
        SELECT a.recording_id, a.label, {_r('rate', 'rate')}, {_r('rate_median', 'rate_median')}, total, {_r('active', 'active')}, {_r('amp', 'amp')}, {_r('dur', 'dur')}, {_r('auc', 'auc')} FROM a LEFT JOIN b ON b.recording_id = a.recording_id AND b.label = a.label""")


def activity_of_windows(s, d):
    return picked(s, d).select("recording_id", "label", F.col("n").cast("double").alias("activity"))


add("e9_change_correlation", lambda s, d: rounded(E.change_correlation(event_features(s, d), activity_of_windows(s, d), "rate", p=False)), NAMES,
    f"""WITH {EVENTS}, u AS (SELECT recording_id, unit_id, max(rate) FILTER (label = 'high') - max(rate) FILTER (label = 'low') AS dd FROM ft GROUP BY 1, 2), m AS (SELECT recording_id, median(dd) AS y FROM u GROUP BY 1), x AS (SELECT recording_id, max(n) FILTER (label = 'high') - max(n) FILTER (label = 'low') AS x FROM picked GROUP BY 1),
        r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x JOIN m USING (recording_id) WHERE x IS NOT NULL AND y IS NOT NULL) SELECT {_r('corr(rx, ry)', 'r')}, count(*) AS n FROM r""")
add("e9_pooled_active", lambda s, d: E.pooled_active_test(event_features(s, d)).drop("p"), NAMES,
    f"WITH {EVENTS} SELECT count(*) FILTER (label = 'low' AND n > 0) AS a, count(*) FILTER (label = 'low' AND n = 0) AS b, count(*) FILTER (label = 'high' AND n > 0) AS c, count(*) FILTER (label = 'high' AND n = 0) AS d FROM ft")
add("e9_transient_summary", lambda s, d: rounded(transient_summary(s, d), 5))
add("r25_trial_windows", lambda s, d: rounded(E.trial_windows(peri(s, d), 3)), "traces ev",
    f"WITH {SE}, {PERI} SELECT recording_id, unit_id, {_r('avg(value) FILTER (lag BETWEEN -3 AND -1)', 'base')}, {_r('avg(value) FILTER (lag BETWEEN 0 AND 2)', 'stim')}, {_r('avg(value) FILTER (lag BETWEEN 3 AND 5)', 'tone')} FROM pe GROUP BY 1, 2")

add("r25_condition_windows", lambda s, d: rounded(E.condition_windows(peri(s, d), E.stim_class_split(trace_events(s, d)), 3)), "traces ev",
    f"""WITH {SE}, {PERI}, {SPLIT.format('st', 'se')}, m AS (SELECT pe.recording_id, unit_id, stim, lag, avg(value) AS v, count(value) AS n FROM pe JOIN st ON st.recording_id = pe.recording_id AND st.frame = event GROUP BY 1, 2, 3, 4)
        SELECT recording_id, unit_id, stim, max(n) AS trials, {_r('avg(v) FILTER (lag BETWEEN -3 AND -1)', 'base')}, {_r('avg(v) FILTER (lag BETWEEN 0 AND 2)', 'stim_mean')}, {_r('avg(v) FILTER (lag BETWEEN 3 AND 5)', 'tone')} FROM m GROUP BY 1, 2, 3""")
add("k5_most_changed", lambda s, d: rounded(K.most_changed(event_features(s, d), 7)), NAMES,
    f"""WITH {EVENTS}, wd AS (SELECT recording_id, unit_id, max(dur) FILTER (label = 'high') - max(dur) FILTER (label = 'low') AS dd, max(auc) FILTER (label = 'high') - max(auc) FILTER (label = 'low') AS da, sum(n) AS ev FROM ft GROUP BY 1, 2),
        mo AS (SELECT recording_id, avg(dd) AS md, stddev_samp(dd) AS sd, avg(da) AS ma, stddev_samp(da) AS sa, count(*) AS nv FROM wd WHERE dd IS NOT NULL AND da IS NOT NULL GROUP BY 1),
        sc AS (SELECT wd.recording_id, unit_id, round(CASE WHEN nv IS NULL THEN ev WHEN dd IS NOT NULL AND da IS NOT NULL THEN CASE WHEN sd > 0 THEN (dd - md) / sd ELSE 0 END + CASE WHEN sa > 0 THEN (da - ma) / sa ELSE 0 END END, 9) AS score FROM wd LEFT JOIN mo ON mo.recording_id = wd.recording_id)
        SELECT recording_id, unit_id, {_r('score', 'score')}, place FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, unit_id) AS place FROM sc WHERE score IS NOT NULL) WHERE place <= 7""")

# tests
add("e9_paired_units", lambda s, d: rounded(E.paired_unit_tests(event_features(s, d), ["dur", "auc", "rate"], p=False)), NAMES,
    f"""WITH {EVENTS}, wd AS (SELECT recording_id, unit_id, {', '.join(f"max({c}) FILTER (label = 'high') - max({c}) FILTER (label = 'low') AS {c}" for c in ('dur', 'auc', 'rate'))} FROM ft GROUP BY 1, 2),
        df AS ({' UNION ALL '.join(f"SELECT (recording_id, '{c}') AS g, {c} AS dd FROM wd WHERE {c} IS NOT NULL" for c in ('dur', 'auc', 'rate'))}), {SR}
        SELECT md.g[1] AS recording_id, md.g[2] AS metric, {_r('median', 'median')}, n, {_r('w', 'w')}, ties FROM md LEFT JOIN st ON st.g = md.g""")
add("e9_pooled_tests", lambda s, d: rounded(E.pooled_event_tests(event_features(s, d), found_events(s, d), p=False), 5), NAMES,
    f"""WITH {EVENTS}, v AS (SELECT 'rate' AS metric, label, rate AS v FROM ft UNION ALL SELECT 'amp', label, peak FROM fe UNION ALL SELECT 'dur', label, duration FROM fe UNION ALL SELECT 'auc', label, area FROM fe),
        k AS (SELECT metric, label = 'low' AS one, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY metric, v) AS t FROM v),
        q AS (SELECT metric, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, sum(r) FILTER (one) AS w, sum(t * t - 1) AS ties FROM k GROUP BY 1), z AS (SELECT *, w - n1 * (n1 + n2 + 1) / 2 AS gap, n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM q)
        SELECT metric, n1, n2, round(w, 5) + 0.0 AS w, round(CASE WHEN var > 0 THEN (gap - 0.5 * sign(gap)) / sqrt(var) END, 5) + 0.0 AS z FROM z""")
SR0 = """rk0 AS (SELECT g, dd, rank() OVER (PARTITION BY g ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY g, abs(dd)) - 1) / 2.0 AS r FROM df0 WHERE dd <> 0), st0 AS (SELECT g, count(*) AS n, coalesce(sum(r) FILTER (dd > 0), 0) AS w FROM rk0 GROUP BY 1)"""
add("e13_subject_tests", lambda s, d: rounded(E.subject_tests(resets(s, d), F.col("recording_id") % 3, "pre", "post", p=False)), "traces ev",
    f"""WITH {SE}, {PERI}, {ITPC}, {RESET}, df AS (SELECT recording_id % 3 AS g, post - pre AS dd FROM rs), {SR}, df0 AS (SELECT recording_id % 3 AS g, post AS dd FROM rs), {SR0}, u AS (SELECT recording_id % 3 AS g, median(pre) AS before, median(post) AS after FROM rs GROUP BY 1)
        SELECT u.g AS subject_id, {_r('before', 'before')}, {_r('after', 'after')}, {_r('md.median', 'median')}, st.n, {_r('st.w', 'w')}, st.ties, st0.n AS n0, {_r('st0.w', 'w0')} FROM u LEFT JOIN md ON md.g = u.g LEFT JOIN st ON st.g = u.g LEFT JOIN st0 ON st0.g = u.g""")
add("t1_paired_signrank", lambda s, d: rounded(S.signrank(fx.positions(s, d), ["recording_id"], "x", "y", p=False)), "positions",
    f"WITH df AS (SELECT recording_id AS g, x - y AS dd FROM positions), {SR} SELECT md.g AS recording_id, {_r('median', 'median')}, n, {_r('w', 'w')}, ties FROM md LEFT JOIN st ON st.g = md.g")
add("t1_paired_signrank_p", lambda s, d: rounded(S.signrank(fx.positions(s, d), ["recording_id"], "x", "y")))
add("t2_signrank_vs_zero", lambda s, d: rounded(S.signrank(fx.positions(s, d).withColumn("v", F.col("x") - 18), ["recording_id"], "v", p=False)), "positions",
    f"WITH df AS (SELECT recording_id AS g, x - 18 AS dd FROM positions), {SR} SELECT md.g AS recording_id, {_r('median', 'median')}, n, {_r('w', 'w')}, ties FROM md LEFT JOIN st ON st.g = md.g")
add("t3_ranksum", lambda s, d: rounded(S.ranksum(fx.positions(s, d).withColumn("grp", F.when(F.col("unit_id") % 2 == 0, "a").otherwise("b")), ["recording_id"], "grp", "a", "x", p=False)), "positions",
    f"""WITH k AS (SELECT recording_id, unit_id % 2 = 0 AS one, rank() OVER (PARTITION BY recording_id ORDER BY x) + (count(*) OVER (PARTITION BY recording_id, x) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY recording_id, x) AS t FROM positions),
        q AS (SELECT recording_id, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2, sum(r) FILTER (one) AS w, sum(t * t - 1) AS ties FROM k GROUP BY 1), v AS (SELECT *, w - n1 * (n1 + n2 + 1) / 2 AS gap, n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM q)
        SELECT recording_id, n1, n2, {_r('w', 'w')}, {_r('CASE WHEN var > 0 THEN (gap - 0.5 * sign(gap)) / sqrt(var) END', 'z')} FROM v""")
add("t4_friedman", lambda s, d: rounded(S.friedman(fx.signals(s, d).groupBy("subject_id", "cond").agg(F.max("value").alias("v")), "subject_id", "cond", "v", 3, p=False)), "sig",
    f"""WITH m AS (SELECT subject_id, cond, max(value) AS v FROM sig GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY subject_id ORDER BY v) + (count(*) OVER (PARTITION BY subject_id, v) - 1) / 2.0 AS r FROM m),
        c AS (SELECT cond, sum(r) AS s, count(*) AS n, sum(r * r) AS q FROM r GROUP BY 1) SELECT max(n) AS n, {_r('2 * (sum(s * s) / max(n) - max(n) * 3 * 4) / (sum(q) / max(n) - 3 * 4)', 'chi2')} FROM c""")


def _p_values(s, d):
    return fx.positions(s, d).select("recording_id", "unit_id", ((F.col("unit_id") * 7919 % 10007 + 1) / 200000.0).alias("p"))


PV = "pv AS (SELECT recording_id, unit_id, ((unit_id * 7919) % 10007 + 1) / 200000.0 AS p FROM positions)"
add("t5_holm", lambda s, d: rounded(S.holm(_p_values(s, d), ["recording_id"], "p")), "positions",
    f"WITH {PV} SELECT recording_id, unit_id, {_r('p', 'p')}, {_r('least(1, max(st) OVER (PARTITION BY recording_id ORDER BY p ROWS UNBOUNDED PRECEDING))', 'p_holm')} FROM (SELECT *, p * (count(*) OVER (PARTITION BY recording_id) - row_number() OVER (PARTITION BY recording_id ORDER BY p) + 1) AS st FROM pv)")
add("t6_fdr_mask", lambda s, d: rounded(S.fdr_mask(_p_values(s, d), ["recording_id"], "p")), "positions",
    f"WITH {PV} SELECT recording_id, unit_id, {_r('p', 'p')}, coalesce(i <= k, false) AS significant FROM (SELECT *, max(CASE WHEN p <= i * 0.05 / m THEN i END) OVER (PARTITION BY recording_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY p) AS i, count(*) OVER (PARTITION BY recording_id) AS m FROM pv))")
add("t6_bonferroni_mask", lambda s, d: rounded(S.fdr_mask(_p_values(s, d), ["recording_id"], "p", method="bonferroni")), "positions", f"WITH {PV} SELECT recording_id, unit_id, {_r('p', 'p')}, p <= 0.05 / count(*) OVER (PARTITION BY recording_id) AS significant FROM pv")
add("t7_fisher_table", lambda s, d: S.fisher_table(fx.positions(s, d), ["recording_id"], F.col("x") < 15, F.col("y") < 10).drop("p"), "positions",
    "SELECT recording_id, count(*) FILTER (x < 15 AND y < 10) AS a, count(*) FILTER (x < 15 AND NOT y < 10) AS b, count(*) FILTER (NOT x < 15 AND y < 10) AS c, count(*) FILTER (NOT x < 15 AND NOT y < 10) AS d FROM positions GROUP BY 1")
add("t7_fisher_p", lambda s, d: rounded(S.fisher_table(fx.positions(s, d), ["recording_id"], F.col("x") < 15, F.col("y") < 10)))
add("t8_spearman", lambda s, d: rounded(S.correlation(fx.positions(s, d), ["recording_id"], "x", "y", True, p=False)), "positions", f"WITH {RANKS} SELECT recording_id, {_r('corr(ra, ro)', 'r')}, count(*) AS n FROM rn GROUP BY 1")
add("t8_pearson_p", lambda s, d: rounded(S.correlation(fx.positions(s, d), ["recording_id"], "x", "y")))
SHIFTED = """ob AS (SELECT recording_id, 'm' || frame AS metric, avg(value) AS value FROM traces GROUP BY 1, 2), su AS (SELECT recording_id, 'phase' AS kind, 'm' || ((frame + unit_id * 7) % 64) AS metric, value FROM traces UNION ALL SELECT recording_id, 'ar1', 'm' || ((unit_id - frame + 63) % 64), value FROM traces)"""


def shifted_scores(s, d):
    """Each frame's mean against the samples of all units shifted along time, by two arithmetic rules."""
    observed = T(s, d).groupBy("recording_id", F.concat(F.lit("m"), "frame").alias("metric")).agg(F.avg("value").alias("value"))
    shifts = (("phase", F.col("frame") + F.col("unit_id") * 7), ("ar1", F.col("unit_id") - F.col("frame") + 63))
    one, two = (T(s, d).select("recording_id", F.lit(kind).alias("kind"), F.concat(F.lit("m"), F.pmod(at, F.lit(64)).cast("string")).alias("metric"), "value") for kind, at in shifts)
    return S.surrogate_scores(observed, one.unionByName(two), ["m1"])


SCORES = f"""{SHIFTED}, vals AS (SELECT (recording_id, kind, metric) AS g, value AS v FROM su), {HAZEN.replace('0.05, 0.25, 0.5, 0.9', '0.05, 0.95')}, q AS (SELECT g, min(q) AS lo, max(q) AS hi FROM h GROUP BY 1), m AS (SELECT recording_id, kind, metric, avg(value) AS m, stddev_samp(value) AS s FROM su GROUP BY 1, 2, 3),
  sc AS (SELECT m.recording_id, m.kind, m.metric, CASE WHEN m.metric = 'm1' THEN -1 ELSE 1 END * CASE WHEN s > 0 THEN (value - m) / s END AS z, CASE WHEN m.metric = 'm1' THEN value < lo ELSE value > hi END AS passed FROM m JOIN ob ON ob.recording_id = m.recording_id AND ob.metric = m.metric JOIN q ON q.g = (m.recording_id, m.kind, m.metric))"""
add("t13_surrogate_scores", lambda s, d: rounded(shifted_scores(s, d)), "traces", f"WITH {SCORES} SELECT recording_id, kind, metric, {_r('z', 'z')}, passed FROM sc")
add("t14_oscillator_class", lambda s, d: shifted_scores(s, d).groupBy("recording_id").agg(F.round(F.avg("z") * 100, 4).alias("score"), F.count(F.when(F.col("z") > 0, 1)).alias("passes")).select("recording_id", "score", "passes", S.oscillator_class(F.col("score"), F.col("passes")).alias("cls")), "traces",
    f"""WITH {SCORES}, g AS (SELECT recording_id, round(avg(z) * 100, 4) AS score, count(*) FILTER (z > 0) AS passes FROM sc GROUP BY 1)
        SELECT recording_id, score, passes, CASE WHEN passes >= 8 AND score > 1.5 THEN '{S.OSCILLATOR}' WHEN passes >= 4 AND score > 0.5 THEN '{S.QUASI}' ELSE '{S.NOISE}' END AS cls FROM g""")
add("t16_stars_of_permutations", lambda s, d: permuted_ranks(s, d).select("recording_id", "axis", S.p_stars(F.col("p")).alias("stars")), "positions", f"WITH {RANKS}, {THOUSAND}, {PERMUTED} SELECT recording_id, axis, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM pp")
add("t16_p_stars", lambda s, d: _p_values(s, d).select("recording_id", "unit_id", S.p_stars(F.col("p")).alias("stars")), "positions", f"WITH {PV} SELECT recording_id, unit_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM pv")

# whole plans


def flagship(s, d):
    """Low against high windows of activity, compared per recording by a paired rank test on every unit's mean."""
    return rounded(low_high.compare(fx.gappy_arrays(s, d), picked(s, d), low_high.known_mean, 15, p=False))


QUERIES["plan_low_high"] = flagship
ORACLE_SQL["plan_low_high"] = with_("gappy ev", f"""WITH ef AS (SELECT DISTINCT recording_id, frame FROM ev WHERE frame < 64), wins AS (SELECT recording_id, CAST(k * 8 AS INTEGER) AS start, CAST(k * 8 + 23 AS INTEGER) AS "end" FROM (SELECT DISTINCT recording_id FROM ef), range(6) q(k)),
  counts AS (SELECT w.recording_id, w.start, w."end", count(e.frame) AS n FROM wins w LEFT JOIN ef e ON e.recording_id = w.recording_id AND e.frame BETWEEN w.start AND w."end" GROUP BY ALL),
  picked AS (SELECT recording_id, 'low' AS label, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n, start) AS k FROM counts) WHERE k = 1
    UNION ALL SELECT recording_id, 'high', start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, start) AS k FROM counts) WHERE k = 1),
  per AS (SELECT g.recording_id, unit_id, label, avg(value) AS v FROM gappy g JOIN picked p ON p.recording_id = g.recording_id AND g.frame BETWEEN p.start AND p."end" GROUP BY 1, 2, 3 HAVING count(value) >= 15),
  df AS (SELECT a.recording_id AS g, a.v - b.v AS dd FROM per a JOIN per b ON a.recording_id = b.recording_id AND a.unit_id = b.unit_id AND a.label = 'high' AND b.label = 'low'), {SR}
  SELECT md.g AS recording_id, {_r('median', 'median')}, n, {_r('w', 'w')}, ties FROM md LEFT JOIN st ON st.g = md.g""")
add("plan_condition_tests", lambda s, d: rounded(behaviour.condition_tests(E.quantify_by_condition(fx.signals(s, d), 1.0, 2, 1.0), ["high", "mid", "low"], "mean", p=False)), "sig",
    f"""WITH m AS (SELECT subject_id, cond, avg(value) AS v FROM sig GROUP BY 1, 2), df AS (SELECT (a.cond, b.cond) AS g, a.v - b.v AS dd FROM m a JOIN m b USING (subject_id) WHERE (a.cond, b.cond) IN (('high', 'mid'), ('high', 'low'), ('mid', 'low'))), {SR}
        SELECT md.g[1] AS a, md.g[2] AS b, {_r('median', 'median')}, n, {_r('w', 'w')}, ties FROM md LEFT JOIN st ON st.g = md.g""")
QUERIES["plan_condition_tests_holm"] = lambda s, d: rounded(behaviour.condition_tests(E.quantify_by_condition(fx.signals(s, d), 1.0, 2, 1.0), ["high", "mid", "low"], "mean"))
