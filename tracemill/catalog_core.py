"""Registered queries of cleaning, aggregation and frame windows, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import clean as P
from .operators import ranks
from .operators import rows as V
from .operators import signal as R
from .operators import windows as W
from .sources import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The fixtures in DuckDB SQL.
CTE = {
    "traces": "SELECT label AS recording_id, vec_id AS unit_id, CAST(i - 1 AS INTEGER) AS frame, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i)",
    "gappy": "SELECT recording_id, unit_id, frame, CASE WHEN (unit_id * 7 + frame) % 5 <> 0 THEN value END AS value FROM traces",
    "positions": "SELECT label AS recording_id, vec_id AS unit_id, CAST(vec_id % 37 AS DOUBLE) AS x, CAST(vec_id % 23 AS DOUBLE) AS y, CAST(vec_id % 11 AS DOUBLE) AS z FROM embeddings",
    "ev": "SELECT user_id % 5 AS recording_id, event_id, event_type AS kind, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600) AS INTEGER) AS frame, value AS amp FROM events",
    "trials": "SELECT recording_id AS subject_id, unit_id, CAST(frame // 8 AS INTEGER) AS trial, frame % 8 AS rel_frame, value FROM traces",
    "sig": "SELECT user_id % 5 AS subject_id, CASE WHEN day(ts) <= 10 THEN 'high' WHEN day(ts) <= 20 THEN 'mid' ELSE 'low' END AS cond, CAST((day(ts) - 1) % 10 * 24 + hour(ts) AS INTEGER) AS frame, sum(value) AS value FROM events GROUP BY 1, 2, 3",
}
_NEEDS = {"gappy": ["traces"], "trials": ["traces"]}


def with_(names: str, body: str) -> str:
    """SQL with the named fixtures in front of it."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    parts = ", ".join(f"{n} AS ({CTE[n]})" for n in wanted)
    own = body.lstrip()
    if own.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {own[14:].lstrip()}"
    return f"WITH {parts}, {own[4:].lstrip()}" if own.upper().startswith("WITH") else f"WITH {parts} {body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; minus zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, fn, fixtures: str = "", sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = with_(fixtures, sql.strip()) if fixtures else sql.strip()


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


UNITW = "(PARTITION BY recording_id, unit_id ORDER BY frame"
T = fx.traces

# cleaning
add("p1_epoch_slice", lambda s, d: P.epoch_slice(T(s, d), 5, 20, 64, "sec", fx.FPS), "traces", "SELECT * FROM traces WHERE frame BETWEEN 10 AND 39")
add("p2_fixed_periods", lambda s, d: rounded(P.fixed_periods(T(s, d), 4, 15).groupBy("recording_id", "unit_id", "period").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))), "traces",
    f"SELECT recording_id, unit_id, CAST(p AS INTEGER) AS period, count(value) AS n, {_r('avg(value)', 'mean')} FROM traces, range(4) q(p) WHERE frame BETWEEN 4 + p * 15 AND 4 + (p + 1) * 15 GROUP BY ALL")
add("p3_unit_qc_finite", lambda s, d: P.unit_qc_finite(fx.gappy_traces(s, d), 64, 0.8, 0.1), "gappy",
    "SELECT recording_id, unit_id FROM gappy GROUP BY ALL HAVING count(value) >= 0.8 * 64 AND stddev_samp(value) > 0.1")
add("p4_unit_qc_shared", lambda s, d: P.unit_qc_shared(fx.gappy_traces(s, d), fx.positions(s, d), (0, 15), (30, 49)), "gappy positions",
    """SELECT recording_id, unit_id FROM gappy SEMI JOIN positions USING (recording_id, unit_id) GROUP BY ALL
       HAVING count(CASE WHEN frame BETWEEN 0 AND 15 THEN value END) >= 0.8 * 16 AND count(CASE WHEN frame BETWEEN 30 AND 49 THEN value END) >= 0.8 * 20""")


def _mixed(s, d):
    """Whole traces of which every third unit has gaps and every seventh is silent."""
    silent = F.when(F.col("unit_id") % 7 == 1, 0.0).otherwise(F.col("value"))
    return T(s, d).withColumn("value", F.when((F.col("unit_id") % 3 != 0) | (F.col("frame") % 5 != 0), silent))


add("p5_drop_nan_zero", lambda s, d: P.drop_nan_zero_units(_mixed(s, d)), "traces",
    """WITH m AS (SELECT recording_id, unit_id, frame, CASE WHEN unit_id % 3 <> 0 OR frame % 5 <> 0 THEN CASE WHEN unit_id % 7 = 1 THEN 0.0 ELSE value END END AS value FROM traces)
       SELECT * FROM m WHERE (recording_id, unit_id) IN (SELECT (recording_id, unit_id) FROM m GROUP BY recording_id, unit_id HAVING bool_and(value IS NOT NULL) AND bool_or(value <> 0))""")
add("p6_band_filter", lambda s, d: P.band_filter(fx.positions(s, d), 5.0, 9.0, "x"), "positions", "SELECT * FROM positions WHERE x BETWEEN 5 AND 9")
add("p7_valid_frames", lambda s, d: P.valid_frames(fx.event_train(s, d), 500), "ev", "SELECT DISTINCT recording_id, frame FROM ev WHERE frame BETWEEN 0 AND 499")
add("p8_peri_margin", lambda s, d: P.peri_margin(fx.event_train(s, d), 40, fx.EVENT_FRAMES).select("recording_id", "event_id", "frame"), "ev", "SELECT recording_id, event_id, frame FROM ev WHERE frame > 39 AND frame < 679")
add("p9_min_interval_thin", lambda s, d: P.min_interval_thin(P.valid_frames(fx.event_train(s, d), fx.EVENT_FRAMES), 2), "ev",
    "SELECT recording_id, frame FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY recording_id ORDER BY frame) AS gap FROM (SELECT DISTINCT recording_id, frame FROM ev WHERE frame BETWEEN 0 AND 719)) WHERE gap IS NULL OR gap >= 2")
add("p10_min_count_gate", lambda s, d: P.min_count_gate(fx.event_train(s, d).filter("kind = 'error'"), 100).select("recording_id", "event_id"), "ev",
    "SELECT recording_id, event_id FROM ev WHERE kind = 'error' AND recording_id IN (SELECT recording_id FROM ev WHERE kind = 'error' GROUP BY 1 HAVING count(*) >= 100)")
add("p11_fill_missing", lambda s, d: rounded(P.fill_missing(fx.gappy_traces(s, d))), "gappy", f"""
    WITH k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER {UNITW}) AS a,
                 first_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS) OVER {UNITW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM gappy)
    SELECT k.recording_id, k.unit_id, k.frame, {_r("coalesce(k.value, CASE WHEN a <> b THEN p.value + (n.value - p.value) * (k.frame - a) / (b - a) END, p.value, n.value, 0)", "value")}
    FROM k LEFT JOIN gappy p ON p.recording_id = k.recording_id AND p.unit_id = k.unit_id AND p.frame = a
           LEFT JOIN gappy n ON n.recording_id = k.recording_id AND n.unit_id = k.unit_id AND n.frame = b""")
Z = "coalesce((value - avg(value) OVER w) / CASE WHEN stddev_samp(value) OVER w > 0 THEN stddev_samp(value) OVER w ELSE 1 END, 0)"
add("p12_zscore_rows", lambda s, d: rounded(P.zscore_rows(fx.gappy_traces(s, d))), "gappy", f"SELECT recording_id, unit_id, frame, {_r(Z, 'value')} FROM gappy WINDOW w AS (PARTITION BY recording_id, unit_id)")
add("p13_zscore_column", lambda s, d: rounded(P.zscore_column(T(s, d).groupBy("recording_id", "unit_id").agg(F.avg("value").alias("m")), "m").select("recording_id", "unit_id", "z")), "traces",
    f"SELECT recording_id, unit_id, {_r('CASE WHEN stddev_samp(m) OVER () > 0 THEN (m - avg(m) OVER ()) / stddev_samp(m) OVER () ELSE 0 END', 'z')} FROM (SELECT recording_id, unit_id, avg(value) AS m FROM traces GROUP BY ALL)")
add("p14_dff", lambda s, d: rounded(P.dff(T(s, d).withColumn("value", F.col("value") + 2), 5, 20).select("recording_id", "unit_id", "frame", "dff")), "traces",
    f"""SELECT recording_id, unit_id, frame, {_r('(v - base) / base * 100', 'dff')} FROM (SELECT *, min(smooth) OVER {UNITW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS base
        FROM (SELECT *, value + 2 AS v, avg(value + 2) OVER {UNITW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth FROM traces))""")
add("p15_clip", lambda s, d: rounded(fx.gappy_traces(s, d).withColumn("value", P.clip(F.col("value"), -0.1, 0.1))), "gappy", f"SELECT recording_id, unit_id, frame, {_r('CASE WHEN value IS NOT NULL THEN least(greatest(value, -0.1), 0.1) END', 'value')} FROM gappy")
add("p16_normalize01", lambda s, d: rounded(P.normalize01(fx.signals(s, d), ["subject_id", "cond"])), "sig",
    f"SELECT subject_id, cond, frame, {_r('CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END', 'value')} FROM sig WINDOW w AS (PARTITION BY subject_id, cond)")
add("p17_detrend", lambda s, d: rounded(P.detrend(fx.gappy_traces(s, d))), "gappy",
    f"SELECT recording_id, unit_id, frame, {_r('v - (regr_slope(v, frame) OVER w * frame + regr_intercept(v, frame) OVER w)', 'value')} FROM (SELECT *, coalesce(value, 0) AS v FROM gappy) WINDOW w AS (PARTITION BY recording_id, unit_id)")
DOM = "SELECT recording_id, unit_id, CAST((unit_id * 37) % 128 AS DOUBLE) / 1000 AS dom FROM positions"


def synthetic_dom(s, d):
    """A dominant frequency per unit from its number."""
    return fx.positions(s, d).select("recording_id", "unit_id", (F.col("unit_id") * 37 % 128 / 1000.0).alias("dom"))


add("p18_freq_bin_label", lambda s, d: P.freq_bin_label(synthetic_dom(s, d), fx.positions(s, d), 0.0, 0.11, 11).select("recording_id", "unit_id", "x", "bin", "in_bin"), "positions",
    f"""WITH q AS ({DOM}) SELECT recording_id, unit_id, x, bin, bin IS NOT NULL AS in_bin FROM (SELECT q.recording_id, q.unit_id, x,
        CAST(CASE WHEN dom >= 0 AND dom <= 0.11 THEN least(floor((dom - 0.0) / ((0.11 - 0.0) / 11)) + 1, 11) END AS INTEGER) AS bin FROM q JOIN positions p ON p.recording_id = q.recording_id AND p.unit_id = q.unit_id)""")

# aggregation
add("a1_summary", lambda s, d: rounded(A.summary(fx.gappy_traces(s, d), ["recording_id", "unit_id"])), "gappy",
    f"SELECT recording_id, unit_id, count(value) AS n, {_r('avg(value)', 'mean')}, {_r('median(value)', 'median')}, {_r('stddev_samp(value)', 'sd')}, {_r('stddev_samp(value) / sqrt(count(value))', 'sem')} FROM gappy GROUP BY ALL")
add("a2_mad", lambda s, d: rounded(A.mad(T(s, d), ["recording_id", "unit_id"])), "traces", f"SELECT recording_id, unit_id, {_r('mad(value)', 'mad')} FROM traces GROUP BY ALL")
HAZEN = """h AS (SELECT g, p, CASE WHEN x = floor(x) OR i = n THEN v ELSE v + (x - i) * (nxt - v) END AS q FROM (
    SELECT g, v, p, i, n, nxt, least(greatest(p * n + 0.5, 1), n) AS x FROM (
      SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS i, count(*) OVER (PARTITION BY g) AS n, lead(v) OVER (PARTITION BY g ORDER BY v) AS nxt FROM vals WHERE v IS NOT NULL),
      (SELECT unnest([0.05, 0.25, 0.5, 0.9]) AS p)) WHERE floor(x) = i)"""
add("a3_percentile_hazen", lambda s, d: rounded(A.hazen(fx.gappy_traces(s, d), ["unit_id"], [0.05, 0.25, 0.5, 0.9])), "gappy",
    f"WITH vals AS (SELECT unit_id AS g, value AS v FROM gappy), {HAZEN} SELECT g AS unit_id, CAST(p AS DOUBLE) AS p, {_r('q', 'q')} FROM h")
add("a4_iqr", lambda s, d: rounded(A.iqr(fx.gappy_traces(s, d), ["unit_id"])), "gappy",
    f"WITH vals AS (SELECT unit_id AS g, value AS v FROM gappy), {HAZEN.replace('0.05, 0.25, 0.5, 0.9', '0.25, 0.75')} SELECT g AS unit_id, {_r('max(q) - min(q)', 'iqr')} FROM h GROUP BY g")
add("a5_histogram_pct", lambda s, d: rounded(A.histogram_pct(T(s, d), ["recording_id"], -0.25, 0.0625, 8)), "traces",
    f"""WITH b AS (SELECT recording_id, CAST(least(floor((value + 0.25) / 0.0625), 7) AS INTEGER) AS bin FROM traces WHERE value BETWEEN -0.25 AND 0.25)
        SELECT recording_id, bin, count(*) AS n, {_r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY recording_id)', 'pct')} FROM b GROUP BY recording_id, bin
        UNION ALL SELECT NULL, bin, count(*), round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 FROM b GROUP BY bin""")
add("a6_binned_median", lambda s, d: rounded(A.binned_median(fx.positions(s, d), ["recording_id"], "x", "y", 0.0, 4.0, 10)), "positions",
    f"""WITH b AS (SELECT recording_id, CAST(least(floor(x / 4), 9) AS INTEGER) AS bin, y FROM positions WHERE x BETWEEN 0 AND 40), g AS (SELECT DISTINCT recording_id, CAST(k AS INTEGER) AS bin FROM positions, range(10) r(k))
        SELECT g.recording_id, g.bin, {_r('median(y)', 'median')} FROM g LEFT JOIN b ON b.recording_id = g.recording_id AND b.bin = g.bin GROUP BY g.recording_id, g.bin""")


def _curves(s, d):
    return T(s, d).groupBy("recording_id", "frame").agg(F.avg("value").alias("v"), F.count(F.when(F.col("value") > 0, 1)).alias("pairs"))


add("a7_weighted_mean_curve", lambda s, d: rounded(A.weighted_mean_curve(_curves(s, d), "frame", "v", "pairs", 20, 3)), "traces",
    f"""WITH c AS (SELECT recording_id, frame, avg(value) AS v, count(CASE WHEN value > 0 THEN 1 END) AS pairs FROM traces GROUP BY ALL),
        w AS (SELECT *, pairs / sum(pairs) OVER (PARTITION BY frame) AS w FROM c), m AS (SELECT *, sum(w * v) OVER (PARTITION BY frame) AS m FROM w)
        SELECT frame, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS curves, {_r('CASE WHEN sum(pairs) >= 20 AND count(*) >= 3 THEN any_value(m) END', 'weighted')},
               {_r('CASE WHEN sum(pairs) >= 20 AND count(*) >= 3 THEN sqrt(sum(w ** 2 * (v - m) ** 2)) END', 'weighted_sem')}, {_r('avg(v)', 'plain')} FROM m GROUP BY frame""")
add("a8_mean_curve", lambda s, d: rounded(A.mean_curve(fx.gappy_traces(s, d), ["recording_id", "frame"])), "gappy",
    f"SELECT recording_id, frame, {_r('avg(value)', 'mean')}, {_r('stddev_samp(value) / sqrt(count(value))', 'sem')}, count(value) AS n FROM gappy GROUP BY ALL")
add("a9_stack_grids", lambda s, d: rounded(A.stack_grids(fx.trials(s, d).groupBy("subject_id", F.col("trial").alias("period"), F.col("rel_frame").alias("gi"), (F.col("unit_id") % 4).alias("gj")).agg(F.avg("value").alias("density")))), "trials",
    f"""WITH g AS (SELECT subject_id, trial AS period, rel_frame AS gi, unit_id % 4 AS gj, avg(value) AS density FROM trials GROUP BY ALL),
        c AS (SELECT period, gi, gj, avg(density) AS mean, median(density) AS median FROM g GROUP BY ALL)
        SELECT c.gi, c.gj, c.period, {_r('c.mean', 'mean')}, {_r('c.median', 'median')}, {_r('c.mean - f.mean', 'change')} FROM c LEFT JOIN c f ON f.period = 0 AND f.gi = c.gi AND f.gj = c.gj""")
add("a10_trapz", lambda s, d: rounded(A.trapz(T(s, d), ["recording_id", "unit_id"], "frame", "value")), "traces",
    f"SELECT recording_id, unit_id, {_r('coalesce(sum(p), 0)', 'area')} FROM (SELECT recording_id, unit_id, (frame - lag(frame) OVER {UNITW})) * (value + lag(value) OVER {UNITW})) / 2 AS p FROM traces) GROUP BY ALL")
add("a11_share", lambda s, d: rounded(fx.gappy_traces(s, d).groupBy("recording_id").agg(A.share_of(F.col("value") > 0.05).alias("share"))), "gappy", f"SELECT recording_id, {_r('avg(CAST(value > 0.05 AS DOUBLE))', 'share')} FROM gappy GROUP BY ALL")
add("a12_occupied", lambda s, d: A.occupied(fx.event_train(s, d).groupBy("recording_id", "kind").agg(F.sum((F.col("amp") > 200).cast("int")).alias("n")), ["recording_id"], "kind", "n"), "ev",
    "SELECT recording_id, count(DISTINCT CASE WHEN n > 0 THEN kind END) AS occupied FROM (SELECT recording_id, kind, sum(CAST(amp > 200 AS INTEGER)) AS n FROM ev GROUP BY ALL) GROUP BY ALL")
add("a13_population_mean", lambda s, d: rounded(A.population_mean(T(s, d))), "traces", f"SELECT recording_id, frame, {_r('avg(value)', 'value')} FROM traces GROUP BY ALL")
add("a14_by_condition", lambda s, d: rounded(A.by_condition(fx.signals(s, d).groupBy("subject_id", "cond").agg(F.max("value").alias("v")), "subject_id", "cond", "v", ["high", "mid", "low"])), "sig",
    f"SELECT subject_id, {', '.join(_r(f'''max(CASE WHEN cond = '{c}' THEN value END)''', c) for c in ('high', 'mid', 'low'))} FROM sig GROUP BY ALL")
add("a15_to_long", lambda s, d: A.to_long(fx.positions(s, d), ["recording_id", "unit_id"], ["x", "y", "z"]), "positions",
    " UNION ALL ".join(f"SELECT recording_id, unit_id, '{c}' AS scenario, {c} AS value FROM positions" for c in "xyz"))
add("a16_fisher_z_mean", lambda s, d: rounded(T(s, d).groupBy("recording_id", "frame").agg(A.fisher_z_mean(F.col("value") * 3).alias("r"))), "traces",
    f"SELECT recording_id, frame, {_r('tanh(avg(atanh(least(greatest(value * 3, -0.999999), 0.999999))))', 'r')} FROM traces GROUP BY ALL")
add("a17_resultant", lambda s, d: rounded(T(s, d).groupBy("recording_id", "frame").agg(A.resultant(F.col("value") * 10).alias("r"))), "traces",
    f"SELECT recording_id, frame, {_r('sqrt(pow(avg(cos(value * 10)), 2) + pow(avg(sin(value * 10)), 2))', 'r')} FROM traces GROUP BY ALL")

# windows over frames
#: Peaks by height, prominence and, tallest first, distance. A peak that is alive and taller than all alive ones near it is kept; a few rounds settle all.
PEAKS = """WITH RECURSIVE src AS MATERIALIZED (SELECT *, lag(v) OVER (PARTITION BY recording_id, unit_id ORDER BY frame) AS p FROM ({src})), c AS MATERIALIZED (SELECT recording_id, unit_id, frame, v FROM src WHERE p IS NULL OR p <> v),
  pk AS MATERIALIZED (SELECT recording_id, unit_id, frame, v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM c WINDOW w AS (PARTITION BY recording_id, unit_id ORDER BY frame)) WHERE v > a AND v > b AND v >= {height}),
  hi AS MATERIALIZED (SELECT k.recording_id, k.unit_id, k.frame, any_value(k.v) AS v, coalesce(max(s.frame) FILTER (s.frame < k.frame AND s.v > k.v), -1) AS l, coalesce(min(s.frame) FILTER (s.frame > k.frame AND s.v > k.v), 1000000) AS r
         FROM pk k JOIN src s ON s.recording_id = k.recording_id AND s.unit_id = k.unit_id GROUP BY 1, 2, 3),
  pr AS MATERIALIZED (SELECT h.recording_id, h.unit_id, h.frame, any_value(h.v) AS v, any_value(h.v) - greatest(min(s.v) FILTER (s.frame <= h.frame), min(s.v) FILTER (s.frame >= h.frame)) AS prom
         FROM hi h JOIN src s ON s.recording_id = h.recording_id AND s.unit_id = h.unit_id AND s.frame > h.l AND s.frame < h.r GROUP BY 1, 2, 3),
  ok AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording_id, unit_id ORDER BY v DESC, frame) AS o FROM pr WHERE prom >= {prominence}),
  li AS (SELECT recording_id, unit_id, list(frame ORDER BY o) AS f FROM ok GROUP BY 1, 2),
  gr AS (SELECT recording_id, unit_id, f, CAST([] AS INTEGER[]) AS kept FROM li
         UNION ALL SELECT recording_id, unit_id, list_filter(f[2:], lambda x: abs(x - f[1]) >= {distance}), list_append(kept, CAST(f[1] AS INTEGER)) FROM gr WHERE len(f) > 0),
  kp AS (SELECT recording_id, unit_id, unnest(kept) AS frame FROM gr WHERE len(f) = 0)
  SELECT ok.recording_id, ok.unit_id, ok.frame, round(ok.v, 6) + 0.0 AS value, round(prom, 6) + 0.0 AS prominence FROM ok JOIN kp ON kp.recording_id = ok.recording_id AND kp.unit_id = ok.unit_id AND kp.frame = ok.frame"""
add("w1_moving_mean", lambda s, d: rounded(W.moving_mean(fx.gappy_traces(s, d), 6)), "gappy", f"SELECT recording_id, unit_id, frame, {_r(f'avg(value) OVER {UNITW} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)', 'value')} FROM gappy")
_g = {i: f"exp(-0.5 * pow({i} / 1.0, 2))" for i in range(-2, 3)}
add("w2_gaussian_smooth", lambda s, d: rounded(W.gaussian_smooth(fx.gappy_traces(s, d), 5)), "gappy",
    f"""SELECT recording_id, unit_id, frame, {_r('(' + ' + '.join(f'coalesce(lead(value, {i}) OVER {UNITW}) * {g}, 0)' for i, g in _g.items()) + ') / nullif(' + ' + '.join(f'CASE WHEN lead(value, {i}) OVER {UNITW}) IS NULL THEN 0 ELSE {g} END' for i, g in _g.items()) + ', 0)', 'value')} FROM gappy""")
add("w3_exp_causal", lambda s, d: rounded(W.exp_causal_filter(T(s, d), 1.5, 2.0)), "traces",
    f"SELECT recording_id, unit_id, frame, {_r(' + '.join(f'coalesce(lag(value, {k}) OVER {UNITW}), 0) * exp(-{k} / 3.0)' for k in range(7)), 'value')} FROM traces")
add("w4_gradient", lambda s, d: rounded(W.gradient(T(s, d)).select("recording_id", "unit_id", "frame", "gradient")), "traces",
    f"SELECT recording_id, unit_id, frame, {_r(f'coalesce((lead(value) OVER {UNITW}) - lag(value) OVER {UNITW})) / 2, lead(value) OVER {UNITW}) - value, value - lag(value) OVER {UNITW}))', 'gradient')} FROM traces")
add("w5_difference", lambda s, d: rounded(W.difference(T(s, d), True).select("recording_id", "unit_id", "frame", "diff")), "traces", f"SELECT recording_id, unit_id, frame, {_r(f'greatest(coalesce(value - lag(value) OVER {UNITW}), 0), 0)', 'diff')} FROM traces")


def _on(s, d):
    return T(s, d).withColumn("active", F.col("value") > 0)


RUNS = f"""f AS (SELECT recording_id, unit_id, frame, value > 0 AS active, lag(value > 0) OVER {UNITW}) AS was FROM traces),
  g AS (SELECT *, sum(CAST(active AND NOT coalesce(was, false) AS INTEGER)) OVER {UNITW}) AS run FROM f),
  r AS (SELECT recording_id, unit_id, CAST(run AS BIGINT) AS run, min(frame) AS start, max(frame) AS "end", count(*) AS length FROM g WHERE active GROUP BY ALL)"""
add("w6_runs", lambda s, d: W.runs(_on(s, d), "active"), "traces", f"WITH {RUNS} SELECT * FROM r")
add("w7_drop_short_runs", lambda s, d: W.drop_short_runs(_on(s, d), "active", 3), "traces", f"WITH {RUNS} SELECT * FROM r WHERE length >= 3")
add("w8_merge_and_delete", lambda s, d: W.merge_and_delete(_on(s, d), "active", 1, 2), "traces",
    f"""WITH {RUNS}, m AS (SELECT *, sum(CAST(coalesce(start - prev - 1 > 1, true) AS INTEGER)) OVER (PARTITION BY recording_id, unit_id ORDER BY start) AS id FROM (
          SELECT *, lag("end") OVER (PARTITION BY recording_id, unit_id ORDER BY start) AS prev FROM r))
        SELECT recording_id, unit_id, min(start) AS start, max("end") AS "end" FROM m GROUP BY recording_id, unit_id, id HAVING max("end") - min(start) + 1 > 2""")


def recordings(s, d):
    return fx.event_train(s, d).select("recording_id").distinct().withColumn("n_frames", F.lit(fx.EVENT_FRAMES))


WINS = "wins AS (SELECT recording_id, CAST(k AS INTEGER) AS win, CAST(k * 60 AS INTEGER) AS start, CAST(k * 60 + 119 AS INTEGER) AS \"end\" FROM (SELECT DISTINCT recording_id FROM ev), range(11) q(k))"
add("w9_sliding_windows", lambda s, d: W.sliding_windows(recordings(s, d), 120, 60), "ev", f"WITH {WINS} SELECT * FROM wins")
add("w12_unwrap", lambda s, d: rounded(W.unwrap_phase(T(s, d).withColumn("phase", F.col("value") * 12)).select("recording_id", "unit_id", "frame", "unwrapped")), "traces",
    f"""SELECT recording_id, unit_id, frame, {_r(f'ph + 2 * pi() * sum(coalesce(-round(dd / (2 * pi())), 0)) OVER {UNITW})', 'unwrapped')} FROM (SELECT *, value * 12 AS ph, value * 12 - lag(value * 12) OVER {UNITW}) AS dd FROM traces)""")
add("w13_instantaneous_freq", lambda s, d: rounded(W.instantaneous_freq(T(s, d).withColumn("phase", F.col("value") * 12), fx.FPS).select("recording_id", "unit_id", "frame", "freq")), "traces",
    f"""SELECT recording_id, unit_id, frame, {_r(f'(u - lag(u) OVER {UNITW})) * 2 / (2 * pi())', 'freq')} FROM (SELECT *, ph + 2 * pi() * sum(coalesce(-round(dd / (2 * pi())), 0)) OVER {UNITW}) AS u
        FROM (SELECT *, value * 12 AS ph, value * 12 - lag(value * 12) OVER {UNITW}) AS dd FROM traces))""")
add("w14_local_maxima", lambda s, d: rounded(W.local_maxima(T(s, d).withColumn("value", F.round("value", 1)), least=0.1)), "traces",
    f"""WITH c AS (SELECT * FROM (SELECT recording_id, unit_id, frame, round(value, 1) AS value, lag(round(value, 1)) OVER {UNITW}) AS p FROM traces) WHERE p IS NULL OR p <> value)
        SELECT recording_id, unit_id, frame, {_r('value', 'value')} FROM (SELECT *, lag(value) OVER {UNITW}) AS a, lead(value) OVER {UNITW}) AS b FROM c) WHERE value > a AND value > b AND value >= 0.1""")
add("w14_find_peaks", lambda s, d: rounded(R.peak_list(fx.trace_arrays(s, d), 0.05, 0.1, 4)), "traces", PEAKS.format(src="SELECT recording_id, unit_id, frame, value AS v FROM traces", height=0.05, prominence=0.1, distance=4))
add("w15_resize", lambda s, d: rounded(W.resize(T(s, d), 20)), "traces",
    f"""WITH t AS (SELECT *, lead(value) OVER {UNITW}) AS nxt FROM traces), q AS (SELECT CAST(k AS INTEGER) AS k, CAST(floor(k * 63 / 19.0 + 1e-9) AS INTEGER) AS frame FROM range(20) r(k))
        SELECT t.recording_id, t.unit_id, k, {_r('t.value + coalesce((k * 63 / 19.0 - t.frame) * (nxt - t.value), 0)', 'value')} FROM t JOIN q ON t.frame = q.frame""")
add("w16_mean_rank", lambda s, d: ranks.mean_rank(fx.positions(s, d), ["recording_id"], "z").select("recording_id", "unit_id", "rank"), "positions",
    "SELECT recording_id, unit_id, rank() OVER (PARTITION BY recording_id ORDER BY z) + (count(*) OVER (PARTITION BY recording_id, z) - 1) / 2.0 AS rank FROM positions")
add("w17_dominant_mode", lambda s, d: W.dominant_mode_per_frame(T(s, d).groupBy("recording_id", "frame", (F.col("unit_id") % 6).alias("mode")).agg(F.avg("value").alias("value"))), "traces",
    """SELECT recording_id, frame, mode FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY abs(value) DESC, mode) AS k FROM (
       SELECT recording_id, frame, unit_id % 6 AS mode, avg(value) AS value FROM traces GROUP BY ALL)) WHERE k = 1""")


# whole traces: the same results from rows of arrays; the long forms above stay as queries of their own


def whole_traces(name: str, fn, value: str = "value") -> None:
    QUERIES[f"{name}_long"], ORACLE_SQL[f"{name}_long"] = QUERIES[name], ORACLE_SQL[name]
    QUERIES[name] = lambda s, d: rounded(fx.explode_traces(fn(s, d)).withColumnRenamed("value", value))


def phase_arrays(s, d):
    return fx.trace_arrays(s, d).withColumn("phase", F.transform("trace", lambda x: x * 12))


whole_traces("p11_fill_missing", lambda s, d: V.fill_missing(fx.gappy_arrays(s, d)))
whole_traces("p12_zscore_rows", lambda s, d: V.zscored(fx.gappy_arrays(s, d)))
whole_traces("p17_detrend", lambda s, d: V.detrended(fx.gappy_arrays(s, d)))
whole_traces("w1_moving_mean", lambda s, d: V.moving_mean(fx.gappy_arrays(s, d), 6))
whole_traces("w2_gaussian_smooth", lambda s, d: V.gaussian_smooth(fx.gappy_arrays(s, d), 5))
whole_traces("w3_exp_causal", lambda s, d: V.exp_causal_filter(fx.trace_arrays(s, d), 1.5, 2.0))
whole_traces("w4_gradient", lambda s, d: V.gradient(fx.trace_arrays(s, d)), "gradient")
whole_traces("w5_difference", lambda s, d: V.difference(fx.trace_arrays(s, d), True), "diff")
whole_traces("w12_unwrap", lambda s, d: V.unwrap_phase(phase_arrays(s, d)), "unwrapped")
whole_traces("w13_instantaneous_freq", lambda s, d: V.instantaneous_freq(phase_arrays(s, d), fx.FPS), "freq")
