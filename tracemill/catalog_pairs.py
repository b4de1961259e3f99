"""Registered queries of joins, sorts, sets and pairwise operators, each with its DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .catalog_core import WINS, _r, recordings, rounded, synthetic_dom, with_
from .operators import clean as P
from .operators import joins as J
from .operators import pairs as N
from .operators import sorts as K
from .operators import windows as W
from .plans import analyses
from .sources import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict = {}
T = fx.traces


def add(name: str, fn, fixtures: str = "", sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = with_(fixtures, sql.strip()) if fixtures else sql.strip()


def event_frames(s, d):
    return P.valid_frames(fx.event_train(s, d), fx.EVENT_FRAMES)


def windows(s, d):
    return W.sliding_windows(recordings(s, d), 120, 60)


EF = "ef AS (SELECT DISTINCT recording_id, frame FROM ev WHERE frame BETWEEN 0 AND 719)"

# joins
add("j1_paired", lambda s, d: J.paired(T(s, d).groupBy("recording_id").agg(F.count_distinct("unit_id").alias("units")), event_frames(s, d).groupBy("recording_id").agg(F.count("*").alias("events")), "recording_id"), "traces ev",
    f"WITH {EF} SELECT recording_id, units, events FROM (SELECT recording_id, count(DISTINCT unit_id) AS units FROM traces GROUP BY 1) JOIN (SELECT recording_id, count(*) AS events FROM ef GROUP BY 1) USING (recording_id)")
add("j2_having_both", lambda s, d: J.having_both(fx.positions(s, d), fx.event_train(s, d), "recording_id"), "positions ev", "SELECT * FROM positions WHERE recording_id IN (SELECT recording_id FROM ev)")
add("j3_positional_zip", lambda s, d: J.positional_zip(fx.positions(s, d), fx.event_train(s, d), ["recording_id"], "unit_id", "event_id", "x", "amp"), "positions ev",
    "SELECT recording_id, p.k, p.x AS a, e.amp AS b FROM (SELECT recording_id, x, row_number() OVER (PARTITION BY recording_id ORDER BY unit_id) - 1 AS k FROM positions) p JOIN (SELECT recording_id, amp, row_number() OVER (PARTITION BY recording_id ORDER BY event_id) - 1 AS k FROM ev) e USING (recording_id, k)")
add("j4_count_in_windows", lambda s, d: J.count_in_windows(event_frames(s, d), windows(s, d), 60), "ev",
    f'WITH {EF}, {WINS} SELECT w.recording_id, w.win, w.start, w."end", count(e.frame) AS n FROM wins w LEFT JOIN ef e ON e.recording_id = w.recording_id AND e.frame BETWEEN w.start AND w."end" GROUP BY ALL')
add("j5_trailing_rate", lambda s, d: rounded(J.trailing_rate(recordings(s, d).select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(719), F.lit(7))).alias("frame")), event_frames(s, d), 24, 60.0)), "ev",
    f"WITH {EF} SELECT r.recording_id, CAST(k * 7 AS INTEGER) AS frame, {_r('count(e.frame) * 60.0 / 24', 'rate')} FROM (SELECT DISTINCT recording_id FROM ev) r CROSS JOIN range(103) q(k) LEFT JOIN ef e ON e.recording_id = r.recording_id AND e.frame BETWEEN k * 7 - 24 AND k * 7 GROUP BY r.recording_id, k")
GRID = [0.0, 4.0, 9.0, 20.0, 33.0]
add("j6_nearest", lambda s, d: J.nearest(fx.positions(s, d), GRID, "x").select("recording_id", "unit_id", "nearest"), "positions",
    f"SELECT recording_id, unit_id, (SELECT i FROM (SELECT unnest({GRID}) AS g, unnest([0, 1, 2, 3, 4]) AS i) ORDER BY abs(x - g), i LIMIT 1) AS nearest FROM positions")


def sorted_kind(s, d, kind):
    return fx.event_train(s, d).filter(F.col("kind") == kind).select("recording_id", "frame").distinct()


add("j6_nearest_frame", lambda s, d: J.nearest_frame(sorted_kind(s, d, "error"), sorted_kind(s, d, "click")), "ev",
    """WITH a AS (SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'error'), b AS (SELECT DISTINCT recording_id, frame AS f FROM ev WHERE kind = 'click')
       SELECT recording_id, frame, nearest FROM (SELECT a.recording_id, a.frame, b.f AS nearest, row_number() OVER (PARTITION BY a.recording_id, a.frame ORDER BY abs(a.frame - b.f), b.f) AS k FROM a LEFT JOIN b ON a.recording_id = b.recording_id) WHERE k = 1""")


def _series(s, d):
    return fx.event_train(s, d).groupBy("recording_id", F.col("frame").cast("double").alias("t")).agg(F.max("amp").alias("value"))


def _clock(s, d):
    return recordings(s, d).select("recording_id", F.explode(F.sequence(F.lit(-10), F.lit(740), F.lit(5))).alias("k")).select("recording_id", (F.col("k") + 0.25).alias("t"))


_INTERP = """WITH s AS (SELECT recording_id, CAST(frame AS DOUBLE) AS t, max(amp) AS value FROM ev GROUP BY 1, 2), c AS (SELECT recording_id, k * 5 - 10 + 0.25 AS t FROM (SELECT DISTINCT recording_id FROM ev), range(151) q(k)),
  n AS (SELECT c.recording_id, c.t, (SELECT max(s.t) FROM s WHERE s.recording_id = c.recording_id AND s.t <= c.t) AS a, (SELECT min(s.t) FROM s WHERE s.recording_id = c.recording_id AND s.t >= c.t) AS b FROM c)
  SELECT n.recording_id, CAST(n.t AS DOUBLE) AS t, {} FROM n LEFT JOIN s p ON p.recording_id = n.recording_id AND p.t = n.a LEFT JOIN s q ON q.recording_id = n.recording_id AND q.t = n.b"""
_LINE = "CASE WHEN a = b THEN p.value WHEN a IS NOT NULL AND b IS NOT NULL THEN p.value + (q.value - p.value) * (n.t - a) / (b - a) {} END"
add("j7_interpolate_null", lambda s, d: rounded(J.interpolate_to(_series(s, d), _clock(s, d), ["recording_id"])), "ev", _INTERP.format(_r(_LINE.format(""), "value")))
add("r1_interpolate_zero", lambda s, d: rounded(J.interpolate_to(_series(s, d), _clock(s, d), ["recording_id"], "zero")), "ev", _INTERP.format(_r(_LINE.format("ELSE 0"), "value")))
add("r1_interpolate_nearest", lambda s, d: rounded(J.interpolate_to(_series(s, d), _clock(s, d), ["recording_id"], "nearest")), "ev", _INTERP.format(_r(_LINE.format("ELSE coalesce(p.value, q.value)"), "value")))
add("j8_unit_pairs", lambda s, d: J.unit_pairs(fx.positions(s, d), ["x"]), "positions", "SELECT a.recording_id, a.unit_id AS a, b.unit_id AS b, a.x AS x_a, b.x AS x_b FROM positions a JOIN positions b ON a.recording_id = b.recording_id AND a.unit_id < b.unit_id")
add("j9_rectangle_pairs", lambda s, d: J.rectangle_pairs(fx.positions(s, d), ["x"], F.col("x") < 5), "positions",
    "SELECT a.recording_id, a.unit_id AS a, b.unit_id AS b, a.x AS x_a, b.x AS x_b FROM positions a JOIN positions b ON a.recording_id = b.recording_id WHERE a.x < 5 AND NOT b.x < 5")


def trace_events(s, d):
    """The events on the clock of the traces, which have 64 frames."""
    return P.valid_frames(fx.event_train(s, d), 64)


SE = "se AS (SELECT DISTINCT recording_id, frame FROM ev WHERE frame BETWEEN 0 AND 63)"
PERI = "pe AS (SELECT t.recording_id, t.unit_id, e.frame AS event, t.frame - e.frame AS lag, t.value FROM traces t JOIN se e ON t.recording_id = e.recording_id AND t.frame BETWEEN e.frame - 6 AND e.frame + 6 WHERE e.frame >= 6 AND e.frame + 6 < 64)"


def peri(s, d):
    return J.peri_event(fx.trace_arrays(s, d), trace_events(s, d), 6, 6)


add("j10_peri_event", lambda s, d: rounded(peri(s, d).groupBy("recording_id", "unit_id", "lag").agg(F.count("*").alias("n"), F.sum("value").alias("total"))), "traces ev",
    f"WITH {SE}, {PERI} SELECT recording_id, unit_id, lag, count(*) AS n, {_r('sum(value)', 'total')} FROM pe GROUP BY ALL")


def _modes(s, d, k):
    return fx.positions(s, d).filter(F.col("unit_id") % (k + 2) != 0).select("recording_id", "unit_id", (F.col("unit_id") * 31 % k).alias("mode"))


_MODES = "SELECT recording_id, unit_id, unit_id * 31 % {k} AS mode FROM positions WHERE unit_id % {m} <> 0"
add("j11_assignment_agreement", lambda s, d: rounded(J.assignment_agreement(_modes(s, d, 3), _modes(s, d, 4), ["recording_id"], "unit_id", "mode")), "positions",
    f"""WITH a AS ({_MODES.format(k=3, m=5)}), b AS ({_MODES.format(k=4, m=6)}) SELECT coalesce(a.recording_id, b.recording_id) AS recording_id, count(CASE WHEN a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL THEN 1 END) AS common,
       {_r('avg(CASE WHEN a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL THEN CAST(a.mode = b.mode AS DOUBLE) END)', 'equal')}, {_r('count(CASE WHEN a.unit_id IS NOT NULL AND b.unit_id IS NOT NULL THEN 1 END) / count(*)', 'jaccard')}
       FROM a FULL JOIN b ON a.recording_id = b.recording_id AND a.unit_id = b.unit_id GROUP BY 1""")
add("j12_grid_points", lambda s, d: rounded(J.grid_points(fx.positions(s, d), "x", "y", 7, 5, ["recording_id"])), "positions",
    f"""SELECT recording_id, CAST(i AS INTEGER) AS gi, CAST(j AS INTEGER) AS gj, {_r('x0 + i * (x1 - x0) / 6', 'gx')}, {_r('y0 + j * (y1 - y0) / 4', 'gy')} FROM (SELECT recording_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM positions GROUP BY 1), range(7) a(i), range(5) b(j)""")
add("j13_common_span", lambda s, d: J.common_span(fx.event_train(s, d).select("recording_id", "kind", F.col("frame").cast("double").alias("t")).distinct(), "recording_id", "kind"), "ev",
    """SELECT recording_id, max(a) AS start, min(b) AS "end", median(dt) AS dt FROM (SELECT recording_id, kind, min(t) AS a, max(t) AS b, median(d) AS dt FROM (
         SELECT *, t - lag(t) OVER (PARTITION BY recording_id, kind ORDER BY t) AS d FROM (SELECT DISTINCT recording_id, kind, CAST(frame AS DOUBLE) AS t FROM ev)) GROUP BY 1, 2) GROUP BY 1 HAVING max(a) <= min(b)""")
add("j14_leave_one_out", lambda s, d: rounded(J.leave_one_out_mean(fx.trials(s, d), ["subject_id", "unit_id", "rel_frame"])), "trials",
    f"SELECT subject_id, unit_id, trial, rel_frame, {_r('value', 'value')}, {_r('(sum(value) OVER w - value) / (count(value) OVER w - 1)', 'others')} FROM trials WINDOW w AS (PARTITION BY subject_id, unit_id, rel_frame)")
add("j15_session_pairs", lambda s, d: J.session_pairs(fx.positions(s, d).select((F.col("recording_id") % 2).alias("subject_id"), F.when(F.col("unit_id") % 3 == 0, "high").otherwise("low").alias("session"), "recording_id", "unit_id", "x"), "high", "low", "x"), "positions",
    """WITH u AS (SELECT recording_id % 2 AS subject_id, CASE WHEN unit_id % 3 = 0 THEN 'high' ELSE 'low' END AS session, recording_id, unit_id, x FROM positions),
       f AS (SELECT *, min(recording_id) OVER (PARTITION BY subject_id, session) AS r FROM u), n AS (SELECT subject_id, session, x, row_number() OVER (PARTITION BY subject_id, session ORDER BY unit_id) - 1 AS k FROM f WHERE recording_id = r)
       SELECT a.subject_id, a.k, a.x AS a, b.x AS b FROM n a JOIN n b ON a.subject_id = b.subject_id AND a.k = b.k AND a.session = 'high' AND b.session = 'low'""")
COUNTS = f'counts AS (SELECT w.recording_id, w.start, w."end", count(e.frame) AS n FROM wins w LEFT JOIN ef e ON e.recording_id = w.recording_id AND e.frame BETWEEN w.start AND w."end" GROUP BY ALL)'
add("w10_rank_windows", lambda s, d: W.rank_windows(J.count_in_windows(event_frames(s, d), windows(s, d), 60)), "ev",
    f"""WITH {EF}, {WINS}, {COUNTS} SELECT recording_id, 'low' AS label, n, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n, start) AS k FROM counts) WHERE k = 1
        UNION ALL SELECT recording_id, 'high', n, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, start) AS k FROM counts) WHERE k = 1""")


def window_activity(s, d):
    ev = fx.event_train(s, d).select("recording_id", "frame", "amp")
    hit = J.events_in_windows(ev, windows(s, d), 60)
    return hit.groupBy("recording_id", "start", "end").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("amp") ** 2)).alias("rms"), F.stddev_samp("amp").alias("sd"))


add("w11_window_activity", lambda s, d: rounded(window_activity(s, d)), "ev",
    f"""WITH {WINS} SELECT w.recording_id, w.start, w."end", count(*) AS n, {_r('sqrt(avg(amp * amp))', 'rms')}, {_r('stddev_samp(amp)', 'sd')} FROM wins w JOIN ev e ON e.recording_id = w.recording_id AND e.frame BETWEEN w.start AND w."end" GROUP BY ALL""")

# orders and sets
add("k1_top_fraction", lambda s, d: rounded(K.top_fraction(T(s, d).groupBy("recording_id", "unit_id").agg(F.round(F.avg("value"), 9).alias("m")), ["recording_id"], "m", 0.1, "unit_id")), "traces",
    f"SELECT recording_id, unit_id, {_r('m', 'm')} FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY m DESC, unit_id) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM (SELECT recording_id, unit_id, round(avg(value), 9) AS m FROM traces GROUP BY ALL)) WHERE k <= greatest(1, round(0.1 * n))")
add("k2_mode_order", lambda s, d: K.position_in_order(fx.positions(s, d), ["recording_id"], F.col("z"), [F.col("z"), F.desc(F.abs(F.col("x") - 18)), F.col("unit_id")]).select("recording_id", "unit_id", "place"), "positions",
    "SELECT recording_id, unit_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY z, abs(x - 18) DESC, unit_id) - 1 AS INTEGER) AS place FROM positions")


def _turns(s, d):
    """Each trace's first Fourier coefficient: a point in the plane per unit."""
    part = lambda f: F.round(F.avg(F.col("value") * f(2 * math.pi * F.col("frame") / 64)), 9)
    return T(s, d).groupBy("recording_id", "unit_id").agg(part(F.cos).alias("c"), part(F.sin).alias("s"))


add("k3_angle_order", lambda s, d: K.position_in_order(_turns(s, d), ["recording_id"], F.round(F.atan2("s", "c"), 6), [F.round(F.atan2("s", "c"), 6), F.col("unit_id")]).select("recording_id", "unit_id", "place"), "traces",
    """WITH f AS (SELECT recording_id, unit_id, round(avg(value * cos(2 * pi() * frame / 64)), 9) AS c, round(avg(value * sin(2 * pi() * frame / 64)), 9) AS s FROM traces GROUP BY 1, 2)
       SELECT recording_id, unit_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY round(atan2(s, c), 6), unit_id) - 1 AS INTEGER) AS place FROM f""")
add("k5_evenly_picked", lambda s, d: K.evenly_picked(fx.positions(s, d), ["recording_id"], "x", 5, "unit_id"), "positions",
    "SELECT recording_id, unit_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY x, unit_id) AS k, count(*) OVER (PARTITION BY recording_id) AS n FROM positions) WHERE list_contains(list_transform(range(5), lambda i: round(1 + i * (n - 1) / 4)), k)")
add("k6_best_by_score", lambda s, d: K.keep_first(fx.positions(s, d).withColumn("score", F.col("x") * 3 - F.col("y")), ["recording_id"], [F.desc("score"), F.col("unit_id")]), "positions",
    "SELECT * EXCLUDE k FROM (SELECT *, x * 3 - y AS score, row_number() OVER (PARTITION BY recording_id ORDER BY x * 3 - y DESC, unit_id) AS k FROM positions) WHERE k = 1")
add("u1_union", lambda s, d: fx.positions(s, d).select("recording_id", F.col("x").alias("v")).unionByName(fx.event_train(s, d).select("recording_id", F.col("frame").cast("double").alias("v"))), "positions ev", "SELECT recording_id, x AS v FROM positions UNION ALL SELECT recording_id, CAST(frame AS DOUBLE) FROM ev")
add("u2_one_clock", lambda s, d: rounded(K.sessions_on_one_clock(fx.signals(s, d).withColumn("t", F.col("frame").cast("double")), ["subject_id"], "cond", ["high", "mid", "low"])), "sig",
    f"""WITH l AS (SELECT subject_id, cond, max(frame) + 1.0 AS len, list_position(['high', 'mid', 'low'], cond) AS o FROM sig GROUP BY 1, 2), s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY subject_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM l)
        SELECT g.subject_id, g.cond, g.frame, {_r('g.value', 'value')}, {_r('g.frame + shift', 't')} FROM sig g JOIN s ON s.subject_id = g.subject_id AND s.cond = g.cond""")
add("u3_intersect", lambda s, d: sorted_kind(s, d, "click").intersect(sorted_kind(s, d, "error")), "ev", "SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'click' INTERSECT SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'error'")
add("u4_except", lambda s, d: sorted_kind(s, d, "click").exceptAll(sorted_kind(s, d, "error")), "ev", "SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'click' EXCEPT SELECT DISTINCT recording_id, frame FROM ev WHERE kind = 'error'")
add("u5_keep_first", lambda s, d: K.keep_first(fx.event_train(s, d), ["recording_id", "frame"], [F.col("event_id")]), "ev", "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY event_id) AS k FROM ev) WHERE k = 1")

# pairs and space
CORR = "cr AS (SELECT a.recording_id, a.unit_id AS a, b.unit_id AS b, corr(a.value, b.value) AS r FROM traces a JOIN traces b ON a.recording_id = b.recording_id AND a.frame = b.frame AND a.unit_id < b.unit_id GROUP BY ALL)"
DIST = "ds AS (SELECT a.recording_id, a.unit_id AS a, b.unit_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.y AS y_a, b.y AS y_b FROM positions a JOIN positions b ON a.recording_id = b.recording_id AND a.unit_id < b.unit_id)"


A = fx.trace_arrays
add("n1_pair_corr", lambda s, d: rounded(N.pair_corr(A(s, d))), "traces", f"WITH {CORR} SELECT recording_id, a, b, {_r('r', 'r')} FROM cr")
add("n1_pairwise_complete", lambda s, d: rounded(N.pair_corr(fx.gappy_arrays(s, d))), "gappy", f"WITH {CORR.replace('FROM traces a JOIN traces b', 'FROM gappy a JOIN gappy b')} SELECT recording_id, a, b, {_r('r', 'r')} FROM cr")
add("n2_band_vs_rest", lambda s, d: rounded(N.band_vs_rest(A(s, d), synthetic_dom(s, d).filter("dom < 0.03"))), "traces positions",
    f"""WITH {CORR}, q AS (SELECT recording_id, unit_id FROM positions WHERE (unit_id * 37) % 128 < 30), m AS (SELECT cr.recording_id, r, CAST(p.unit_id IS NOT NULL AS INTEGER) + CAST(o.unit_id IS NOT NULL AS INTEGER) AS inside FROM cr
          LEFT JOIN q p ON p.recording_id = cr.recording_id AND p.unit_id = a LEFT JOIN q o ON o.recording_id = cr.recording_id AND o.unit_id = b)
        SELECT recording_id, {_r('avg(r) FILTER (inside = 2)', 'within')}, {_r('median(r) FILTER (inside = 2)', 'within_median')}, count(r) FILTER (inside = 2) AS within_pairs,
               {_r('avg(r) FILTER (inside = 1)', 'across')}, {_r('median(r) FILTER (inside = 1)', 'across_median')}, count(r) FILTER (inside = 1) AS across_pairs FROM m GROUP BY 1""")
add("n3_corr_vs_distance", lambda s, d: rounded(N.corr_vs_distance(A(s, d), fx.positions(s, d), 5.0)), "traces positions",
    f"WITH {CORR}, {DIST} SELECT cr.recording_id, CAST(floor(d / 5) AS INTEGER) AS bin, {_r('avg(r)', 'r')}, count(r) AS pairs FROM cr JOIN ds ON cr.recording_id = ds.recording_id AND cr.a = ds.a AND cr.b = ds.b GROUP BY 1, 2")
add("n3_corr_vs_distance_sides", lambda s, d: rounded(N.corr_vs_distance(A(s, d), fx.positions(s, d), 5.0, 11.0)), "traces positions",
    f"WITH {CORR}, {DIST} SELECT cr.recording_id, CAST(y_a >= 11 AS INTEGER) AS side, CAST(floor(d / 5) AS INTEGER) AS bin, {_r('avg(r)', 'r')}, count(r) AS pairs FROM cr JOIN ds ON cr.recording_id = ds.recording_id AND cr.a = ds.a AND cr.b = ds.b WHERE (y_a < 11) = (y_b < 11) GROUP BY 1, 2, 3")


def _stretched(s, d):
    """Positions with a scale of their own per recording, so that some stay under the least span and others do not."""
    return fx.positions(s, d).select("recording_id", "unit_id", *[(F.col(c) * (1 + F.col("recording_id") * 0.5)).alias(c) for c in "xyz"])


FAR = f"{DIST}, fa AS (SELECT recording_id, max(d) * (1 + recording_id * 0.5) AS top FROM ds GROUP BY recording_id)"
add("n4_distance_edges", lambda s, d: N.distance_edges(_stretched(s, d)), "positions", f"WITH {FAR} SELECT DISTINCT recording_id, CAST(floor(CASE WHEN top < 50 THEN 100 ELSE top END * i / 50) AS BIGINT) AS edge FROM fa, range(51) q(i)")
add("n4_fixed_edges", lambda s, d: N.fixed_edges(_stretched(s, d)), "positions", f"WITH {FAR} SELECT recording_id, i * 5.0 AS edge FROM fa, range(1000) q(i) WHERE i <= greatest(ceil(top / 5), 1)")
add("n4_span", lambda s, d: rounded(N.span(fx.positions(s, d))), "positions", f"WITH {DIST} SELECT ds.recording_id, any_value(n) AS units, {_r('max(d)', 'top')} FROM ds JOIN (SELECT recording_id, count(*) AS n FROM positions GROUP BY 1) c ON c.recording_id = ds.recording_id GROUP BY 1")
EDGED = f"{CORR}, {FAR}, eg AS (SELECT recording_id, edge, lead(edge) OVER (PARTITION BY recording_id ORDER BY edge) AS nxt, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY edge) - 1 AS INTEGER) AS bin FROM (SELECT DISTINCT recording_id, floor(CASE WHEN top < 50 THEN 100 ELSE top END * i / 50) AS edge FROM fa, range(51) q(i)))"
add("plan_corr_by_distance", lambda s, d: rounded(analyses.corr_by_distance(A(s, d), _stretched(s, d))[0]), "traces positions",
    f"""WITH {EDGED} SELECT cr.recording_id, bin, CAST(edge AS DOUBLE) AS edge, {_r('avg(r)', 'r')}, count(r) AS pairs FROM cr JOIN ds ON cr.recording_id = ds.recording_id AND cr.a = ds.a AND cr.b = ds.b
        JOIN eg ON eg.recording_id = cr.recording_id AND d * (1 + cr.recording_id * 0.5) >= edge AND d * (1 + cr.recording_id * 0.5) < nxt GROUP BY 1, 2, 3""")
add("plan_corr_by_distance_null", lambda s, d: rounded(analyses.corr_by_distance(A(s, d), _stretched(s, d))[1].filter("bin < 50")))
#: Shuffles of a curve and of a reliability, and permutations of a rank test.
SHUFFLES, PERMUTATIONS = 100, 1000
PERM = """s AS (SELECT recording_id, unit_id, CAST(k AS INTEGER) AS seed, (unit_id * 7919 + k * 104729 + (unit_id * unit_id) % 7907 * k) % 1000003 AS key FROM positions, range(1, 101) q(k)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id, seed ORDER BY unit_id) AS i, row_number() OVER (PARTITION BY recording_id, seed ORDER BY key, unit_id) AS j FROM s),
  pm AS (SELECT a.recording_id, a.seed, a.unit_id, b.unit_id AS other FROM rk a JOIN rk b ON a.recording_id = b.recording_id AND a.seed = b.seed AND a.i = b.j)"""
add("n5_shuffled_curve", lambda s, d: rounded(N.shuffled_curve(A(s, d), fx.positions(s, d), 5.0, SHUFFLES)), "traces positions",
    f"""WITH {CORR}, {PERM}, mv AS (SELECT pm.recording_id, seed, pm.unit_id, x, y FROM pm JOIN positions p ON p.recording_id = pm.recording_id AND p.unit_id = pm.other),
        ps AS (SELECT cr.recording_id, m.seed, floor(sqrt((m.x - o.x) ** 2 + (m.y - o.y) ** 2) / 5) AS bin, avg(r) AS r FROM cr JOIN mv m ON m.recording_id = cr.recording_id AND m.unit_id = cr.a JOIN mv o ON o.recording_id = cr.recording_id AND o.unit_id = cr.b AND o.seed = m.seed GROUP BY ALL)
        SELECT recording_id, CAST(bin AS INTEGER) AS bin, {_r('avg(r)', 'null_mean')}, {_r('stddev_samp(r) / sqrt(count(r))', 'null_sem')} FROM ps GROUP BY 1, 2""")


def in_band(s, d):
    """Units of a band by an arithmetic rule."""
    return fx.positions(s, d).filter((F.col("unit_id") * 37) % 128 < 30).select("recording_id", "unit_id")


BANDED = f"""{CORR}, bd AS (SELECT recording_id, unit_id, x, y, row_number() OVER (PARTITION BY recording_id ORDER BY unit_id) AS k FROM positions WHERE (unit_id * 37) % 128 < 30),
  dr AS (SELECT recording_id, seed, unit_id, row_number() OVER (PARTITION BY recording_id, seed ORDER BY key, unit_id) AS k FROM (SELECT recording_id, unit_id, CAST(k AS INTEGER) AS seed, (unit_id * 7919 + k * 104729 + (unit_id * unit_id) % 7907 * k) % 1000003 AS key FROM positions, range(1, 101) q(k))),
  pl AS (SELECT dr.recording_id, seed, dr.unit_id, x, y FROM dr JOIN bd ON bd.recording_id = dr.recording_id AND bd.k = dr.k)"""
SUBSET = """SELECT cr.recording_id, m.seed, {side} AS side, floor(sqrt((m.x - o.x) ** 2 + (m.y - o.y) ** 2) / 5) AS bin, avg(r) AS r FROM cr JOIN pl m ON m.recording_id = cr.recording_id AND m.unit_id = cr.a JOIN pl o ON o.recording_id = cr.recording_id AND o.unit_id = cr.b AND o.seed = m.seed {where} GROUP BY ALL"""
add("n5_random_subset", lambda s, d: rounded(N.random_subset_curve(A(s, d), fx.positions(s, d), in_band(s, d), 5.0, SHUFFLES)), "traces positions",
    f"WITH {BANDED}, ps AS ({SUBSET.format(side=0, where='')}) SELECT recording_id, CAST(bin AS INTEGER) AS bin, {_r('avg(r)', 'null_mean')}, {_r('stddev_samp(r) / sqrt(count(r))', 'null_sem')} FROM ps GROUP BY 1, 2")
add("n5_random_subset_sides", lambda s, d: rounded(N.random_subset_curve(A(s, d), fx.positions(s, d), in_band(s, d), 5.0, SHUFFLES, 11.0)), "traces positions",
    f"""WITH {BANDED}, pd AS ({SUBSET.format(side='m.y >= 11', where='WHERE (m.y < 11) = (o.y < 11)')}), ps AS (SELECT recording_id, seed, bin, avg(r) AS r FROM pd GROUP BY 1, 2, 3)
        SELECT recording_id, CAST(bin AS INTEGER) AS bin, {_r('avg(r)', 'null_mean')}, {_r('stddev_samp(r) / sqrt(count(r))', 'null_sem')} FROM ps GROUP BY 1, 2""")
add("n7_common_prefix", lambda s, d: rounded(N.common_prefix(N.corr_vs_distance(A(s, d), fx.positions(s, d), 5.0), "recording_id", "bin", "r", 6)), "traces positions",
    f"""WITH {CORR}, {DIST}, c AS (SELECT cr.recording_id, CAST(floor(d / 5) AS INTEGER) AS bin, avg(r) AS r, count(r) AS pairs FROM cr JOIN ds ON cr.recording_id = ds.recording_id AND cr.a = ds.a AND cr.b = ds.b GROUP BY 1, 2)
        SELECT recording_id, bin, {_r('r', 'r')}, pairs FROM c WHERE bin <= 6 AND bin <= (SELECT min(l) FROM (SELECT max(bin) AS l FROM c GROUP BY recording_id))""")
CURVE = "c AS (SELECT cr.recording_id, floor(d / 5) * 5 + 2.5 AS x, avg(r) AS r FROM cr JOIN ds ON cr.recording_id = ds.recording_id AND cr.a = ds.a AND cr.b = ds.b GROUP BY 1, 2)"


def curves(s, d):
    """Correlation over the centres of distance bins."""
    return N.corr_vs_distance(A(s, d), fx.positions(s, d), 5.0).select("recording_id", (F.col("bin") * 5 + 2.5).alias("x"), "r")


add("n6_curve_summaries", lambda s, d: rounded(N.curve_summaries(curves(s, d), ["recording_id"], "x", "r", (5.0, 15.0), (5.0, 40.0))), "traces positions",
    f"""WITH {CORR}, {DIST}, {CURVE}, p AS (SELECT *, lag(x) OVER w AS px, lag(r) OVER w AS pr FROM c WHERE x BETWEEN 5 AND 40 WINDOW w AS (PARTITION BY recording_id ORDER BY x)), a AS (SELECT recording_id, CASE WHEN count(*) >= 2 THEN sum((x - px) * (r + pr) / 2) END AS auc FROM p GROUP BY 1)
        SELECT c.recording_id, {_r('avg(r) FILTER (x BETWEEN 5 AND 15)', 'near_mean')}, {_r('avg(r) FILTER (x BETWEEN 5 AND 40)', 'all_mean')}, {_r('any_value(auc)', 'auc')} FROM c LEFT JOIN a ON a.recording_id = c.recording_id GROUP BY 1""")


def _control(s, d):
    return N.shuffled_curve(A(s, d), fx.positions(s, d), 5.0, SHUFFLES).select("recording_id", (F.col("bin") * 5 + 2.5).alias("x"), F.col("null_mean").alias("r"))


add("n6_curve_difference", lambda s, d: rounded(N.curve_difference(curves(s, d), _control(s, d), ["recording_id"], "x", "r")), "traces positions",
    f"""WITH {CORR}, {DIST}, {CURVE}, {PERM}, mv AS (SELECT pm.recording_id, seed, pm.unit_id, x, y FROM pm JOIN positions p ON p.recording_id = pm.recording_id AND p.unit_id = pm.other),
        ps AS (SELECT cr.recording_id, m.seed, floor(sqrt((m.x - o.x) ** 2 + (m.y - o.y) ** 2) / 5) AS bin, avg(r) AS r FROM cr JOIN mv m ON m.recording_id = cr.recording_id AND m.unit_id = cr.a JOIN mv o ON o.recording_id = cr.recording_id AND o.unit_id = cr.b AND o.seed = m.seed GROUP BY ALL),
        n AS (SELECT recording_id, bin * 5 + 2.5 AS x, avg(r) AS r FROM ps GROUP BY 1, 2), df AS (SELECT c.recording_id, c.x, c.r - n.r AS dd, row_number() OVER w AS k, lag(c.x) OVER w AS px, lag(c.r - n.r) OVER w AS pd FROM c JOIN n ON n.recording_id = c.recording_id AND n.x = c.x WINDOW w AS (PARTITION BY c.recording_id ORDER BY c.x))
        SELECT recording_id, {_r('coalesce(sum((x - px) * (dd + pd) / 2), 0)', 'auc')}, {_r('avg(dd) FILTER (k <= 5)', 'near')} FROM df GROUP BY 1""")


def _own_bins(s, d):
    """Curves on places of their own, further apart from one recording to the next."""
    return curves(s, d).withColumn("x", F.col("x") * (1 + F.col("recording_id") * 0.1))


add("n8_curve_regrid", lambda s, d: rounded(N.curve_regrid(_own_bins(s, d), "recording_id", "x", "r")), "traces positions",
    f"""WITH {CORR}, {DIST}, {CURVE}, k AS (SELECT recording_id, x * (1 + recording_id * 0.1) AS x, r FROM c), g AS (SELECT x AS t FROM k WHERE recording_id = (SELECT min(recording_id) FROM k)),
        n AS (SELECT *, lead(x) OVER w AS nx, lead(r) OVER w AS nr, row_number() OVER w AS i, count(*) OVER (PARTITION BY recording_id) AS m FROM k WINDOW w AS (PARTITION BY recording_id ORDER BY x)),
        sg AS (SELECT * FROM n WHERE nx IS NOT NULL), h AS (SELECT g.t, sg.*, row_number() OVER (PARTITION BY recording_id, t ORDER BY CASE WHEN t BETWEEN x AND nx THEN 0 ELSE least(abs(t - x), abs(t - nx)) END, i) AS o FROM sg, g)
        SELECT recording_id, {_r('t', 'x')}, {_r('r + (nr - r) * (t - x) / (nx - x)', 'r')} FROM h WHERE o = 1""")
RANKS = "rn AS (SELECT *, rank() OVER (PARTITION BY recording_id ORDER BY x) + (count(*) OVER (PARTITION BY recording_id, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY recording_id ORDER BY y) + (count(*) OVER (PARTITION BY recording_id, y) - 1) / 2.0 AS ro FROM positions)"
add("n11_spatial_gradient", lambda s, d: rounded(N.spatial_gradient(fx.positions(s, d), "x", "y")), "positions", f"WITH {RANKS} SELECT recording_id, {_r('corr(ra, ro)', 'rho')}, {_r('regr_slope(x, y)', 'slope')} FROM rn GROUP BY 1")
PERMUTED = f"""rz AS (SELECT recording_id, unit_id, rank() OVER (PARTITION BY recording_id ORDER BY z) + (count(*) OVER (PARTITION BY recording_id, z) - 1) / 2.0 AS rz FROM positions),
  ax AS (SELECT recording_id, unit_id, 'x' AS axis, ra AS r FROM rn UNION ALL SELECT recording_id, unit_id, 'z', rz FROM rz), ob AS (SELECT ax.recording_id, axis, corr(r, ro) AS rho FROM ax JOIN rn ON rn.recording_id = ax.recording_id AND rn.unit_id = ax.unit_id GROUP BY 1, 2),
  nl AS (SELECT pm.recording_id, axis, seed, corr(a.r, b.ro) AS r FROM pm JOIN ax a ON a.recording_id = pm.recording_id AND a.unit_id = pm.unit_id JOIN rn b ON b.recording_id = pm.recording_id AND b.unit_id = pm.other GROUP BY 1, 2, 3),
  pp AS (SELECT nl.recording_id, nl.axis, any_value(rho) AS rho, avg(CAST(abs(r) >= abs(rho) - 1e-12 AS DOUBLE)) AS p FROM nl JOIN ob ON ob.recording_id = nl.recording_id AND ob.axis = nl.axis GROUP BY 1, 2)"""


def permuted_ranks(s, d):
    return N.permutation_test(fx.positions(s, d), ["x", "z"], "y", PERMUTATIONS)


THOUSAND = PERM.replace("range(1, 101)", "range(1, 1001)")
add("n12_permutation_test", lambda s, d: rounded(permuted_ranks(s, d)), "positions", f"WITH {RANKS}, {THOUSAND}, {PERMUTED} SELECT recording_id, axis, {_r('rho', 'rho')}, {_r('p', 'p')} FROM pp")
add("n9_kde_grid", lambda s, d: rounded(N.kde_grid(fx.positions(s, d).select("recording_id", "x", "y"), 50, 50, 4.0, 3.0).select("recording_id", "gi", "gj", "density")), "positions",
    f"""WITH g AS (SELECT recording_id, CAST(i AS INTEGER) AS gi, CAST(j AS INTEGER) AS gj, x0 + i * (x1 - x0) / 49 AS gx, y0 + j * (y1 - y0) / 49 AS gy FROM (SELECT recording_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM positions GROUP BY 1), range(50) a(i), range(50) b(j)),
        k AS (SELECT g.recording_id, gi, gj, avg(exp(-0.5 * (pow((gx - x) / 4, 2) + pow((gy - y) / 3, 2)))) AS density FROM g JOIN positions p ON p.recording_id = g.recording_id GROUP BY ALL)
        SELECT recording_id, gi, gj, {_r('density / max(density) OVER (PARTITION BY recording_id)', 'density')} FROM k""")
add("n10_kde_at_points", lambda s, d: rounded(N.kde_at_points(fx.positions(s, d), "x")), "positions",
    f"""WITH o AS (SELECT recording_id, x, row_number() OVER (PARTITION BY recording_id ORDER BY x) AS i, count(*) OVER (PARTITION BY recording_id) AS n, lead(x) OVER (PARTITION BY recording_id ORDER BY x) AS nxt FROM positions),
        h AS (SELECT recording_id, p, x + coalesce((least(greatest(p * n + 0.5, 1), n) - i) * (nxt - x), 0) AS q FROM o, (SELECT unnest([0.25, 0.75]) AS p) WHERE floor(least(greatest(p * n + 0.5, 1), n)) = i),
        b AS (SELECT h.recording_id, 1.06 * (CASE WHEN max(q) > min(q) THEN (max(q) - min(q)) / 1.349 ELSE any_value(sd) END) * pow(any_value(n), -0.2) AS bw FROM h JOIN (SELECT recording_id, stddev_samp(x) AS sd, count(*) AS n FROM positions GROUP BY 1) s ON s.recording_id = h.recording_id GROUP BY 1)
        SELECT p.recording_id, p.unit_id, {_r('avg(exp(-0.5 * pow((p.x - o.x) / bw, 2)) / (bw * sqrt(2 * pi())))', 'density')} FROM positions p JOIN b ON b.recording_id = p.recording_id JOIN positions o ON o.recording_id = p.recording_id GROUP BY 1, 2""")


def _pseudo_spectra(s, d, low, high):
    return T(s, d).filter(F.col("frame").between(low, high)).select("recording_id", "unit_id", (F.col("frame") - low).cast("double").alias("f"), F.abs("value").alias("pxx"))


add("n13_spectrum_stability", lambda s, d: rounded(N.spectrum_stability(_pseudo_spectra(s, d, 0, 31), _pseudo_spectra(s, d, 32, 63))), "traces",
    f"""WITH b AS (SELECT a.recording_id, a.unit_id, abs(a.value) AS x, abs(c.value) AS y FROM traces a JOIN traces c ON a.recording_id = c.recording_id AND a.unit_id = c.unit_id AND c.frame = a.frame + 32 WHERE a.frame < 32),
        g AS (SELECT recording_id, count(DISTINCT unit_id) AS units, avg((x - y) ** 2) AS mse, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy, greatest(max(x), max(y)) - least(min(x), min(y)) AS rg FROM b GROUP BY 1 HAVING count(DISTINCT unit_id) >= 2)
        SELECT recording_id, units, {_r('mse', 'mse')}, {_r('(2 * mx * my + (0.01 * rg) ** 2) * (2 * cxy + (0.03 * rg) ** 2) / ((mx ** 2 + my ** 2 + (0.01 * rg) ** 2) * (vx + vy + (0.03 * rg) ** 2))', 'ssim')} FROM g""")
