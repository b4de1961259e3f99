"""Registered queries of recordings on a file tree, clocks, channels and onset sources, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_core import UNITW, _r, rounded, with_
from .catalog_signal import welch_sql
from .operators import signal as R
from .operators import sorts as K
from .sources import fixtures as fx
from .sources import recordings as S
from .sources.staging import Failures, scratch

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, fn, fixtures: str = "", sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE_SQL[name] = with_(fixtures, sql.strip()) if fixtures else sql.strip()


SESSIONS = ("high", "mid", "low")


#: Trees that this session has written, by application and tables.
_TREES: dict[tuple[str, str], str] = {}


def tree(s, d) -> str:
    """A tree of recordings in the shared folder: folders that name animal and session, traces in each, events and settings in some.

    Each kind of file is one job over all recordings; folders then get their names, and queries share the tree.
    """
    key = (s.sparkContext.applicationId, d)
    if key not in _TREES:
        root, r = scratch(s, "tree"), F.col("_r")
        at = [F.when(r % 3 == 2, "explant").otherwise("invivo").alias("_prep"), F.format_string(f"fish_%02d_%sact", r, F.element_at(F.array(*map(F.lit, SESSIONS)), (r % 3 + 1).cast("int"))).alias("_name")]
        arrays, train = fx.trace_arrays(s, d), fx.event_train(s, d)
        known = arrays.select(F.col("recording_id").alias("_r")).distinct()
        even = known.filter("_r % 2 = 0")
        events = even.join(train, F.col("recording_id") == F.col("_r") % 5)
        settings = even.select("_r", F.format_string("power = 3\nvolume.frame.rate = %d.5\n", (r + 1).cast("int")).alias("value"))
        for kind, rows in (("dff", arrays.withColumn("_r", F.col("recording_id"))), ("tail", events), ("settings", settings)):
            rows.select("*", *at).drop("_r").repartition("_name").write.partitionBy("_prep", "_name").format("text" if kind == "settings" else "parquet").save(f"{root}/.{kind}")
            _named(s, root, kind)
        _TREES[key] = root
    return _TREES[key]


def _named(s, root: str, kind: str) -> None:
    """Moves the folders that a partitioned write made to the names of a tree of recordings."""
    path = s._jvm.org.apache.hadoop.fs.Path
    made = path(f"{root}/.{kind}")
    files = made.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for one in files.globStatus(path(f"{root}/.{kind}/_prep=*/_name=*")):
        own = one.getPath()
        folder = path(f"{root}/{own.getParent().getName().split('=')[1]}/{own.getName().split('=')[1]}")
        files.mkdirs(folder)
        files.rename(own, path(folder, kind))
    files.delete(made, True)


def parts(s, root: str, kind: str):
    """(path, folder, ...) of the files of one kind; the folder is the recording's."""
    files = S.list_files(s, root, "part-*").filter(F.col("folder").endswith(f"/{kind}"))
    return files.withColumn("folder", F.regexp_replace("folder", "/[^/]*$", ""))


def attributes(df):
    a = S.path_attributes(df, "folder")
    return a.select("subject", "session", "prep", F.regexp_replace("label", ".*/tree-[0-9a-f]+/", "").alias("label"))


REC = "(SELECT DISTINCT label AS r FROM embeddings)"
ATTR = """CAST(r AS INTEGER) AS subject, CASE r % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS session, CASE WHEN r % 3 = 2 THEN 'explant' ELSE 'invivo' END AS prep"""
NAME = "CASE WHEN r % 3 = 2 THEN 'explant' ELSE 'invivo' END || '/fish_' || lpad(CAST(r AS VARCHAR), 2, '0') || '_' || CASE r % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END || 'act'"


def scanned(s, d):
    return S.scan_recordings(s, tree(s, d), "part-*.parquet").filter("path like '%/dff/%'")


add("s1_scan_recordings", lambda s, d: scanned(s, d).groupBy(F.regexp_extract("path", "fish_([0-9]+)_", 1).cast("int").alias("subject")).agg(F.count("*").alias("units"), F.sum(F.size("trace")).alias("frames")), "",
    "SELECT CAST(label AS INTEGER) AS subject, count(*) AS units, CAST(sum(len(embedding)) AS BIGINT) AS frames FROM embeddings GROUP BY 1")


def paired_folders(s, d):
    """Folders with both traces and events."""
    root = tree(s, d)
    both = parts(s, root, "dff").withColumn("name", F.lit("dff.parquet")).unionByName(parts(s, root, "tail").withColumn("name", F.lit("tail.parquet")))
    return S.pair_files(both, "dff.parquet", "tail.parquet")


add("s2_pair_files", lambda s, d: attributes(paired_folders(s, d)).select("subject", "session"), "", f"SELECT {ATTR.rsplit(', CASE', 1)[0]} FROM {REC} WHERE r % 2 = 0")
add("s3_path_attributes", lambda s, d: attributes(parts(s, tree(s, d), "dff")).withColumn("label", F.regexp_extract("label", "[^/]*/fish.*$", 0)), "", f"SELECT {ATTR}, {NAME} AS label FROM {REC}")


def odd_columns(s, d):
    """Traces under different names: top-level for some units, inside a struct for others."""
    e = fx.trace_arrays(s, d)
    own = F.when(F.col("unit_id") % 3 == 0, F.col("trace"))
    return e.select("recording_id", "unit_id", own.alias("DFF"), F.struct(F.when(F.col("unit_id") % 3 != 0, F.col("trace")).alias("dff")).alias("results"))


add("s4_resolve_column", lambda s, d: rounded(S.resolve_column(odd_columns(s, d), ["dff"], "trace").select("recording_id", "unit_id", F.posexplode("trace").alias("frame", "value"))), "traces", f"SELECT recording_id, unit_id, frame, {_r('value', 'value')} FROM traces")


def rates(s, d):
    """Recordings with a rate of their own, or one in their settings, or none."""
    root = tree(s, d)
    rec = parts(s, root, "dff").select("folder").distinct()
    r = F.regexp_extract("folder", "fish_([0-9]+)_", 1).cast("int")
    rec = rec.withColumn("subject", r).withColumn("rate", F.when(r % 3 == 1, r + 2.0))
    settings = s.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").text(root)
    ini = settings.select(F.regexp_replace(F.col("_metadata.file_path"), "/settings/[^/]*$", "").alias("folder"), F.col("value").alias("text"))
    plain = lambda df: df.withColumn("folder", F.regexp_extract("folder", "fish_.*$", 0))
    return S.resolve_fps(plain(rec), ["rate"], plain(ini))


add("s5_resolve_fps", lambda s, d: rates(s, d).select("subject", "fps"), "", f"SELECT CAST(r AS INTEGER) AS subject, CAST(CASE WHEN r % 3 = 1 THEN r + 2.0 WHEN r % 2 = 0 THEN r + 1.5 ELSE 14.64 END AS DOUBLE) AS fps FROM {REC}")


def newest(s, d):
    """Per session the file of the preferred preparation, then of the larger subject."""
    files = S.path_attributes(parts(s, tree(s, d), "dff"), "folder")
    return S.latest_file(files, ["prep"], F.when(F.col("session") == "mid", 0).otherwise(1), F.desc("subject"))


add("s6_latest_file", lambda s, d: newest(s, d).select("prep", "session", "subject"), "", f"SELECT prep, session, subject FROM (SELECT *, row_number() OVER (PARTITION BY prep ORDER BY CASE WHEN session = 'mid' THEN 0 ELSE 1 END, subject DESC) AS k FROM (SELECT {ATTR} FROM {REC})) WHERE k = 1")


def timed(s, d):
    """Units with a clock of their own, with one of another length, or with only a rate."""
    e = fx.trace_arrays(s, d).withColumn("fps", F.when(F.col("unit_id") % 5 != 4, F.lit(fx.FPS)))
    clock = F.transform("trace", lambda x, i: i * 0.25)
    return S.time_vector(e.withColumn("times", F.when(F.col("unit_id") % 5 == 0, clock).when(F.col("unit_id") % 5 == 1, F.slice(clock, 1, 9))), "trace", ["times"])


add("s7_time_vector", lambda s, d: rounded(timed(s, d).select("recording_id", "unit_id", F.posexplode("t").alias("frame", "t"))), "traces", f"SELECT recording_id, unit_id, frame, {_r('CASE WHEN unit_id % 5 = 0 THEN frame * 0.25 ELSE frame / 2.0 END', 't')} FROM traces WHERE unit_id % 5 <> 4")


def summary_read_back(s, d):
    """A summary written as CSV and as Parquet, both read back."""
    out = scratch(s, "summary")
    mean = fx.traces(s, d).groupBy("recording_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    S.write_summary(mean, f"{out}/csv", "csv")
    S.write_summary(mean, f"{out}/parquet")
    csv = s.read.option("header", True).csv(f"{out}/csv").select(F.lit("csv").alias("kind"), F.col("recording_id").cast("int").alias("recording_id"), F.col("mean").cast("double").alias("mean"), F.col("n").cast("long").alias("n"))
    return csv.unionByName(s.read.parquet(f"{out}/parquet").select(F.lit("parquet").alias("kind"), F.col("recording_id").cast("int").alias("recording_id"), "mean", "n"))


add("s8_write_summary", lambda s, d: rounded(summary_read_back(s, d)), "traces", f"SELECT kind, CAST(recording_id AS INTEGER) AS recording_id, {_r('avg(value)', 'mean')}, count(*) AS n FROM traces, (SELECT unnest(['csv', 'parquet']) AS kind) GROUP BY 1, 2")


def failed(s, d):
    """Traces of which some are empty or missing: the reasons on the one side, results on the other."""
    e = fx.trace_arrays(s, d).withColumn("trace", F.when(F.col("unit_id") % 10 == 3, F.slice("trace", 1, 0)).when(F.col("unit_id") % 10 != 7, F.col("trace")))
    good, bad = S.split_errors(R.acf(e, 4))
    return bad.select("recording_id", "unit_id", "error").unionByName(good.select("recording_id", "unit_id", F.lit("none").alias("error")))


add("s9_error_isolation", failed, "positions", "SELECT recording_id, unit_id, CASE unit_id % 10 WHEN 3 THEN 'empty trace' WHEN 7 THEN 'no trace' ELSE 'none' END AS error FROM positions")



def all_failures(s, d):
    """What five operators could not work on, from one table."""
    log = Failures()
    e = fx.trace_arrays(s, d).withColumn("trace", F.when(F.col("unit_id") % 10 == 3, F.slice("trace", 1, 0)).when(F.col("unit_id") % 10 != 7, F.col("trace")))
    R.welch_spectra(e, fx.FPS, 32, 16, 32, failed=log)
    R.long_acf(e, 4, failed=log)
    R.peak_list(e, failed=log)
    R.period_acf(e.withColumn("period", F.lit(0)), 8, 5, failed=log)
    R.windowed_peak_freq(e, fx.FPS, 32, 16, 0.1, 0.9, failed=log)
    return log.table(s).select("operator", F.col("keys")["recording_id"].alias("recording_id"), F.col("keys")["unit_id"].alias("unit_id"), "error")


add("s9_failures", all_failures, "positions",
    """SELECT operator, CAST(recording_id AS VARCHAR) AS recording_id, CAST(unit_id AS VARCHAR) AS unit_id, CASE WHEN unit_id % 10 = 7 THEN 'no trace' WHEN operator = 'windows' THEN 'shorter than a window' ELSE 'empty trace' END AS error
       FROM positions, (SELECT unnest(['welch', 'acf', 'peaks', 'period acf', 'windows']) AS operator) WHERE unit_id % 10 IN (3, 7)""")


def nameless(s, d):
    """Recordings with matrices under names that nobody lists: whole traces for odd recordings, beginnings for all, and a flat one of full size."""
    e = fx.trace_arrays(s, d)
    whole = F.when(F.col("recording_id") % 2 == 1, F.col("trace"))
    return e.select("recording_id", "unit_id", F.transform("trace", lambda x: F.lit(0.5)).alias("flat"), F.slice("trace", 1, 10).alias("part"), F.struct(whole.alias("m")).alias("deep"))


add("s4_best_matrix", lambda s, d: rounded(S.best_matrix(nameless(s, d), ["recording_id"], "trace").select("recording_id", "unit_id", "trace_name", F.posexplode("trace").alias("frame", "value"))), "traces",
    f"SELECT recording_id, unit_id, CASE WHEN recording_id % 2 = 1 THEN 'deep.m' ELSE 'part' END AS trace_name, frame, {_r('value', 'value')} FROM traces WHERE recording_id % 2 = 1 OR frame < 10")
add("s4_matrix_profiles", lambda s, d: rounded(S.matrix_profiles(nameless(s, d), ["recording_id"])), "traces",
    f"""WITH m AS (SELECT recording_id, unit_id, 'flat' AS name, 0 AS place, 0.5 AS v FROM traces UNION ALL SELECT recording_id, unit_id, 'part', 1, value FROM traces WHERE frame < 10 UNION ALL SELECT recording_id, unit_id, 'deep.m', 2, value FROM traces WHERE recording_id % 2 = 1)
        SELECT r.recording_id, n.name, n.place, count(DISTINCT unit_id) AS rows, count(v) AS values, count(v) AS known, {_r('max(v) - min(v)', 'spread')} FROM (SELECT DISTINCT recording_id FROM traces) r CROSS JOIN (SELECT DISTINCT name, place FROM m) n LEFT JOIN m ON m.recording_id = r.recording_id AND m.name = n.name GROUP BY 1, 2, 3""")

# clocks and channels


def clocks(s, d):
    """Event hours as raw frame times, and settings that some recordings lack."""
    frames = fx.event_train(s, d).select("recording_id", F.col("frame").cast("double").alias("t")).distinct()
    r = F.col("recording_id")
    sync = frames.select("recording_id").distinct().select("recording_id", F.when(r != 1, 1 + r * 0.01).alias("scale"), F.when(r != 2, r * 2.0).alias("delay"), F.when(r != 3, F.lit(20.25)).alias("start"), F.when(r != 3, F.lit(300.0)).alias("end"))
    return R.synced_clock(frames, sync)


CLOCK = """fr AS (SELECT DISTINCT recording_id, frame * coalesce(CASE WHEN recording_id <> 1 THEN 1 + recording_id * 0.01 END, 1) + coalesce(CASE WHEN recording_id <> 2 THEN recording_id * 2.0 END, 0) AS t FROM ev),
  se AS (SELECT *, CASE WHEN recording_id <> 3 THEN 20.25 ELSE min(t) OVER (PARTITION BY recording_id) END AS a, CASE WHEN recording_id <> 3 THEN 300.0 ELSE max(t) OVER (PARTITION BY recording_id) END AS b FROM fr),
  st AS (SELECT *, t - lag(t) OVER w AS dt, t > a AND t <= b AND lag(t > a AND t <= b) OVER w AS ok FROM se WINDOW w AS (PARTITION BY recording_id ORDER BY t)), ra AS (SELECT recording_id, a, b, 1 / coalesce(median(dt) FILTER (ok), median(dt)) AS rate FROM st GROUP BY 1, 2, 3)"""
add("r2_synced_clock", lambda s, d: rounded(clocks(s, d)[1], 5), "ev",
    f"WITH {CLOCK} SELECT recording_id, CAST(k AS INTEGER) AS k, round(a + k / rate, 5) + 0.0 AS t, round(rate, 5) + 0.0 AS rate FROM ra, range(2000) q(k) WHERE k <= floor((b - a) * rate + 1e-9)")


def channels(s, d):
    """(subject_id, channel, frame, value): hourly sums of each kind of event on all hours."""
    e = fx.event_train(s, d).filter(F.col("frame").between(0, fx.EVENT_FRAMES - 1))
    sums = e.groupBy(F.col("recording_id").alias("subject_id"), F.col("kind").alias("channel"), "frame").agg(F.sum("amp").alias("value"))
    hours = e.select(F.col("recording_id").alias("subject_id"), F.col("kind").alias("channel")).distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(fx.EVENT_FRAMES - 1))))
    return hours.join(sums, ["subject_id", "channel", "frame"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def bands(s):
    return s.createDataFrame([("click", "angle", 0.2, 0.9), ("error", "raw", 0.1, 0.6), ("purchase", "raw", 0.05, 0.5), ("view", "raw", 0.1, 0.9)], "channel string, mode string, low double, high double")


CHANNELS = """hr AS (SELECT DISTINCT recording_id AS subject_id, kind AS channel FROM ev WHERE frame BETWEEN 0 AND 719), ch AS (SELECT h.subject_id, h.channel, CAST(k AS INTEGER) AS frame, coalesce(sum(amp), 0) AS value FROM hr h CROSS JOIN range(720) q(k) LEFT JOIN ev e ON e.recording_id = h.subject_id AND e.kind = h.channel AND e.frame = k GROUP BY 1, 2, 3)"""
CW = "(PARTITION BY subject_id, channel ORDER BY frame"
CHANNEL_FREQ = f"""bd AS (SELECT * FROM (VALUES ('click', 'angle', 0.2, 0.9), ('error', 'raw', 0.1, 0.6), ('purchase', 'raw', 0.05, 0.5), ('view', 'raw', 0.1, 0.9)) t(channel, mode, low, high)),
  sm AS (SELECT subject_id, channel, frame, mode, avg(CASE WHEN mode = 'angle' THEN value ELSE abs(value) END) OVER {CW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM ch JOIN bd USING (channel)),
  av AS (SELECT subject_id, channel, frame, CASE WHEN mode = 'angle' THEN abs(coalesce((lead(v) OVER {CW}) - lag(v) OVER {CW})) / 2, lead(v) OVER {CW}) - v, v - lag(v) OVER {CW}))) * 2 ELSE v END AS value FROM sm)"""
add("e21_channel_domfreq", lambda s, d: rounded(R.channel_domfreq(channels(s, d), bands(s), fx.FPS, 64, 64, 3, ["subject_id"]), 5), "ev",
    f"""WITH {CHANNELS}, {CHANNEL_FREQ}, {welch_sql('av', 'subject_id, channel', 64, 21, 'sp')}
        SELECT subject_id, channel, round(f, 5) + 0.0 AS dom, round(pxx, 5) + 0.0 AS power FROM (SELECT subject_id, channel, f, pxx, row_number() OVER (PARTITION BY subject_id, channel ORDER BY pxx DESC, f) AS o FROM sp JOIN bd USING (channel) WHERE f BETWEEN low AND high) WHERE o = 1""")


def on_neural_clock(s, d):
    """Each session's hourly sums and their speed on a clock of 0.4 samples an hour, sessions in a row."""
    sig = fx.signals(s, d).withColumn("recording_id", F.concat_ws("/", "subject_id", "cond"))
    fast = R.speed(sig, 3, 1.0, ["recording_id"]).select("recording_id", F.col("frame").cast("double").alias("t"), F.lit("speed").alias("channel"), F.col("speed").alias("value"))
    plain = sig.select("recording_id", F.col("frame").cast("double").alias("t"), F.lit("sum").alias("channel"), "value")
    clock = sig.select("recording_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(95)))).select("recording_id", (F.col("k") * 2.5).alias("t"))
    on = R.on_clock(plain.unionByName(fast), clock, ["channel"])
    parts_ = F.split("recording_id", "/")
    rows = on.select(parts_[0].cast("long").alias("subject_id"), parts_[1].alias("cond"), "channel", "t", "value")
    return K.sessions_on_one_clock(rows, ["subject_id", "channel"], "cond", list(SESSIONS), step=2.5)


SW = "(PARTITION BY subject_id, cond ORDER BY frame"
add("e22_ethogram_resample", lambda s, d: rounded(on_neural_clock(s, d)), "sig",
    f"""WITH m AS (SELECT *, avg(value) OVER {SW} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM sig), g AS (SELECT subject_id, cond, frame, value, abs(coalesce((lead(v) OVER {SW}) - lag(v) OVER {SW})) / (lead(frame) OVER {SW}) - lag(frame) OVER {SW})), (lead(v) OVER {SW}) - v) / (lead(frame) OVER {SW}) - frame), (v - lag(v) OVER {SW})) / (frame - lag(frame) OVER {SW})))) AS sp FROM m),
        c AS (SELECT subject_id, cond, 'sum' AS channel, CAST(frame AS DOUBLE) AS t, value AS v FROM g UNION ALL SELECT subject_id, cond, 'speed', CAST(frame AS DOUBLE), sp FROM g),
        n AS (SELECT *, lead(t) OVER w AS nt, lead(v) OVER w AS nv, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY subject_id, cond, channel ORDER BY t)), sg AS (SELECT * FROM n WHERE nt IS NOT NULL),
        h AS (SELECT k * 2.5 AS x, sg.*, row_number() OVER (PARTITION BY subject_id, cond, channel, k ORDER BY CASE WHEN k * 2.5 BETWEEN t AND nt THEN 0 ELSE least(abs(k * 2.5 - t), abs(k * 2.5 - nt)) END, i) AS o FROM sg, range(96) q(k)),
        y AS (SELECT subject_id, cond, channel, x, v + (nv - v) * (x - t) / (nt - t) AS value FROM h WHERE o = 1), l AS (SELECT subject_id, channel, cond, max(x) + 2.5 AS len, list_position(['high', 'mid', 'low'], cond) AS p FROM y GROUP BY 1, 2, 3),
        s AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY subject_id, channel ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM l)
        SELECT y.subject_id, y.cond, y.channel, round(x + shift, 6) + 0.0 AS t, round(value, 6) + 0.0 AS value FROM y JOIN s USING (subject_id, channel, cond)""")


def onset_sources(s, d):
    """Recordings that hold their onsets as frames, as seconds, as a train, or only as a tail trace."""
    e = fx.event_train(s, d).filter(F.col("frame").between(0, fx.EVENT_FRAMES - 1))
    hours = F.sort_array(F.collect_set("frame"))
    sums = e.groupBy("recording_id", "frame").agg(F.sum("amp").alias("v"))
    grid = e.select("recording_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(fx.EVENT_FRAMES - 1)))).join(sums, ["recording_id", "frame"], "left")
    arrays = grid.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("frame", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("g")).select("recording_id", F.col("g.v").alias("tail"))
    listed = e.groupBy("recording_id").agg(hours.alias("hours"))
    r = F.col("recording_id")
    return arrays.join(listed, "recording_id").select(
        "recording_id", F.lit(fx.EVENT_FRAMES).alias("n_frames"), F.when(r == 0, F.col("hours")).when(r == 1, F.transform("hours", lambda x: x * 100)).alias("onset_frames"), F.when(r == 1, F.transform("hours", lambda x: x / 2.0)).alias("onset_seconds"),
        F.when(r == 2, F.transform("tail", lambda x: F.when(x > 400, 1.0).otherwise(0.0))).alias("train"), F.when(r >= 3, F.col("tail")).alias("tail"),
    )


_G = {i: f"exp(-0.5 * pow({i} / 1.0, 2))" for i in range(-2, 3)}
_SMOOTH = "(" + " + ".join(f"coalesce(lead(v, {i}) OVER w * {g}, 0)" for i, g in _G.items()) + ") / (" + " + ".join(f"CASE WHEN lead(v, {i}) OVER w IS NULL THEN 0 ELSE {g} END" for i, g in _G.items()) + ")"
add("r27_onset_precedence", lambda s, d: R.bout_onsets(onset_sources(s, d), 2.0), "ev",
    f"""WITH gd AS (SELECT r.recording_id, CAST(k AS INTEGER) AS frame, coalesce(sum(amp), 0) AS v FROM (SELECT DISTINCT recording_id FROM ev) r CROSS JOIN range(720) q(k) LEFT JOIN ev e ON e.recording_id = r.recording_id AND e.frame = k GROUP BY 1, 2),
        tn AS (SELECT recording_id, frame, v > 400 AS act, lag(v > 400) OVER w AS was FROM gd WHERE recording_id = 2 WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
        sm AS (SELECT recording_id, frame, {_SMOOTH} AS s FROM gd WHERE recording_id >= 3 WINDOW w AS (PARTITION BY recording_id ORDER BY frame)), th AS (SELECT recording_id, median(s) + 2 * mad(s) AS th FROM sm GROUP BY 1),
        on_ AS (SELECT recording_id, frame, s > th AS act, lag(s > th) OVER (PARTITION BY recording_id ORDER BY frame) AS was FROM sm JOIN th USING (recording_id)), rn AS (SELECT *, sum(CAST(act AND NOT coalesce(was, false) AS INTEGER)) OVER (PARTITION BY recording_id ORDER BY frame) AS run FROM on_)
        SELECT DISTINCT recording_id, frame, 'frames' AS source FROM ev WHERE recording_id = 0 AND frame BETWEEN 0 AND 719 UNION ALL SELECT DISTINCT recording_id, frame, 'seconds' FROM ev WHERE recording_id = 1 AND frame BETWEEN 0 AND 719
        UNION ALL SELECT recording_id, frame, 'train' FROM tn WHERE act AND NOT coalesce(was, false) UNION ALL SELECT recording_id, min(frame), 'tail' FROM rn WHERE act GROUP BY recording_id, run HAVING count(*) >= 2""")
