"""What a query does on inputs and at sizes that the given tables do not reach."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill import catalog_events as C
from tracemill.functions import kernels as k
from tracemill.operators import events as E
from tracemill.operators import joins as J
from tracemill.operators import latent as L
from tracemill.operators import pairs as N
from tracemill.operators import stats as S


def test_change_correlation_without_spread(spark):
    # the change in activity is the same in every recording
    features = spark.createDataFrame([(r, label, u, float(r * u if label == "high" else 0)) for r in range(4) for u in range(3) for label in ("low", "high")], "recording_id int, label string, unit_id int, rate double")
    activity = spark.createDataFrame([(r, label, 5.0 if label == "high" else 2.0) for r in range(4) for label in ("low", "high")], "recording_id int, label string, activity double")
    (row,) = E.change_correlation(features, activity, "rate").collect()
    assert math.isnan(row.r) and row.n == 4 and row.p is None


def test_gradient_without_spread(spark):
    units = spark.createDataFrame([(0, u, 1.0, float(u)) for u in range(4)], "recording_id int, unit_id int, x double, y double")
    (row,) = N.spatial_gradient(units, "x", "y").collect()
    assert math.isnan(row.rho) and row.slope == 0.0


def _many(spark, gaps: bool):
    """Two recordings of 40 units on nine places, one of them with other lengths and, if told, missing values and a unit without spread."""
    rng = np.random.default_rng(5)
    rows = []
    for rec in range(2):
        for u in range(40):
            x = rng.normal(size=12 if rec and u % 10 == 3 else 16).tolist()
            if gaps and u % 8 == 1:
                x[u % 5] = None
            if gaps and u == 4:
                x = [2.5] * 16
            rows.append((rec, u, x, float(u % 3 * 4), None if u == 7 else float(u % 9 // 3 * 5)))
    arrays = spark.createDataFrame([r[:3] for r in rows], "recording_id int, unit_id long, trace array<double>")
    return arrays, spark.createDataFrame([(r[0], r[1], r[3], r[4]) for r in rows], "recording_id int, unit_id long, x double, y double"), rows


def _brute(rows, step, place, split=None):
    """Sums and counts per recording, side and bin, pair by pair."""
    out: dict = {}
    for i, (rec, u, x, *_) in enumerate(rows):
        for other, v, y, *_ in rows[:i]:
            p, q = place(rec, u), place(rec, v)
            if rec != other or p is None or q is None or None in (*p, *q):
                continue
            both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
            a, b = (np.array(c) for c in zip(*both))
            if np.ptp(a) == 0 or np.ptp(b) == 0 or (split is not None and (p[1] >= split) != (q[1] >= split)):
                continue
            key = (rec, 0 if split is None else int(p[1] >= split), int(math.hypot(p[0] - q[0], p[1] - q[1]) // step))
            total, n = out.get(key, (0.0, 0))
            out[key] = (total + np.corrcoef(a, b)[0, 1], n + 1)
    return out


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("split", [None, 4.0])
def test_sums_by_place_equal_sums_by_pair(spark, monkeypatch, gaps, split):
    arrays, positions, rows = _many(spark, gaps)
    want = _brute(rows, 3.0, lambda r, u: rows[r * 40 + u][3:5], split)
    units = arrays.join(positions.select("recording_id", "unit_id", F.array("x").alias("xs"), F.array("y").alias("ys")), ["recording_id", "unit_id"])
    for tile, by_place in ((256, True), (4, True), (4, False), (256, None)):
        for name, value in (("TILE", tile), ("PLACES", tile), ("PLACED", 4 * tile)):
            monkeypatch.setattr(N, name, value)
        got = {(r.recording_id, r.side, r.bin): (r.total, r.n) for r in N._distance_sums(units, 3.0, split, None, by_place).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_random_subset_holds_no_list_of_the_band(spark):
    # a drawn row carries its own place only: its width does not grow with the band
    arrays, positions, rows = _many(spark, False)
    drawn = N.random_subsets(positions, positions.filter("unit_id % 2 = 0"), 3)
    found = drawn.collect()
    assert not any("array" in t for _, t in drawn.dtypes) and len(found) == 2 * 3 * 20
    assert "collect_list" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.recording_id, r.seed) for r in found} == {(r, s) for r in range(2) for s in (1, 2, 3)}
    assert all(r.unit_id % 2 == 0 for r in found)


def test_pair_rows_are_copied_for_few_blocks(spark):
    # 600 units in tiles of 8 would be 75 blocks of their own
    rows = [(0, u, [float(u % 7), float(u % 11), float(u % 5)]) for u in range(600)]
    arrays = spark.createDataFrame(rows, "recording_id int, unit_id long, trace array<double>")
    seen = spark.sparkContext.accumulator(0)

    def kernel(a, b, r, count):
        seen.add(len(a["unit_id"]) + len(b["unit_id"]))
        return {"n": [int(count.sum())]}

    pairs = N.block_pairs(arrays, kernel, {"n": ("long", pa.int64())})
    lanes = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.agg(F.sum("n")).first()[0] == 600 * 599 // 2 and "_meets" in lanes
    blocks = arrays.groupBy("recording_id").agg(N._blocks_for(F.lit(60_000), F.lit(64), None).alias("few"), N._blocks_for(F.lit(600_000_000), F.lit(64), None).alias("many")).first()
    assert blocks.few == 16 and 600_000_000 / blocks.many * 64 * 8 <= N.BLOCK_BYTES


def test_split_reliability_of_whole_rows(spark):
    """Missing values, frames that one block lacks and a unit without spread, against the definition."""
    rng = np.random.default_rng(2)
    cells = {side: {(s, u, f): (1.0 if u == 5 else None if (u + f) % 7 == 0 else float(rng.normal())) for s in range(2) for u in range(9) for f in range(6) if (u, f) != (3, side)} for side in (0, 1)}
    first, second = (spark.createDataFrame([(*key, v) for key, v in cells[side].items()], "subject_id int, unit_id long, rel_frame int, value double") for side in (0, 1))

    def corr(s, u, v):
        both = [(cells[0][s, u, f], cells[1][s, v, f]) for f in range(6) if cells[0].get((s, u, f)) is not None and cells[1].get((s, v, f)) is not None]
        a, b = (np.array(c) for c in zip(*both))
        return np.corrcoef(a, b)[0, 1] if np.ptp(a) > 0 and np.ptp(b) > 0 else math.nan

    table = E.split_reliability(first, second, 5)
    joins = [line for line in table._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert not any(c in line for line in joins for c in ("other#", "rel_frame#", "unit_id#"))
    for r in table.collect():
        units = sorted(range(9))
        key = lambda u, seed: (u * 7919 + seed * 104729 + u * u % 7907 * seed) % 1000003
        null = np.mean([corr(r.subject_id, r.unit_id, sorted(units, key=lambda u: (key(u, seed), u))[r.unit_id]) for seed in range(1, 6)])
        assert np.allclose([r.r, r.null_r], [corr(r.subject_id, r.unit_id, r.unit_id), null], atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("gaps", [False, True])
def test_cluster_sums_by_vectors_equal_sums_by_pair(spark, monkeypatch, gaps):
    arrays, _, rows = _many(spark, gaps)
    monkeypatch.setattr(L, "block_pairs", lambda units, *more, **named: pairs.append(named.get("loose")) or N.block_pairs(units, *more, **named))
    pairs: list = []
    clusters = spark.createDataFrame([(r, str(k), u, u * 7 % k) for r in range(2) for u in range(38) for k in (2, 3)], "recording_id int, solution string, unit_id long, cluster int")
    want: dict = {}
    for rec, u, x, *_ in rows:
        for other, v, y, *_ in rows:
            if rec != other or u == v or max(u, v) > 37:
                continue
            a, b = (np.array(c) for c in zip(*[(p, q) for p, q in zip(x, y) if p is not None and q is not None]))
            if np.ptp(a) == 0 or np.ptp(b) == 0:
                continue
            for k in (2, 3):
                key = (rec, str(k), u, u * 7 % k, v * 7 % k)
                total, n = want.get(key, (0.0, 0))
                want[key] = (total + np.corrcoef(a, b)[0, 1], n + 1)
    got = {(r.recording_id, r.solution, r.u, r.cu, r.cv): (r.r, r.n) for r in L.cluster_sums(arrays, clusters).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert all(p == "loose" for p in pairs)  # never all pairs
    # whole traces of equal length need no pairs at all
    pairs.clear()
    L.cluster_sums(arrays.filter("size(trace) = 16 and not exists(trace, x -> x is null)"), clusters).count()
    assert not pairs


def test_pairs_of_one_recording_go_to_many_tasks(spark):
    units = spark.createDataFrame([(0, u, float(u % 10)) for u in range(200)], "recording_id int, unit_id long, x double")
    for table, want in ((J.unit_pairs(units, ["x"]), {(a, b) for a in range(200) for b in range(a + 1, 200)}), (J.rectangle_pairs(units, ["x"], F.col("x") < 5), {(a, b) for a in range(200) for b in range(200) if a % 10 < 5 <= b % 10})):
        found = [(r.a, r.b) for r in table.collect()]
        assert len(found) == len(want) and set(found) == want
        assert "_p" in table._jdf.queryExecution().optimizedPlan().toString()


def test_prominence_compared_at_six_digits():
    # r21's SQL lists prominences with six digits and compares those with half the MAD
    x = np.array([0.0, 0.0240414, 0.0, 1.0, 0.0])
    assert k.find_peaks(x, prominence=0.0240419)[0].tolist() == [3]
    assert k.find_peaks(x, prominence=0.0240419, digits=6)[0].tolist() == [3]
    x[1] = 0.024041626
    assert k.find_peaks(x, prominence=0.0240419)[0].tolist() == [3]
    assert k.find_peaks(x, prominence=0.0240419, digits=6)[0].tolist() == [1, 3]


@pytest.mark.parametrize("sent", [1 << 28, 0])
def test_kmeans_sends_its_centres_once_a_pass(spark, monkeypatch, sent):
    """Against the definition, start by start; centres are broadcast once per recording, or not at all where they are large."""
    rng = np.random.default_rng(8)
    traces = {(r, u): rng.normal(size=10 + r) + 2 * np.sin(np.arange(10 + r) * (1 + u % 3)) for r in range(2) for u in range(3 if r else 150)}
    arrays = spark.createDataFrame([(*at, x.tolist()) for at, x in traces.items()], "recording_id int, unit_id long, trace array<double>")
    seen: list = []
    keep = L.staged
    monkeypatch.setattr(L, "staged", lambda spark, df, label: (label == "kmeans-centres" and seen.append(df._jdf.queryExecution().executedPlan().toString())) or keep(spark, df, label))
    monkeypatch.setattr(L, "SENT_BYTES", sent)
    ks, seeds, want = [2, 5], 3, {}
    got = {(r.recording_id, r.k, r.unit_id): r.cluster for r in L.kmeans_rows(arrays, ks, seeds).collect()}
    assert len(seen) > 2 and all(("BroadcastExchange" in p, "explode" in p) == (sent > 0, sent == 0) for p in seen[1:])
    # n34_ensembles makes up to 200 passes: one exchange of the sums and one of the centres in each (and the join's two)
    assert all(p.count("Exchange hashpartitioning") <= (2 if sent else 4) for p in seen[1:])
    order = arrays.select("recording_id", "unit_id", F.explode(F.lit(np.arange(seeds).tolist())).alias("seed")).withColumn("h", F.xxhash64("unit_id", F.col("seed").cast("int"))).collect()
    for rec in range(2):
        units = sorted(u for r, u in traces if r == rec)
        x = np.array([traces[rec, u] - traces[rec, u].mean() for u in units])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for k in ks:
            ends = []
            for seed in range(seeds):
                first = [units.index(u) for _, u in sorted((r.h, r.unit_id) for r in order if r.recording_id == rec and r.seed == seed)][:k]
                centres, own = x[first], None
                while own is None or (own != (x @ centres.T).argmax(axis=1)).any():
                    own = (x @ centres.T).argmax(axis=1)
                    sums = np.array([x[own == c].sum(axis=0) for c in range(len(centres))])
                    norm = np.linalg.norm(sums, axis=1, keepdims=True)
                    centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-300), centres)
                ends.append((round(float((1 - (x @ centres.T).max(axis=1)).sum()), 9), seed, own))
            want |= {(rec, k, u): int(c) for u, c in zip(units, min(ends, key=lambda e: e[:2])[2])}
    assert got == want


def test_noise_of_a_trace_is_found_once(spark, tmp_path):
    """The noise model reads its scaled traces many times; the kernel behind them runs once per trace, and the transients meet no long table."""
    import __spark_entry__

    rng = np.random.default_rng(4)
    rows = [(u, rng.normal(size=64).tolist(), u % 2) for u in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    seen = spark.sparkContext.accumulator(0)
    keep = E.baseline_noise

    def counted(arrays):
        noted = keep(arrays)
        return noted.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), noted.schema)

    E.baseline_noise = counted
    try:
        table = __spark_entry__.queries()["e7_significant_transients"](spark, str(tmp_path))
        table.collect()
    finally:
        E.baseline_noise = keep
    assert seen.value == 30
    assert "SortMergeJoin" not in table._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


@pytest.mark.parametrize("gaps", [False, True])
def test_whole_units_are_evaluated_without_sums_by_unit(spark, monkeypatch, gaps):
    """Silhouettes and coherence by block equal those from the sums of each unit with each cluster, which only loose units need."""
    arrays, *_ = _many(spark, gaps)
    arrays = arrays if gaps else arrays.filter("size(trace) = 16 and not exists(trace, x -> x is null)")
    labels: list = []
    keep = L.staged
    monkeypatch.setattr(L, "staged", lambda spark, df, label: labels.append(label) or keep(spark, df, label))
    clusters = arrays.filter("unit_id <= 37").select("recording_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("solution"), "unit_id").withColumn("cluster", F.expr("case when unit_id = 5 then 9 else unit_id * 7 % solution end"))
    dom = arrays.select("recording_id", "unit_id", (F.col("unit_id") + 1).cast("double").alias("dom"))
    whole = L.cluster_eval(arrays, clusters.filter("unit_id <> 5"), arrays, dom).collect()
    assert ("cluster-sums" in labels) == gaps
    alone = L.cluster_eval(arrays, clusters, arrays, dom).collect()  # a cluster of one unit
    for found, given in ((whole, clusters.filter("unit_id <> 5")), (alone, clusters)):
        sums = L.cluster_sums(arrays, given)
        silhouettes = {(r.recording_id, r.solution): r.silhouette for r in L._silhouettes(sums).collect()}
        within: dict = {}
        for r in L.within_by_cluster(sums).collect():
            within.setdefault((r.recording_id, r.solution), []).append(r.within)
        assert len(found) == len(silhouettes)
        for r in found:
            key = r.recording_id, r.solution
            assert r.within == pytest.approx(np.mean(within[key]), abs=1e-9) and r.acf_within == pytest.approx(r.within, abs=1e-9)
            assert r.silhouette == (pytest.approx(silhouettes[key], abs=1e-9) if found is whole else None)


def test_starts_at_rest_take_no_part_in_later_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    arrays = spark.createDataFrame([(0, u, rng.normal(size=8).tolist()) for u in range(200)], "recording_id int, unit_id long, trace array<double>")
    states: list = []
    keep = L.staged

    def seen(spark, df, label):
        out = keep(spark, df, label)
        if label == "kmeans-centres":
            states.append({(r.k, r.seed): r for r in out.collect()})
        return out

    monkeypatch.setattr(L, "staged", seen)
    L.kmeans_rows(arrays, [2, 4], 4)
    moving = [sum(r.going for r in s.values()) for s in states]
    assert moving[0] == 8 and moving[-1] == 0 and any(0 < n < 8 for n in moving) and moving == sorted(moving, reverse=True)
    for a, b in zip(states[1:], states[2:]):
        assert all(b[key].centres == r.centres and b[key].cost == r.cost for key, r in a.items() if not r.going)


def test_summary_of_transients_counts_their_runs(spark):
    sf = "/root/testdata/sf0.001"
    values = {(r.recording_id, r.unit_id): r.trace for r in C.fx.trace_arrays(spark, sf).collect()}
    flagged = {(r.recording_id, r.unit_id, r.frame) for r in C.QUERIES["e7_significant_transients"](spark, sf).collect()}
    windows = {(r.recording_id, r.label): range(r.start, r.end + 1) for r in C.picked(spark, sf).collect()}
    want = {}
    for (rec, label), frames in windows.items():
        own = [[f for f in frames if (rec, u, f) in flagged] for r, u in values if r == rec]
        starts = [sum(f - 1 not in fs for f in fs) for fs in own]
        peaks = [max(values[rec, u][f] for f in run) for r, u in values if r == rec for run in _runs([f for f in frames if (rec, u, f) in flagged])]
        want[rec, label] = (sum(starts), sum(n > 0 for n in starts) / len(starts), sum(peaks) / len(peaks) if peaks else None)
    got = {(r.recording_id, r.label): (r.total, r.active, r.amp) for r in C.QUERIES["e9_transient_summary"](spark, sf).collect()}
    assert flagged and set(got) == set(want)
    for at, row in want.items():
        assert got[at] == pytest.approx(row, abs=2e-5)


def _runs(frames):
    out = []
    for f in frames:
        if out and out[-1][-1] == f - 1:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def test_heights_compared_at_six_digits(spark):
    # e3's SQL compares heights with their median and with 1.5 after rounding them to six digits
    traces = [np.tile([-1.0, 1.0], 16) for _ in range(2)]  # median 0, MAD 1
    traces[0][[5, 15, 25]] = [1.9999999, 2.0000001, 3.0]
    traces[1][[5, 15, 25]] = [1.3, 1.2, 1.4999998]
    rows = spark.createDataFrame([(0, u, x.tolist()) for u, x in enumerate(traces)], "recording_id int, unit_id int, trace array<double>")
    found = lambda **how: sorted((r.unit_id, r.frame) for r in E.mad_events(rows, 2.0, 1.1, 1.0, 2.0, 0.5, 1.5, **how).collect())
    assert found() == [(0, 15), (0, 25)]
    assert found(digits=6) == [(0, 5), (0, 15), (0, 25), (1, 25)]
    assert k.rounded(np.array([0.5, -0.5, 1.25, -1.25, 0.04]), 1).tolist() == [0.5, -0.5, 1.3, -1.3, 0.0]


def test_step_up_limit_as_decimals_multiply(spark):
    # t6's SQL: i * 0.05 is a decimal there, rounded only when it is divided; families whose p lies right at the limit of place i of m
    tests = [(f"{m}-{i}", u, 10000 * i // m / 200000.0 if u < i else 1.0) for m in range(2, 41) for i in range(1, m + 1) if 10000 * i % m == 0 for u in range(m)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pv (g VARCHAR, u INTEGER, p DOUBLE)")
    con.execute("INSERT INTO pv SELECT unnest($1), unnest($2), unnest($3)", [list(c) for c in zip(*tests)])
    want = con.execute("""SELECT g, u, coalesce(i <= k, false) FROM (SELECT *, max(CASE WHEN p <= i * 0.05 / m THEN i END) OVER (PARTITION BY g) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS i, count(*) OVER (PARTITION BY g) AS m FROM pv))""").fetchall()
    got = S.fdr_mask(spark.createDataFrame(tests, "g string, u int, p double"), ["g"], "p").select("g", "u", "significant").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({w[2] for w in want}) == 2


def test_tasks_grow_with_the_pairs_they_make(spark, monkeypatch):
    monkeypatch.setattr(N, "TASK_PAIRS", 50_000)
    rows = [(g, u, [float(u % 7), float(u % 11), float(u * u % 5)]) for g in range(2) for u in range(1100)]
    pairs = N.pair_corr(spark.createDataFrame(rows, "recording_id int, unit_id long, trace array<double>"))
    parts = [n for n, in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect()]
    # five blocks a recording, 30 pairs of them, which adaptive execution put into one task
    assert sum(parts) == 2 * 1100 * 1099 // 2 and len(parts) > 10 and max(parts) < sum(parts) / 4
    assert N.pair_corr(spark.createDataFrame([], "recording_id int, unit_id long, trace array<double>")).count() == 0
