"""Population modes: principal components, phase locking, latent dynamics, trajectories, ensembles.

A recording's units are the rows and its frames the columns. Principal components come from sums
over blocks of units: of frames by frames where a recording is short, else of products with a few
time courses that are refined pass by pass. So a task holds one block of units, never a whole
recording. Everything behind them works on K latent series: pairs of components, sums of
products, and small solves in a grouped function over one row per recording or window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import CHUNK, padded, runs_of
from ..sources.staging import bounded_batches, staged
from .aggregates import hazen, resultant
from .clean import UNIT, zscore_column
from .joins import assignment_agreement
from .pairs import BROADCAST_RECORDINGS, _standardised, block_pairs, dealt, whole_and_loose
from .signal import analytic_signal, bandpass, dominant_freq, long_phases, welch_spectra
from .windows import runs

#: Frames up to which the sum over units is kept as a matrix of frames by frames (32 MB).
GRAM_FRAMES = 2048
#: Parts that a recording's blocks are dealt to when something has to meet each of them.
SALTS = 16
#: Partial sums that a task keeps before it passes them on.
HELD_SUMS = 8


def _blocks_of(units: DataFrame, block: int = 128) -> DataFrame:
    """Rows dealt into blocks and sorted by them: recording_id, blk, trace."""
    return dealt(units, block).select("recording_id", "blk", "trace").repartition("recording_id", "blk").sortWithinPartitions("recording_id", "blk")


def _kind(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = dict(df.dtypes)["recording_id"]
    return kind, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def _vectors(total: dict, kind: pa.DataType) -> pa.RecordBatch:
    """The sums that a task holds as rows (recording_id, y); the task starts afresh."""
    out = pa.RecordBatch.from_arrays([pa.array(list(total), kind), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], names=["recording_id", "y"])
    total.clear()
    return out


def _salted(parts: DataFrame) -> DataFrame:
    """Adds salt: tasks 0, 1, 2 and so on in turn, so that about as many partial sums share a salt as there are salts."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(max(tasks, 1) - 1) + 1)))


def _sums(rows: DataFrame, of: str, product) -> DataFrame:
    """(recording_id, y, salt): partial sums of a product over blocks, one per recording and task."""
    kind, arrow = _kind(rows)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for table in runs_of(batches, 2):
            rec = table.column(0)[0].as_py()
            y = product(table)
            total[rec] = total[rec] + y if rec in total else y
            if len(total) > HELD_SUMS:  # recordings come in order of their hash, few at a time
                yield _vectors(total, arrow)
        if total:
            yield _vectors(total, arrow)

    return _salted(rows.mapInArrow(run, f"recording_id {kind}, y array<double>"))


def _met(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., y): the vectors of each key added up. They come sorted by key, so a task holds one sum and one bounded batch."""
    kinds = dict(parts.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = total = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*last, pa.array([total], pa.list_(pa.float64()))], names=[*keys, "y"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, y = [c.slice(i, 1) for c in batch.columns[:-1]], batch.column(len(keys))[i].values.to_numpy()
                if last is None or any(a != b for a, b in zip(key, last)):
                    if last is not None:
                        yield out()
                    last, total = key, y.copy()
                else:
                    total += y
        if last is not None:
            yield out()

    bounded_batches(parts.sparkSession)
    rows = parts.select(*keys, "y").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(add, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "y")))


def _added_up(parts: DataFrame) -> DataFrame:
    """(recording_id, y): partial sums added as a tree, the salts of a recording first, then what they give."""
    return _met(_met(parts, ["recording_id", "salt"]), ["recording_id"])


def frame_sums(units: DataFrame, power: int = 1) -> DataFrame:
    """(recording_id, y): per frame the sum over the units (recording_id, unit_id, trace) of the values, or of their powers. The traces stay where they are."""
    kind, arrow = _kind(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            recs = np.array(batch.column(0).to_pylist())
            for rec in np.unique(recs).tolist():
                y = (padded(batch.column(1).filter(pa.array(recs == rec))) ** power).sum(axis=0)
                total[rec] = total[rec] + y if rec in total else y
            if len(total) > 16 * HELD_SUMS:
                yield _vectors(total, arrow)
        if total:
            yield _vectors(total, arrow)

    bounded_batches(units.sparkSession)
    return _added_up(_salted(units.select("recording_id", "trace").mapInArrow(run, f"recording_id {kind}, y array<double>")))


def _fixed_sign(q: np.ndarray) -> np.ndarray:
    """Rows with the sign that makes the largest absolute value positive (the first of equal ones)."""
    at = np.abs(np.round(q, 9)).argmax(axis=1)
    return q * np.where(q[np.arange(len(q)), at] < 0, -1.0, 1.0)[:, None]


def _from_gram(units: DataFrame, size: DataFrame, components: int) -> DataFrame:
    """(recording_id, n, t, basis, scale) from the frames-by-frames sum of a recording's units."""
    kind, _ = _kind(units)
    sums = _added_up(_sums(_blocks_of(units), "trace", lambda t: (x := padded(t.column(2))).T @ x))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        t, n = int(p["t"].iloc[0]), int(p["n"].iloc[0])
        value, vector = np.linalg.eigh(np.array(p["y"].iloc[0]).reshape(t, t))
        top = np.argsort(-value, kind="stable")[: min(components, n, t)]
        return pd.DataFrame({"recording_id": [p["recording_id"].iloc[0]], "n": [n], "t": [t], "basis": [vector[:, top].T.ravel()], "scale": [np.maximum(value[top], 0) / n]})

    return sums.join(size, "recording_id").groupBy("recording_id").applyInPandas(solve, f"recording_id {kind}, n long, t int, basis array<double>, scale array<double>")


def _directions(basis: np.ndarray, product: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best components within the orthonormal rows of ``basis``, whose product with the matrix is known: components, values, residuals, and the basis of the next pass.

    The next basis has the components, their residuals, and what of the components lies outside the first
    ``width`` rows (the direction of the last step): a locally optimal block method, which needs far fewer
    passes than plain subspace iteration where values lie close together.
    """
    value, turn = np.linalg.eigh((basis @ product.T + product @ basis.T) / 2)
    top = np.argsort(-value, kind="stable")[:width]
    turn = turn[:, top].T
    x, rest = turn @ basis, turn @ product - value[top][:, None] * (turn @ basis)
    more = np.concatenate([rest, turn[:, width:] @ basis[width:]])
    for _ in range(2):
        more = more - (more @ x.T) @ x
    size = np.linalg.norm(more, axis=1)
    more = more[size > 1e-11 * max(abs(value[top][0]), 1e-300)]
    more = more / np.linalg.norm(more, axis=1, keepdims=True)
    if len(more):
        _, s, q = np.linalg.svd(more, full_matrices=False)
        more = q[s > 1e-6][: max(basis.shape[1] - width, 0)]
    return x, value[top], rest, np.concatenate([x, more])


def _from_passes(units: DataFrame, size: DataFrame, components: int, passes: int, oversample: int, tol: float) -> DataFrame:
    """The same from products of blocks with a few time courses, pass by pass until no component moves."""
    spark, (kind, _) = units.sparkSession, _kind(units)
    width = components + oversample
    blocks = staged(spark, dealt(units, 128).groupBy("recording_id", "blk").agg(F.collect_list("trace").alias("traces")), "pca-blocks")
    blocks = blocks.withColumn("salt", F.pmod("blk", F.lit(SALTS)))
    schema = f"recording_id {kind}, n long, t int, basis array<double>, found array<double>, scale array<double>, moves double"

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            bases = [np.linalg.qr(np.sin(np.arange(1, min(width, t) * t + 1).reshape(t, -1) * 12.9898) * 43758.5453 % 1.0 - 0.5)[0].T for t in p["t"]]
            yield p.assign(basis=[b.ravel() for b in bases], found=[[]] * len(p), scale=[[]] * len(p), moves=float("inf"))

    state = staged(spark, size.select("recording_id", "n", "t").mapInPandas(start, schema), "pca-basis")

    def product(table: pa.Table) -> np.ndarray:
        x = padded(table.column(2).combine_chunks().flatten())
        basis = table.column(3)[0].values.to_numpy().reshape(-1, x.shape[1])
        return (basis @ x.T) @ x

    def better(p: pd.DataFrame) -> pd.DataFrame:
        t, n = int(p["t"].iloc[0]), int(p["n"].iloc[0])
        basis, y = (np.array(p[c].iloc[0]).reshape(-1, t) for c in ("basis", "y"))
        x, value, rest, wider = _directions(basis, y, min(width, t))
        moves = np.linalg.norm(rest[: min(components, n, t)], axis=1).max() / max(value[0], 1e-300)
        return pd.DataFrame({"recording_id": [p["recording_id"].iloc[0]], "n": [n], "t": [t], "basis": [wider.ravel()], "found": [x.ravel()], "scale": [np.maximum(value, 0) / n], "moves": [moves]})

    for _ in range(passes):
        # the time courses go to every part of a recording, each block meets them once; recordings that are done rest
        told = state.filter(F.col("moves") > tol).select("recording_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "basis")
        rows = blocks.join(told, ["recording_id", "salt"]).select("recording_id", "blk", "traces", "basis")
        sums = _added_up(_sums(rows, "traces", product)).join(state.select("recording_id", "n", "t", "basis"), "recording_id")
        done = state.filter(F.col("moves") <= tol)
        state = staged(spark, done.unionByName(sums.groupBy("recording_id").applyInPandas(better, schema)), "pca-basis")
        if not state.filter(F.col("moves") > tol).limit(1).count():
            break
    return state.select("recording_id", "n", "t", F.col("found").alias("basis"), "scale")


def pca(arrays: DataFrame, components: int, passes: int = 100, oversample: int = 8, gram_frames: int = GRAM_FRAMES, standardise: bool = True, tol: float = 1e-7) -> DataFrame:
    """(recording_id, pc, n, share, score): components of unit-standardised traces, whole and equally long per recording.

    ``score`` is the unit-length time course, ``share`` the part of the total variance, ``n`` the number of
    units. K is capped by the number of units and frames. The largest absolute value of a score is
    positive. Recordings of up to ``gram_frames`` frames are solved from the sum over their units; longer
    ones pass by pass until what the matrix makes of a component differs from a multiple of it by at most
    ``tol`` times the largest value, or after ``passes``. Without ``standardise`` the traces count as they
    are (for data that is standardised already).
    """
    spark, (kind, _) = arrays.sparkSession, _kind(arrays)
    units = staged(spark, _standardised(arrays) if standardise else arrays.select(*UNIT, "trace"), "pca-units")
    size = staged(spark, units.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("trace")).alias("t")), "pca-sizes")
    one = F.broadcast if size.count() <= BROADCAST_RECORDINGS else lambda df: df
    schema = f"recording_id {kind}, pc int, n long, share double, score array<double>"

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for rec, n, t, basis, scale in zip(p["recording_id"], p["n"], p["t"], p["basis"], p["scale"]):
                q = _fixed_sign(np.array(basis).reshape(-1, t)[: min(components, n, t)])
                rows += [(rec, i, n, float(scale[i]), q[i]) for i in range(len(q))]
            yield pd.DataFrame(rows, columns=["recording_id", "pc", "n", "share", "score"])

    parts = []
    for part, solve in (("t <= ", lambda u, s: _from_gram(u, s, components)), ("t > ", lambda u, s: _from_passes(u, s, components, passes, oversample, tol))):
        own = size.filter(f"{part}{gram_frames}")
        if own.limit(1).count():
            parts.append(solve(units.join(one(own.select("recording_id")), "recording_id", "left_semi"), own))
    if not parts:
        return spark.createDataFrame([], schema)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return staged(spark, both.mapInPandas(scores, schema), "pca-scores")


def loadings(arrays: DataFrame, pcs: DataFrame, unit_norm: bool = False, standardise: bool = True) -> DataFrame:
    """(recording_id, unit_id, pc, loading): correlation of each unit with each component.

    With ``unit_norm`` the coefficients of a component over the units have length 1 instead.
    """
    dot = F.aggregate(F.zip_with("trace", "score", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(F.col("share") * F.col("n"))
    value = F.when(scale > 1e-12, dot / scale).otherwise(0.0) if unit_norm else dot
    units = _standardised(arrays) if standardise else arrays.select(*UNIT, "trace")
    return units.join(pcs.select("recording_id", "pc", "n", "share", "score"), "recording_id").select(*UNIT, "pc", value.alias("loading"))


def latent_arrays(pcs: DataFrame) -> DataFrame:
    """(recording_id, pc, trace): scores of components of z-scored traces, in their own scale."""
    scale = F.sqrt(F.col("share") * F.col("n") * (F.size("score") - 1))
    return pcs.select("recording_id", "pc", F.transform("score", lambda x: x * scale).alias("trace"))


def latents(pcs: DataFrame) -> DataFrame:
    """(recording_id, pc, frame, value) of ``latent_arrays``."""
    return latent_arrays(pcs).select("recording_id", "pc", F.posexplode("trace").alias("frame", "value"))


def window_latents(arrays: DataFrame, picked: DataFrame, components: int, labels: tuple[str, ...] = ("low", "high")) -> tuple[DataFrame, DataFrame]:
    """Components fitted on picked windows alone: their (recording_id, pc, n, share, score) and (recording_id, label, pc, trace), the scores inside each window.

    Each unit's slices of the windows (recording_id, label, start, end) are put one after the other, in the order of
    ``labels``, and standardised as one trace. Recordings without all windows are left out, as are units with a
    missing value inside one.
    """
    at = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c))).alias(f"_{c}_{label}")
    cuts = picked.groupBy("recording_id").agg(*[at(x, c) for x in labels for c in ("start", "end")]).dropna()
    length = lambda x: F.col(f"_end_{x}") - F.col(f"_start_{x}") + 1
    joined = arrays.join(cuts, "recording_id").select(*UNIT, F.concat(*[F.slice("trace", F.col(f"_start_{x}") + 1, length(x)) for x in labels]).alias("trace"))
    pcs = pca(joined, components)
    own = latent_arrays(pcs).join(cuts, "recording_id")
    from_ = [sum((length(y) for y in labels[:i]), F.lit(1)) for i in range(len(labels))]
    windows = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.slice("trace", a, length(x)).alias("trace")) for x, a in zip(labels, from_)])).alias("w")
    return pcs, own.select("recording_id", "pc", windows).select("recording_id", "w.label", "pc", "w.trace")


def pca_time(arrays: DataFrame, components: int) -> tuple[DataFrame, DataFrame]:
    """Components with frames as features: (recording_id, pc, variance, pattern) and (recording_id, unit_id, pc, score).

    Traces are z-scored per unit and centred per frame over the units; a pattern is the coefficients of a
    component over the frames times the square root of its variance, a score the unit's product with the coefficients.
    """
    z = staged(arrays.sparkSession, _standardised(arrays).withColumn("scale", F.sqrt(F.size("trace") - 1.0)), "pca-time-units")
    z = z.select(*UNIT, F.transform("trace", lambda x: x * F.col("scale")).alias("trace"))
    count = z.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    mean = frame_sums(z).join(count, "recording_id").select("recording_id", F.transform("y", lambda x: x / F.col("_n")).alias("_mean"))
    centred = staged(arrays.sparkSession, z.join(mean, "recording_id").select(*UNIT, F.zip_with("trace", "_mean", lambda a, b: a - b).alias("trace")), "pca-time")
    p = pca(centred, components, standardise=False)
    variance = F.col("share") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))
    patterns = p.select("recording_id", "pc", variance.alias("variance"), F.transform("score", lambda x: x * F.sqrt(variance)).alias("pattern"))
    return patterns, loadings(centred, p, standardise=False).withColumnRenamed("loading", "score")


def mode_assignment(load: DataFrame) -> DataFrame:
    """(recording_id, unit_id, mode, sign, strength): component with the largest absolute loading, the first on ties."""
    best = load.groupBy(*UNIT).agg(F.max(F.struct(F.abs("loading").alias("a"), (-F.col("pc")).alias("m"), F.signum("loading").alias("s"))).alias("b"))
    return best.select(*UNIT, (-F.col("b.m")).alias("mode"), F.col("b.s").cast("int").alias("sign"), F.col("b.a").alias("strength"))


def mode_traces(traces: DataFrame, modes: DataFrame) -> DataFrame:
    """(recording_id, mode, frame, value): mean trace of each mode."""
    return traces.join(modes.select(*UNIT, "mode"), UNIT).groupBy("recording_id", "mode", "frame").agg(F.avg("value").alias("value"))


def phase_locking(phases: DataFrame, quantile: float = 0.2, least: int = 20, keys: list[str] = ["recording_id"]) -> DataFrame:
    """(keys..., a, b, plv, lag, n): phase locking of component pairs from (keys..., pc, frame, phase, amp).

    Samples where either amplitude is below its component's quantile do not count; pairs with
    fewer than ``least`` samples are NULL. ``lag`` is the mean phase difference.
    """
    q = hazen(phases, [*keys, "pc"], [quantile], "amp").select(*keys, "pc", F.col("q"))
    strong = phases.join(q, [*keys, "pc"]).filter(F.col("amp") >= F.col("q"))
    a = strong.select(*keys, "frame", F.col("pc").alias("a"), F.col("phase").alias("pa"))
    b = strong.select(*keys, "frame", F.col("pc").alias("b"), F.col("phase").alias("pb"))
    both = a.join(b, [*keys, "frame"]).filter("a < b").withColumn("d", F.col("pa") - F.col("pb"))
    enough = F.count(F.lit(1)) >= least
    return both.groupBy(*keys, "a", "b").agg(F.when(enough, resultant(F.col("d"))).alias("plv"), F.when(enough, F.atan2(F.avg(F.sin("d")), F.avg(F.cos("d")))).alias("lag"), F.count(F.lit(1)).alias("n"))


def phase_components(plv: DataFrame, pcs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(recording_id, pc, component): connected components of the graph of locked pairs, named by their smallest member.

    K components of a recording need at most K passes of the smallest label.
    """
    spark = plv.sparkSession
    e = plv.filter(F.col("plv") >= threshold)
    edges = e.select("recording_id", F.col("a").alias("pc"), F.col("b").alias("to")).unionByName(e.select("recording_id", F.col("b").alias("pc"), F.col("a").alias("to")))
    edges = staged(spark, edges, "plv-edges")
    labels = pcs.select("recording_id", "pc", F.col("pc").alias("component")).distinct()
    while True:
        near = edges.join(labels.select("recording_id", F.col("pc").alias("to"), "component"), ["recording_id", "to"]).groupBy("recording_id", "pc").agg(F.min("component").alias("near"))
        new = staged(spark, labels.join(near, ["recording_id", "pc"], "left").select("recording_id", "pc", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was")), "plv-labels")
        if not new.filter("component <> was").limit(1).count():
            return new.drop("was")
        labels = new.drop("was")


def lagged_products(latent: DataFrame, keys: list[str] = ["recording_id"]) -> DataFrame:
    """(keys..., i, j, s0, s1): sums of x_i(t) x_j(t) and x_i(t + 1) x_j(t) over t with a next sample."""
    w = Window.partitionBy(*keys, "pc").orderBy("frame")
    nxt = latent.withColumn("next", F.lead("value").over(w)).filter(F.col("next").isNotNull())
    a = nxt.select(*keys, "frame", F.col("pc").alias("i"), F.col("value").alias("xi"), F.col("next").alias("ni"))
    b = nxt.select(*keys, "frame", F.col("pc").alias("j"), F.col("value").alias("xj"))
    return a.join(b, [*keys, "frame"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("s0"), F.sum(F.col("ni") * F.col("xj")).alias("s1"))


def lds_fit(latent: DataFrame, fps: float, low: float = 0.01, high: float = 0.10, ridge: float = 1e-3, mag: tuple[float, float] = (0.90, 1.05), keys: list[str] = ["recording_id"]) -> DataFrame:
    """(keys..., re, im, magnitude, freq, candidate, pairs): eigenvalues of the ridge one-step predictor.

    A candidate is complex, has its frequency in the band and its magnitude in range; ``pairs`` counts
    the candidates' conjugate pairs.
    """
    kinds = dict(latent.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["i"].unique())
        at = {v: n for n, v in enumerate(ids)}
        s0, s1 = np.zeros((len(ids),) * 2), np.zeros((len(ids),) * 2)
        for i, j, a, b in zip(pdf["i"], pdf["j"], pdf["s0"], pdf["s1"]):
            s0[at[i], at[j]], s1[at[i], at[j]] = a, b
        ev = np.linalg.eigvals(s1 @ np.linalg.inv(s0 + ridge * np.eye(len(ids))))
        ev = ev[np.lexsort((ev.imag, ev.real))]
        freq, size = np.abs(np.angle(ev)) * fps / (2 * np.pi), np.abs(ev)
        ok = (np.abs(ev.imag) > 1e-10) & (freq >= low) & (freq <= high) & (size >= mag[0]) & (size <= mag[1])
        pairs = int((ok & (ev.imag > 0)).sum())
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(ev) for c in keys}, "re": ev.real, "im": ev.imag, "magnitude": size, "freq": freq, "candidate": ok, "pairs": pairs})

    return lagged_products(latent, keys).groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", re double, im double, magnitude double, freq double, candidate boolean, pairs int")


def leading_pairs(products: DataFrame, ks: list[int], fps: float, low: float = 0.01, high: float = 0.10, ridge: float = 1e-3, mag: tuple[float, float] = (0.90, 1.05), keys: list[str] = ["recording_id"]) -> DataFrame:
    """(keys..., k, pairs): candidates' conjugate pairs of the one-step predictors of the first k components, for every k, from one set of ``lagged_products``."""
    kinds = dict(products.dtypes)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        size = int(p["i"].max()) + 1
        s0, s1 = np.zeros((size, size)), np.zeros((size, size))
        s0[p["i"], p["j"]], s1[p["i"], p["j"]] = p["s0"], p["s1"]
        found = []
        for k_ in ks:
            ev = np.linalg.eigvals(s1[:k_, :k_] @ np.linalg.inv(s0[:k_, :k_] + ridge * np.eye(min(k_, size))))
            freq, far = np.abs(np.angle(ev)) * fps / (2 * np.pi), np.abs(ev)
            found.append(int(((ev.imag > 1e-10) & (freq >= low) & (freq <= high) & (far >= mag[0]) & (far <= mag[1])).sum()))
        return pd.DataFrame({**{c: [p[c].iloc[0]] * len(ks) for c in keys}, "k": ks, "pairs": found})

    return products.groupBy(*keys).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", k int, pairs int")


def group_frame_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., y): per frame the sum over the rows (keys..., trace) of each group. Tasks add up what they read; groups are few."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        fields: list = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), f) for c, f in zip(zip(*total), fields)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.list_(pa.float64()))], names=[*keys, "y"])

        for batch in batches:
            fields = [batch.schema.field(i).type for i in range(len(keys))]
            groups: dict = {}
            for i, key in enumerate(zip(*[batch.column(i).to_pylist() for i in range(len(keys))])):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                y = padded(batch.column(len(keys)).take(pa.array(at))).sum(axis=0)
                total[key] = total[key] + y if key in total else y
            if len(total) > 64 * HELD_SUMS:
                yield out()
                total.clear()
        if total:
            yield out()

    bounded_batches(rows.sparkSession)
    parts = rows.select(*keys, "trace").mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in keys], "y array<double>"]))
    return _met(_met(_salted(parts), [*keys, "salt"]), keys)


def evaluate_latents(windows: DataFrame, fps: float, low: float, high: float, welch_frames: int, quantile: float = 0.2, least: int = 20, keys: list[str] = ["recording_id"]) -> DataFrame:
    """(keys..., pairs, freqs, freq_cv, plv): oscillator measures of latent series (keys..., pc, trace).

    Conjugate pairs of the one-step predictor; the components' dominant frequencies in the band, by
    component, and their coefficient of variation; mean phase locking of the band-passed components.
    """
    long = windows.select(*keys, "pc", F.posexplode("trace").alias("frame", "value"))
    pairs = lds_fit(long, fps, low, high, keys=keys).groupBy(*keys).agg(F.max("pairs").alias("pairs"))
    spectra = welch_spectra(windows, fps, welch_frames, welch_frames // 2, welch_frames, keys=[*keys, "pc"])
    freqs = dominant_freq(spectra, low, high, [*keys, "pc"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pc", "dom"))).alias("f"), (F.stddev_samp("dom") / F.avg("dom")).alias("freq_cv"))
    phases = long_phases(analytic_signal(bandpass(windows, fps, low, high, keys=[*keys, "pc"]), [*keys, "pc"]), [*keys, "pc"])
    plv = phase_locking(phases, quantile, least, keys).groupBy(*keys).agg(F.avg("plv").alias("plv"))
    return pairs.join(freqs.select(*keys, F.col("f.dom").alias("freqs"), "freq_cv"), keys, "left").join(plv, keys, "left").select(*keys, "pairs", "freqs", "freq_cv", "plv")


def sliding_windows_of(latent: DataFrame, window: int, step: int) -> DataFrame:
    """(recording_id, start, pc, trace): every sliding window of latent arrays (recording_id, pc, trace); a shorter series is one window."""
    last = F.greatest(F.size("trace") - window, F.lit(0))
    rows = latent.select("recording_id", "pc", "trace", F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    return rows.select("recording_id", "start", "pc", F.slice("trace", F.col("start") + 1, window).alias("trace"))


def sliding_oscillators(latent: DataFrame, events: DataFrame, fps: float, window: int, step: int, low: float, high: float, welch_frames: int, quantile: float = 0.2, least: int = 20) -> DataFrame:
    """(recording_id, start, centre, events, pairs, freqs, freq_cv, plv) of every sliding window; ``centre`` in seconds, events from (recording_id, frame)."""
    cut = staged(latent.sparkSession, sliding_windows_of(latent, window, step), "latent-windows")
    found = evaluate_latents(cut, fps, low, high, min(welch_frames, window), quantile, least, ["recording_id", "start"])
    first, last = F.floor((F.col("frame") - window) / step) + 1, F.floor(F.col("frame") / step)
    per = events.select("recording_id", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("k")).groupBy("recording_id", (F.col("k") * step).cast("int").alias("start")).agg(F.count(F.lit(1)).alias("events"))
    out = found.join(per, ["recording_id", "start"], "left")
    return out.select("recording_id", "start", ((F.col("start") + window // 2) / fps).alias("centre"), F.coalesce("events", F.lit(0).cast("long")).alias("events"), "pairs", "freqs", "freq_cv", "plv")


def fixed_latent_windows(latent: DataFrame, picked: DataFrame, fps: float, low: float, high: float, welch_frames: int, quantile: float = 0.2, least: int = 20) -> DataFrame:
    """(recording_id, label, pairs, freqs, freq_cv, plv, fractions): the latents of the whole recording, evaluated whole (``full``) and in each picked window (recording_id, label, start, end).

    ``fractions`` is the share of each component in the variance inside the window.
    """
    whole = latent.select("recording_id", F.lit("full").alias("label"), "pc", "trace")
    cut = latent.join(picked.select("recording_id", "label", "start", "end"), "recording_id")
    cut = cut.select("recording_id", "label", "pc", F.slice("trace", F.col("start") + 1, F.col("end") - F.col("start") + 1).alias("trace"))
    both = staged(latent.sparkSession, whole.unionByName(cut), "latent-picked")
    keys = ["recording_id", "label"]
    found = evaluate_latents(both, fps, low, high, welch_frames, quantile, least, keys)
    long = both.select(*keys, "pc", F.explode("trace").alias("value")).groupBy(*keys, "pc").agg(F.var_samp("value").alias("v"))
    shares = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pc", "v"))).alias("v"), F.sum("v").alias("s"))
    return found.join(shares.select(*keys, F.transform("v.v", lambda x: x / F.col("s")).alias("fractions")), keys)


#: Labels of a recording by its oscillators: fixed values.
ONE, SEVERAL, TRANSIENT, MIXED = (
    "More consistent with one dominant oscillator + noise.",
    "More consistent with multiple oscillatory modes.",
    "Global fit is mixed, but sliding-window dynamics suggest transient multiple oscillatory modes.",
    "Mixed evidence; possible weakly coupled or partially overlapping oscillators.",
)


def interpretation(pairs: Column, plv: Column, freq_cv: Column, groups: Column, sliding: Column) -> Column:
    """Label of a recording from its oscillator pairs, mean phase locking, frequency spread, phase groups and most pairs of a window."""
    several = (pairs >= 2) & (F.coalesce(freq_cv > 0.15, F.lit(False)) | F.coalesce(plv < 0.7, F.lit(False)) | F.coalesce(groups >= 2, F.lit(False)))
    return F.when((pairs <= 1) & (plv > 0.8), ONE).when(several, SEVERAL).when(sliding >= 2, TRANSIENT).otherwise(MIXED)


def variance_fraction(latent: DataFrame, first: int, last: int) -> DataFrame:
    """(recording_id, pc, fraction): share of each component in the variance within a window."""
    v = latent.filter(F.col("frame").between(first, last)).groupBy("recording_id", "pc").agg(F.var_samp("value").alias("v"))
    return v.select("recording_id", "pc", (F.col("v") / F.sum("v").over(Window.partitionBy("recording_id"))).alias("fraction"))


def frame_points(latent: DataFrame, modes: DataFrame, dims: int = 3) -> DataFrame:
    """(recording_id, mode, id, dim, v): frames as points in the first components, each under the mode (recording_id, frame, mode) that dominates it."""
    return latent.filter(F.col("pc") < dims).join(modes, ["recording_id", "frame"]).select("recording_id", "mode", F.col("frame").alias("id"), F.col("pc").alias("dim"), F.col("value").alias("v"))


def geometry_separation(points: DataFrame, least: int = 3) -> DataFrame:
    """(recording_id, separation): mean distance of mode centroids over mean spread within modes, from points (recording_id, mode, id, dim, v).

    Modes with fewer than ``least`` points do not count: 3 units, or 5 frames.
    """
    c = points.groupBy("recording_id", "mode", "dim").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    d2 = points.join(c, ["recording_id", "mode", "dim"]).groupBy("recording_id", "mode", "id").agg(F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("d"))
    spread = d2.groupBy("recording_id", "mode").agg(F.avg("d").alias("s")).groupBy("recording_id").agg(F.avg("s").alias("within"))
    o = c.select("recording_id", "dim", F.col("mode").alias("other"), F.col("c").alias("oc"))
    between = c.join(o, ["recording_id", "dim"]).filter("mode < other").groupBy("recording_id", "mode", "other").agg(F.sqrt(F.sum((F.col("c") - F.col("oc")) ** 2)).alias("d"))
    return between.groupBy("recording_id").agg(F.avg("d").alias("between")).join(spread, "recording_id").select("recording_id", F.when(F.col("within") > 0, F.col("between") / F.col("within")).alias("separation"))


def assignment_stability(modes: DataFrame, ks: list[int]) -> DataFrame:
    """(recording_id, k, common, equal, jaccard): modes (k, recording_id, unit_id, mode) of each K against those of the K before it in the list."""
    before = F.create_map(*[F.lit(x) for pair in zip(ks, ks[1:]) for x in pair])
    was = modes.withColumn("k", F.try_element_at(before, F.col("k"))).filter("k is not null")
    return assignment_agreement(was, modes.filter(F.col("k").isin(ks[1:])), ["recording_id", "k"], "unit_id", "mode")


def k_selection(per_k: DataFrame, good: list[str], bad: list[str]) -> DataFrame:
    """Group means per K with a composite: z-scores of what should be large less those of what should be small; a missing mean adds nothing."""
    g = per_k.groupBy("k").agg(*[F.avg(c).alias(c) for c in [*good, *bad]])
    for c in [*good, *bad]:
        g = zscore_column(g, c, f"z_{c}").withColumn(f"z_{c}", F.coalesce(f"z_{c}", F.lit(0.0)))
    return g.withColumn("score", sum((F.col(f"z_{c}") for c in good), F.lit(0.0)) - sum((F.col(f"z_{c}") for c in bad), F.lit(0.0)))


def trajectory(latent: DataFrame, fps: float) -> DataFrame:
    """(recording_id, frame, radius, speed, angular): path of the first three components around their mean; angular velocity |R x V| / |R|^2."""
    w3 = latent.filter("pc < 3").groupBy("recording_id", "frame").pivot("pc", [0, 1, 2]).agg(F.first("value"))
    rec = Window.partitionBy("recording_id")
    t = rec.orderBy("frame")
    p = w3.select("recording_id", "frame", *[(F.col(str(i)) - F.avg(str(i)).over(rec)).alias(c) for i, c in enumerate("xyz")])
    p = p.select("*", *[((F.lead(c).over(t) - F.col(c)) * fps).alias(f"v{c}") for c in "xyz"])
    r2 = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    cross = (F.col("y") * F.col("vz") - F.col("z") * F.col("vy")) ** 2 + (F.col("z") * F.col("vx") - F.col("x") * F.col("vz")) ** 2 + (F.col("x") * F.col("vy") - F.col("y") * F.col("vx")) ** 2
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    return p.select("recording_id", "frame", "x", "y", "z", F.sqrt(r2).alias("radius"), speed.alias("speed"), F.when(r2 > 0, F.sqrt(cross) / r2).alias("angular"))


def trajectory_summary(path: DataFrame, fps: float) -> DataFrame:
    """(recording_id, radius, speed, angular, rotations): means, and the summed angle between successive positions in turns."""
    t = Window.partitionBy("recording_id").orderBy("frame")
    nxt = [F.lead(c).over(t) for c in "xyz"]
    dot = sum((F.col(c) * n for c, n in zip("xyz", nxt)), F.lit(0.0)) / (F.col("radius") * F.lead("radius").over(t))
    turn = path.withColumn("_a", F.when(dot.isNotNull(), F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))))
    return turn.groupBy("recording_id").agg(F.avg("radius").alias("radius"), F.avg("speed").alias("speed"), F.avg("angular").alias("angular"), (F.sum("_a") / (2 * math.pi)).alias("rotations"))


def loops(path: DataFrame, fps: float, low: float = 0.5, peak: float = 1.0, least_sec: float = 1.0) -> DataFrame:
    """(recording_id, loop, start, end, duration, peak, length, area, ccw): excursions between visits of the inner shell.

    The shell lies below ``low`` times the sd of the radius. An excursion counts if it reaches
    ``peak`` times the sd and lasts long enough. Area is the signed area of x and y, closed by its
    last point; ccw tells its sign.
    """
    rec = Window.partitionBy("recording_id")
    out = path.withColumn("_sd", F.stddev_samp("radius").over(rec)).withColumn("_out", F.col("radius") >= low * F.col("_sd"))
    r = runs(out, "_out", ["recording_id"]).select("recording_id", F.col("run").alias("loop"), "start", "end")
    inside = out.join(r, "recording_id").filter(F.col("frame").between(F.col("start"), F.col("end")))
    w = Window.partitionBy("recording_id", "loop")
    o = w.orderBy("frame")
    nx, ny = F.coalesce(F.lead("x").over(o), F.first("x").over(o)), F.coalesce(F.lead("y").over(o), F.first("y").over(o))
    step = F.sqrt(sum(((F.lead(c).over(o) - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0)))
    rows = inside.withColumn("_area", (F.col("x") * ny - nx * F.col("y")) / 2).withColumn("_step", step)
    g = rows.groupBy("recording_id", "loop", "start", "end").agg(F.max("radius").alias("peak"), F.sum("_step").alias("length"), F.sum("_area").alias("area"), F.max("_sd").alias("_sd"))
    g = g.withColumn("duration", (F.col("end") - F.col("start") + 1) / fps)
    return g.filter((F.col("peak") >= peak * F.col("_sd")) & (F.col("duration") >= least_sec)).withColumn("ccw", F.col("area") > 0).drop("_sd")


def loop_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.median("duration").alias("duration"), F.median("peak").alias("peak"), F.median("length").alias("length"), F.avg(F.col("ccw").cast("double")).alias("ccw"))


def loop_normals(path: DataFrame, found: DataFrame) -> DataFrame:
    """(recording_id, loop, nx, ny, nz): unit normal of the plane of each loop, from the sums of its coordinates."""
    inside = path.join(found.select("recording_id", "loop", "start", "end"), "recording_id").filter(F.col("frame").between(F.col("start"), F.col("end")))
    sums = inside.groupBy("recording_id", "loop").agg(*[F.covar_pop(a, b).alias(a + b) for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))])

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.array([[p.xx, p.xy, p.xz], [p.xy, p.yy, p.yz], [p.xz, p.yz, p.zz]], float).transpose(2, 0, 1) if len(p) else np.zeros((0, 3, 3))
            v = np.linalg.eigh(m)[1][:, :, 0]
            v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
            yield pd.DataFrame({"recording_id": p.recording_id, "loop": p.loop, "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    return sums.mapInPandas(normal, f"recording_id {dict(path.dtypes)['recording_id']}, loop long, nx double, ny double, nz double")


#: Bytes that the centres of k-means may add up to over all passes and still be broadcast in each.
SENT_BYTES = 384 << 20
#: How far a number of a centre may move for its start to have come to rest; a unit that changes its cluster moves it much further than rounding does.
AT_REST = 1e-12


def kmeans_rows(arrays: DataFrame, ks: list[int], seeds: int = 20, iterations: int = 100) -> DataFrame:
    """(recording_id, k, unit_id, cluster): k-means by correlation distance on standardised rows, for each K; per recording and K the best of several starts.

    All recordings, Ks and starts move together: a pass meets each block of units with the centres of its
    recording and sums, per start and cluster, what is nearest. Starts are units in the order of a hash of
    unit and seed. A start whose centres stay where they are takes no part in later passes, and the last pass is
    that in which none moves. A recording with fewer units than K has so many clusters.
    A pass is one exchange of partial sums by recording and start. The centres are broadcast where those of all
    passes together stay below ``SENT_BYTES``; beyond that they meet the blocks in a shuffle join.
    """
    spark = arrays.sparkSession
    units = staged(spark, _standardised(arrays), "kmeans-units")
    kind, arrow = _kind(units)
    key, most = ["recording_id", "k", "seed"], max(ks)
    picks = units.select("recording_id", "unit_id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    nth = F.row_number().over(Window.partitionBy("recording_id", "seed").orderBy(F.xxhash64("unit_id", "seed"), "unit_id"))
    picks = picks.withColumn("c", nth).filter(F.col("c") <= most).join(units, UNIT)
    starts = picks.groupBy("recording_id", "seed").agg(F.sort_array(F.collect_list(F.struct("c", "trace"))).alias("s")).select("recording_id", "seed", F.explode(F.array(*map(F.lit, ks))).alias("k"), F.col("s.trace").alias("s"))
    starts = starts.select(*key, F.least("k", F.size("s")).alias("held"), F.flatten(F.slice("s", 1, F.col("k"))).alias("centres"), F.lit(float("inf")).alias("cost"), F.lit(True).alias("going"))
    state = staged(spark, starts, "kmeans-centres")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                traces = pa.array([padded(batch.column(3)[i].values).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns[:3]], traces], names=["recording_id", "blk", "ids", "traces"])

    frames = units.agg(F.max(F.size("trace"))).first()[0] or 1
    blocks = dealt(units, max(128, min(1024, CHUNK // frames))).groupBy("recording_id", "blk").agg(F.collect_list(F.struct("unit_id", "trace")).alias("u"))
    unit = dict(arrays.dtypes)["unit_id"]
    blocks = blocks.select("recording_id", "blk", F.col("u.unit_id").alias("ids"), F.col("u.trace").alias("traces"))
    # neighbouring blocks share a task, so that a pass has few partial sums; a block's traces are the bytes of one matrix, which is read fastest
    blocks = blocks.repartitionByRange("recording_id", "blk").sortWithinPartitions("recording_id", "blk").mapInArrow(flat, f"recording_id {kind}, blk int, ids array<{unit}>, traces binary")
    blocks = staged(spark, blocks, "kmeans-blocks").withColumn("salt", F.pmod("blk", F.lit(SALTS)))
    sent = (state.agg(F.sum(F.size("centres") * F.lit(8).cast("long"))).first()[0] or 0) * iterations <= SENT_BYTES

    def meet(state: DataFrame) -> DataFrame:
        """The blocks, each with the centres of its recording in order of K and start."""
        told = state.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("k", "seed", "held", "centres"))).alias("s"))
        told = told.select("recording_id", F.col("s.k").alias("of_k"), F.col("s.seed").alias("of_seed"), F.col("s.held").alias("of_held"), F.flatten("s.centres").alias("centres"))
        if sent:
            return blocks.join(F.broadcast(told), "recording_id")
        return blocks.join(told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["recording_id", "salt"])

    def rows_of(table: pa.Table) -> np.ndarray:
        return np.frombuffer(table.column("traces")[0].as_buffer()).reshape(len(table.column("ids")[0]), -1)

    def started(table: pa.Table) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        """Of each K: its starts, how many centres one of them holds, and these centres, the first of all starts first."""
        of_k, of_seed, of_held, centres = (table.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("of_k", "of_seed", "of_held", "centres"))
        centres, at = centres.reshape(of_held.sum(), -1), 0
        for k in np.unique(of_k).tolist():
            own = of_k == k
            n, held = int(own.sum()), int(of_held[own][0])
            yield k, of_seed[own], held, centres[at : at + n * held].reshape(n, held, -1).transpose(1, 0, 2).reshape(n * held, -1)
            at += n * held

    def labels(x: np.ndarray, centres: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each [start, row] the nearest cluster, the first on ties, and the product with its centre."""
        near = (centres @ x.T).reshape(size, -1, len(x))
        best, own = near[0], np.zeros(near.shape[1:], np.int8 if size < 128 else np.int32)
        for c in range(1, size):  # cluster by cluster, as an argmax over so short an axis is slow
            np.copyto(own, c, where=near[c] > best)
            np.maximum(best, near[c], out=best)
        return own, best

    def product(table: pa.Table) -> dict:
        """Of each K: its starts, their centres and, per start, the summed rows of its clusters and the cost."""
        x, out = rows_of(table), {}
        for k, of, held, centres in started(table):
            total, step = 0.0, max(16, CHUNK // 64 // len(centres))  # so few rows at a time that they stay in the processor's cache
            for part in (x[one : one + step] for one in range(0, len(x), step)):
                own, best = labels(part, centres, held)
                flags = np.empty((len(of), held, len(part)))
                for c in range(held):
                    np.equal(own, c, out=flags[:, c], casting="unsafe")
                sums = (flags.reshape(-1, len(part)) @ part).reshape(len(of), -1)
                total = total + np.concatenate([sums, (len(part) - best.sum(axis=1))[:, None]], axis=1)
            out[k] = of, held, total
        return out

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}

        def out() -> Iterator[pa.RecordBatch]:
            for rec, of_ks in total.items():
                for k, (of, held, y) in of_ks.items():
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([rec] * len(of), arrow), *[pa.array(c, pa.int32()) for c in ([k] * len(of), of, [held] * len(of), [1] * len(of))], cells], names=[*key, "held", "new", "y"])
            total.clear()

        for table in runs_of(batches, 2):
            rec, y = table.column(0)[0].as_py(), product(table)
            total[rec] = {k: (*of, total[rec][k][2] + v) for k, (*of, v) in y.items()} if rec in total else y
            if len(total) > HELD_SUMS:  # recordings come in order, few at a time
                yield from out()
        yield from out()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A start's old centres and cost come first, then the partial sums; they become its new centres. One at rest gets no sums and stays as it is."""
        last = was = total = None

        def out() -> tuple:
            if total is None:
                return *last, was[:-1], was[-1], False
            sums, old = total[:-1].reshape(last[-1], -1), was[:-1].reshape(last[-1], -1)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-300), old)  # an empty cluster stays where it was
            going = bool((np.abs(centres - old) > AT_REST).any())
            return *last, (centres if going else old).ravel(), total[-1], going

        def moved(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (arrow, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[*key, "held", "centres", "cost", "going"])

        for batch in batches:
            rows = []
            for i, (*of, new) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(5)])):
                y = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                if not new:
                    if last is not None:
                        rows.append(out())
                    last, was, total = of, y, None
                else:
                    total = y.copy() if total is None else total + y
            if rows:
                yield moved(rows)
        if last is not None:
            yield moved([out()])

    bounded_batches(spark)
    schema = f"recording_id {kind}, k int, seed int, held int, centres array<double>, cost double, going boolean"
    before = state
    for _ in range(iterations):
        sums = meet(state.filter("going")).select("recording_id", "blk", "ids", "traces", "of_k", "of_seed", "of_held", "centres").mapInArrow(add, f"recording_id {kind}, k int, seed int, held int, new int, y array<double>")
        both = sums.unionByName(state.select(*key, "held", F.lit(0).alias("new"), F.concat("centres", F.array("cost")).alias("y")))
        state, before = staged(spark, both.repartition(*key).sortWithinPartitions(*key, "new").mapInArrow(move, schema), "kmeans-centres"), state
        if not state.filter("going").select("k").take(1):
            break
    # the costs are those of the centres before the last move
    last = before.select(*key, "held", "centres").join(state.select(*key, "cost").hint("merge"), key)
    best = last.groupBy("recording_id", "k").agg(F.min_by(F.struct("seed", "held", "centres"), F.struct(F.round("cost", 9), "seed")).alias("b")).select("recording_id", "k", "b.*")
    rows = meet(best).select("recording_id", "blk", "ids", "traces", "of_k", "of_seed", "of_held", "centres")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, 2):
            ids, x = table.column("ids").combine_chunks().flatten(), rows_of(table)
            for k, _, held, centres in started(table):
                rec = pa.array([table.column(0)[0].as_py()] * len(ids), table.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([rec, pa.array([k] * len(ids), pa.int32()), ids, pa.array(labels(x, centres, held)[0][0], pa.int32())], names=["recording_id", "k", "unit_id", "cluster"])

    return rows.mapInArrow(assign, f"recording_id {kind}, k int, unit_id {unit}, cluster int")


def varimax_components(pcs: DataFrame, share: float = 0.8, most: int = 8) -> DataFrame:
    """(recording_id, q): components needed for a share of the variance, between 2 and ``most``; ``pcs`` holds at least ``most`` of them."""
    so_far = F.sum("share").over(Window.partitionBy("recording_id").orderBy("pc"))
    reached = pcs.select("recording_id", "pc", so_far.alias("s")).groupBy("recording_id").agg(F.min(F.when(F.col("s") >= share - 1e-12, F.col("pc") + 1)).alias("q"))
    return reached.select("recording_id", F.greatest(F.least(F.coalesce("q", F.lit(most)), F.lit(most)), F.lit(2)).alias("q"))


def loading_rows(load: DataFrame) -> DataFrame:
    """(recording_id, unit_id, l): the loadings of each unit in the order of their components."""
    wide = load.groupBy(*UNIT).agg(F.sort_array(F.collect_list(F.struct("pc", "loading"))).alias("l"))
    return wide.select(*UNIT, F.col("l.loading").alias("l"))


def varimax_assign(load: DataFrame, iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """(recording_id, unit_id, mode): component with the largest absolute varimax-rotated loading; ``load`` is meant to be of unit norm."""
    return varimax_modes(staged(load.sparkSession, loading_rows(load), "varimax-loadings"), iterations, tol)


def varimax_modes(wide: DataFrame, iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """``varimax_assign`` of rows as ``loading_rows`` gives them, which are read twice.

    The criterion depends on the loadings only through their second and fourth moments over the
    units: one pass sums those (K^4 numbers per recording), and the rotation is found from them.
    """
    kind = dict(wide.dtypes)["recording_id"]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(r, n, m2.ravel().tolist(), m4.ravel().tolist()) for r, (n, m2, m4) in total.items()], columns=["recording_id", "n", "m2", "m4"])

        for p in batches:
            for rec, own in p.groupby("recording_id"):
                a = np.stack(own["l"])
                two = np.einsum("ua,ub->uab", a, a).reshape(len(a), -1)
                new = (len(a), two.sum(axis=0), two.T @ two)
                old = total.get(rec, (0, 0.0, 0.0))
                total[rec] = tuple(x + y for x, y in zip(old, new))
            if len(total) > 32 * HELD_SUMS:
                yield out()
                total.clear()
        yield out()

    def rotate(p: pd.DataFrame) -> pd.DataFrame:
        n = p["n"].sum()
        m2, m4 = (np.sum([np.array(v) for v in p[c]], axis=0) for c in ("m2", "m4"))
        size = int(round(len(m2) ** 0.5))
        m2, m4 = m2.reshape(size, size), m4.reshape((size,) * 4)
        r, was = np.eye(size), 0.0
        for _ in range(iterations):
            cubes = np.einsum("abcd,bj,cj,dj->aj", m4, r, r, r)
            u, s, vt = np.linalg.svd(cubes - m2 @ r * (np.einsum("ab,aj,bj->j", m2, r, r) / n))
            r, crit = u @ vt, float(s.sum())
            if crit <= was * (1 + tol):
                break
            was = crit
        return pd.DataFrame({"recording_id": [p["recording_id"].iloc[0]], "rot": [r.ravel().tolist()], "size": [size]})

    sums = wide.select("recording_id", "l").mapInPandas(moments, f"recording_id {kind}, n long, m2 array<double>, m4 array<double>")
    rot = sums.groupBy("recording_id").applyInPandas(rotate, f"recording_id {kind}, rot array<double>, size int")
    last = F.col("size") - 1
    # position and value of the rotated loadings, column by column of the rotation
    column = lambda c: F.aggregate(F.sequence(F.lit(0), last), F.lit(0.0), lambda s, i: s + F.get("l", i) * F.get("rot", i * F.col("size") + c))
    ranked = F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(F.abs(column(c)).alias("a"), (-c).alias("m")))
    return wide.join(rot, "recording_id").select(*UNIT, (-F.array_max(ranked)["m"]).alias("mode"))


def cosine_modes(arrays: DataFrame, components: int) -> DataFrame:
    """(recording_id, pc, n, share, score): modes of the cosine similarity of frames, of standardised traces whose frames have length 1 over the units."""
    units = staged(arrays.sparkSession, _standardised(arrays), "cosine-units")
    norms = frame_sums(units, 2).select("recording_id", F.transform("y", F.sqrt).alias("_norm"))
    scaled = units.join(norms, "recording_id").select(*UNIT, F.zip_with("trace", "_norm", lambda x, n: F.when(n > 0, x / n).otherwise(x)).alias("trace"))
    return pca(scaled, components, standardise=False)


def cosine_correlations(arrays: DataFrame, components: int) -> DataFrame:
    """(recording_id, unit_id, pc, loading): correlation of each unit with each of the ``cosine_modes``."""
    modes = cosine_modes(arrays, components)
    # a mode's own time course, centred and of unit length, so that products with standardised traces are correlations
    centred = _standardised(modes.select("recording_id", F.col("pc").alias("unit_id"), F.col("score").alias("trace")))
    unit = modes.drop("score").join(centred.select("recording_id", F.col("unit_id").alias("pc"), F.col("trace").alias("score")), ["recording_id", "pc"])
    return loadings(arrays, unit)


def cosine_assign(arrays: DataFrame, components: int) -> DataFrame:
    """(recording_id, unit_id, mode, r): each unit under the mode of ``cosine_modes`` that it correlates with most, and that correlation."""
    m = mode_assignment(cosine_correlations(arrays, components))
    return m.select(*UNIT, "mode", (F.col("strength") * F.col("sign")).alias("r"))


def _labels_of_units(clusters: DataFrame) -> DataFrame:
    """(recording_id, unit_id, solutions, clusters): the labels of each unit in one row."""
    own = clusters.groupBy(*UNIT).agg(F.collect_list(F.struct(F.col("solution").cast("string").alias("solution"), F.col("cluster").cast("long").alias("cluster"))).alias("c"))
    return own.select(*UNIT, F.col("c.solution").alias("solutions"), F.col("c.cluster").alias("clusters"))


def _labelled_units(arrays: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole and loose units (see ``pairs.whole_and_loose``) with their labels."""
    return staged(arrays.sparkSession, whole_and_loose(arrays.select(*UNIT, "trace").join(labels, UNIT).select(*UNIT, "trace", "solutions", "clusters")), "cluster-units")


def cluster_sums(arrays: DataFrame, clusters: DataFrame) -> DataFrame:
    """(recording_id, solution, u, cu, cv, r, n): per unit and cluster the summed correlation with the cluster's other units, and how many they are.

    ``clusters`` (recording_id, solution, unit_id, cluster) may hold many solutions. The correlations of a unit
    with all whole traces of a cluster add up to one product with the sum of their vectors, so each unit meets
    the clusters instead of the units. Pairs with a loose trace (see ``pairs.whole_and_loose``) go one by one.
    """
    return _sums_of(_labelled_units(arrays, _labels_of_units(clusters)))


def _sums_of(units: DataFrame) -> DataFrame:
    sums = _whole_cluster_sums(units.filter("loose = 0").drop("loose"))
    if units.filter("loose = 1").limit(1).count():
        sums = sums.unionByName(_pair_cluster_sums(units))
        sums = sums.groupBy("recording_id", "solution", "u", "cu", "cv").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    return sums


def _by_solution(solutions: pa.ListArray, clusters: pa.ListArray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each solution: the rows that it labels, and their clusters."""
    names = solutions.flatten().dictionary_encode()
    code, cluster = names.indices.fill_null(-1).to_numpy(), clusters.flatten().to_numpy()
    row = np.repeat(np.arange(len(solutions)), solutions.value_lengths().to_numpy())
    for i, name in enumerate(names.dictionary.to_pylist()):
        own = np.flatnonzero(code == i)
        yield name, row[own], cluster[own]


def _cluster_vectors(units: DataFrame) -> DataFrame:
    """(recording_id, solution, cluster, y, size): of each cluster the summed vectors of its whole units, and how many they are."""
    (kind, arrow), key = _kind(units), ["recording_id", "solution", "cluster"]
    bounded_batches(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*total), (arrow, pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.list_(pa.float64()))], names=[*key, "y"])

        for batch in batches:
            recs = np.array(batch.column(0).to_pylist())
            for rec in np.unique(recs).tolist():
                own = batch.filter(pa.array(recs == rec))
                x = padded(own.column(1))
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)  # the last number counts
                for name, row, cluster in _by_solution(own.column(2), own.column(3)):
                    order = np.argsort(cluster, kind="stable")
                    found, first = np.unique(cluster[order], return_index=True)
                    for c, y in zip(found.tolist(), np.add.reduceat(x[row[order]], first, axis=0)):
                        total[rec, name, c] = total[rec, name, c] + y if (rec, name, c) in total else y
                if len(total) * x.shape[1] > 4 * CHUNK:
                    yield out()
                    total.clear()
        if total:
            yield out()

    parts = units.select("recording_id", "trace", "solutions", "clusters").mapInArrow(run, f"recording_id {kind}, solution string, cluster long, y array<double>")
    both = _met(_met(_salted(parts), [*key, "salt"]), key)
    vectors = both.select(*key, F.slice("y", F.lit(1), F.size("y") - 1).alias("y"), F.element_at("y", -1).cast("long").alias("size"))
    return staged(units.sparkSession, vectors, "cluster-vectors")


def _whole_cluster_sums(units: DataFrame) -> DataFrame:
    """``cluster_sums`` of whole units, by the vectors of the clusters."""
    of = F.explode(F.arrays_zip(F.col("solutions").alias("solution"), F.col("clusters").alias("cluster"))).alias("c")
    vectors = _cluster_vectors(units)
    own = units.select("recording_id", "unit_id", "trace", of).select("recording_id", "unit_id", "trace", "c.solution", F.col("c.cluster").alias("cu"))
    # a recording's clusters are a short list per solution, which each of its units meets in one row
    lists = vectors.groupBy("recording_id", "solution").agg(F.collect_list(F.struct("cluster", "size", "y")).alias("v"))
    same = ["recording_id", "solution"]
    rows = own.join(F.broadcast(lists) if _few_bytes(vectors) else lists, same)
    product = lambda y: F.aggregate(F.zip_with("trace", y, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = rows.select(*same, F.col("unit_id").alias("u"), "cu", "trace", F.explode("v").alias("w")).select(*same, "u", "cu", F.col("w.cluster").alias("cv"), product(F.col("w.y")).alias("r"), F.col("w.size").alias("n"))
    mine = (F.col("cu") == F.col("cv")).cast("int")  # less the unit itself, whose product with itself is 1
    return met.select(*same, "u", "cu", "cv", (F.col("r") - mine).alias("r"), (F.col("n") - mine).alias("n")).filter("n > 0")


def _whole_within(vectors: DataFrame) -> DataFrame:
    """``within_by_cluster`` of whole units: the square of a cluster's vector is the sum over all its pairs, and 1 for each unit with itself."""
    square = F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.filter("size > 1").select("recording_id", "solution", "cluster", ((square - F.col("size")) / (F.col("size") * (F.col("size") - 1))).alias("within"))


def _whole_silhouettes(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """(recording_id, solution, silhouette): mean silhouette of whole units. A block of units meets the vectors of its recording at once, and gives one sum per solution."""
    kind, arrow = _kind(units)
    longest = units.agg(F.max(F.size("trace"))).first()[0] or 1
    blocks = dealt(units, max(128, min(1024, CHUNK // longest))).groupBy("recording_id", "blk").agg(F.collect_list(F.struct("trace", "solutions", "clusters")).alias("u"))
    lists = vectors.groupBy("recording_id").agg(F.collect_list(F.struct("solution", "cluster", "size", "y")).alias("v"))
    lists = lists.select("recording_id", F.col("v.solution").alias("names"), F.col("v.cluster").alias("of"), F.col("v.size").alias("sizes"), F.flatten("v.y").alias("y"))
    if _few_bytes(vectors):
        rows = blocks.join(F.broadcast(lists), "recording_id")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        rows = blocks.withColumn("salt", F.pmod("blk", F.lit(SALTS))).join(salted, ["recording_id", "salt"])
    bounded_batches(units.sparkSession)

    def block(rec, traces, solutions, clusters, names, of, sizes, y) -> Iterator[tuple]:
        x, of, sizes = padded(traces.values), of.values.to_numpy(), sizes.values.to_numpy()
        y, places = y.values.to_numpy().reshape(len(of), -1), {}
        for i, name in enumerate(names.values.to_pylist()):
            places.setdefault(name, []).append(i)
        for name, row, cluster in _by_solution(solutions.values, clusters.values):
            at = np.array(places[name])
            at = at[np.argsort(of[at])]
            mine, n, total, count = np.searchsorted(of[at], cluster), sizes[at].astype(float), 0.0, 0
            step = max(1, CHUNK // len(at))
            for one in range(0, len(row), step):
                own, units_at = mine[one : one + step], np.arange(len(mine[one : one + step]))
                r = y[at] @ x[row[one : one + step]].T
                alone = n[own] < 2
                a = np.where(alone, np.nan, 1 - (r[own, units_at] - 1) / np.where(alone, 1, n[own] - 1))
                gap = 1 - r / n[:, None]
                gap[own, units_at] = np.inf
                b = gap.min(axis=0)
                known = np.isfinite(a) & np.isfinite(b)
                s = (b - a)[known] / np.maximum(a, b)[known]
                total, count = total + s.sum(), count + len(s)
            yield rec, name, float(total), count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for i in range(batch.num_rows) for r in block(batch.column(0)[i].as_py(), *[c[i] for c in batch.columns[1:]])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (arrow, pa.string(), pa.float64(), pa.int64()))], names=["recording_id", "solution", "s", "n"])

    rows = rows.select("recording_id", "u.trace", "u.solutions", "u.clusters", "names", "of", "sizes", "y")
    sums = rows.mapInArrow(run, f"recording_id {kind}, solution string, s double, n long").groupBy("recording_id", "solution").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("recording_id", "solution", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("silhouette"))


def _coherence(arrays: DataFrame, labels: DataFrame) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """``within_by_cluster`` of labelled units, and what gives their silhouettes: from the vectors of clusters, or from sums of correlations where some units are loose."""
    units = _labelled_units(arrays, labels)
    if units.filter("loose = 1").limit(1).count():
        sums = staged(arrays.sparkSession, _sums_of(units), "cluster-sums")
        return within_by_cluster(sums), lambda: _silhouettes(sums)
    whole = units.drop("loose")
    vectors = _cluster_vectors(whole)
    return _whole_within(vectors), lambda: _whole_silhouettes(whole, vectors)


def _silhouettes(sums: DataFrame) -> DataFrame:
    """(recording_id, solution, silhouette): mean silhouette from summed correlations of units with clusters."""
    rec, gap = ["recording_id", "solution"], 1 - F.col("r") / F.col("n")
    mine, other = F.max(F.when(F.col("cu") == F.col("cv"), gap)), F.min(F.when(F.col("cu") != F.col("cv"), gap))
    s = sums.groupBy(*rec, "u").agg(mine.alias("a"), other.alias("b"))
    return s.groupBy(*rec).agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


#: Bytes up to which the vectors of all clusters are broadcast.
BROADCAST_BYTES = 32 << 20


def _few_bytes(vectors: DataFrame) -> bool:
    return (vectors.agg(F.sum(F.size("y") * F.lit(8).cast("long")).alias("n")).first().n or 0) <= BROADCAST_BYTES


def _pair_cluster_sums(units: DataFrame) -> DataFrame:
    """``cluster_sums`` pair by pair, for the pairs that have a loose unit."""
    def of(table: dict) -> dict[str, np.ndarray]:
        """Cluster of each unit by solution, -1 for none."""
        out: dict[str, np.ndarray] = {}
        for i, (names, ids) in enumerate(zip(table["solutions"].to_pylist(), table["clusters"].to_pylist())):
            for name, c in zip(names, ids):
                out.setdefault(name, np.full(len(table["unit_id"]), -1))[i] = c
        return out

    def kernel(a, b, r, count):
        out: dict[str, list] = {c: [] for c in ("solution", "u", "cu", "cv", "r", "n")}
        count = count & np.isfinite(r)
        r = np.where(count, r, 0.0)
        of_a, of_b = of(a), of(b)
        ids_a, ids_b = a["unit_id"].to_pylist(), b["unit_id"].to_pylist()
        for name in of_a.keys() & of_b.keys():
            for ids, mine, others, rr, nn in ((ids_a, of_a[name], of_b[name], r, count), (ids_b, of_b[name], of_a[name], r.T, count.T)):
                for c in np.unique(others[others >= 0]):
                    n = nn[:, others == c].sum(axis=1)
                    at = np.flatnonzero((n > 0) & (mine >= 0))
                    total = rr[:, others == c].sum(axis=1)
                    for key, v in (("solution", [name] * len(at)), ("u", [ids[i] for i in at]), ("cu", mine[at]), ("cv", [c] * len(at)), ("r", total[at]), ("n", n[at])):
                        out[key] += list(v)
        return out

    unit = dict(units.dtypes)["unit_id"]
    kinds = {"solution": ("string", pa.string()), "u": (unit, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[unit]), "cu": ("long", pa.int64()), "cv": ("long", pa.int64()), "r": ("double", pa.float64()), "n": ("long", pa.int64())}
    return block_pairs(units, kernel, kinds, loose="loose").groupBy("recording_id", "solution", "u", "cu", "cv").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))


def within_by_cluster(sums: DataFrame, name: str = "within") -> DataFrame:
    """(recording_id, solution, cluster, within): mean correlation of the pairs inside each cluster."""
    return sums.filter("cu = cv").groupBy("recording_id", "solution", F.col("cu").alias("cluster")).agg((F.sum("r") / F.sum("n")).alias(name))


def cluster_eval(arrays: DataFrame, clusters: DataFrame, acfs: DataFrame, dom: DataFrame, least: int = 2) -> DataFrame:
    """(recording_id, solution, clusters, used, within, acf_within, freq_cv, silhouette): quality of clusters (recording_id, solution, unit_id, cluster).

    Means over clusters of at least ``least`` units (``used`` of them): correlation of the traces and of the
    autocorrelations (arrays, acfs) inside a cluster, and the coefficient of variation of its units' dominant
    frequencies (recording_id, unit_id, dom). The silhouette by correlation distance is NULL
    unless there are two clusters and each has two units.
    """
    spark = arrays.sparkSession
    rec, key = ["recording_id", "solution"], ["recording_id", "solution", "cluster"]
    clusters = clusters.select("recording_id", F.col("solution").cast("string").alias("solution"), "unit_id", F.col("cluster").cast("long").alias("cluster"))
    labels = staged(spark, _labels_of_units(clusters), "cluster-labels")
    sizes = clusters.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    each = F.explode(F.arrays_zip(F.col("solutions").alias("solution"), F.col("clusters").alias("cluster"))).alias("c")
    freq = dom.filter("dom > 0").join(labels, UNIT).select("recording_id", "dom", each).select("recording_id", "dom", "c.*")
    freq = freq.groupBy(*key).agg(F.when(F.count("dom") >= 2, F.stddev_samp("dom") / F.avg("dom")).alias("freq_cv"))
    (within, silhouettes), (acf_within, _) = _coherence(arrays, labels), _coherence(acfs, labels)
    per = sizes.join(within, key, "left").join(acf_within.withColumnRenamed("within", "acf_within"), key, "left").join(freq, key, "left")
    large = lambda c: F.avg(F.when(F.col("size") >= least, F.col(c))).alias(c)
    out = per.groupBy(*rec).agg(F.count(F.lit(1)).alias("clusters"), F.count(F.when(F.col("size") >= least, 1)).alias("used"), large("within"), large("acf_within"), large("freq_cv"), F.min("size").alias("_least"))
    told = F.when((F.col("clusters") >= 2) & (F.col("_least") >= 2), F.col("silhouette"))
    return out.join(silhouettes(), rec, "left").select(*rec, "clusters", "used", "within", "acf_within", "freq_cv", told.alias("silhouette"))


def cluster_acf(acfs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(recording_id, cluster, size, lag, r): sizes and mean autocorrelation of clusters."""
    own = acfs.join(clusters, UNIT).select("recording_id", F.col("cluster").cast("long").alias("cluster"), F.posexplode("trace").alias("lag", "v"))
    return own.groupBy("recording_id", "cluster", "lag").agg(F.avg("v").alias("r"), F.count(F.lit(1)).alias("size")).select("recording_id", "cluster", "size", "lag", "r")


def cluster_ranking(results: DataFrame, by: list[str] = ["recording_id"]) -> DataFrame:
    """Adds score: within each group of solutions, z of trace and ACF coherence and silhouette less z of frequency spread; a missing one adds nothing."""
    w = Window.partitionBy(*by)
    z = lambda c: F.coalesce(F.when(F.stddev_samp(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_samp(c).over(w)), F.lit(0.0))
    return results.withColumn("score", z("within") + z("acf_within") - z("freq_cv") + z("silhouette"))
