"""Pairwise correlation and space: correlation by distance, shuffled controls, gradients, densities.

All-pairs correlation runs as block products: the units of a recording are dealt into blocks, and
each pair of blocks is one small matrix product in a task. What is asked of the pairs (a distance
bin, a class, a cluster) is worked out next to the product, so that sums leave the task and no
table of all pairs is joined or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.batches import matrices, padded, runs_of
from ..sources.staging import bounded_batches, staged
from .aggregates import corr, iqr, trapz
from .joins import interpolate_to, unit_pairs
from .ranks import mean_rank, places

#: Units of a tile: a task goes through the pairs of two blocks tile by tile.
TILE = 256
#: Blocks that a recording is dealt into, more where the traces of one would take more bytes than this. A unit's row goes to as many tasks as there are blocks.
BLOCKS, BLOCK_BYTES = 16, 64 << 20
#: Pairs of units of a partition, where those decide, and partitions at most.
TASK_PAIRS, MOST_TASKS = 1 << 21, 4096
#: Recordings up to which their block numbers are broadcast: a few numbers each.
BROADCAST_RECORDINGS = 200_000


def _standardised(arrays: DataFrame) -> DataFrame:
    """(recording_id, unit_id, trace): traces as unit vectors around their mean; units with a missing value or without spread are left out."""
    bounded_batches(arrays.sparkSession)
    kinds = dict(arrays.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(2)):
                if not x.shape[1]:
                    continue
                x = x - x.mean(axis=1, keepdims=True)
                norm = np.sqrt((x * x).sum(axis=1))
                keep = np.flatnonzero(norm > 1e-12)  # NaN where a value is missing
                rows = pa.array(at[keep])
                traces = pa.array(list(x[keep] / norm[keep, None]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), traces], names=["recording_id", "unit_id", "trace"])

    rows = arrays.select("recording_id", "unit_id", F.col("trace").cast("array<double>").alias("trace"))
    return rows.mapInArrow(run, f"recording_id {kinds['recording_id']}, unit_id {kinds['unit_id']}, trace array<double>")


def dealt(units: DataFrame, block: int) -> DataFrame:
    """Adds ``blocks``, the number of blocks of the recording, and ``blk``, the unit's own."""
    counts = units.groupBy("recording_id").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).cast("int").alias("blocks"))
    if counts.count() <= BROADCAST_RECORDINGS:
        counts = F.broadcast(counts)
    return units.join(counts, "recording_id").withColumn("blk", F.pmod(F.xxhash64("unit_id"), F.col("blocks")).cast("int"))


def _beside_recordings(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the columns of a table of a few numbers per recording, which is broadcast where it is short."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_RECORDINGS else table, "recording_id")


def _blocks_for(units: Column, longest: Column, block: int | None) -> Column:
    """How many blocks so many units with traces of this length are dealt into."""
    if block:
        return F.ceil(units / block).cast("int")
    return F.least(F.ceil(units / TILE), F.greatest(F.lit(BLOCKS), F.ceil(units.cast("double") * longest * 8 / BLOCK_BYTES))).cast("int")


def block_pairs(units: DataFrame, kernel: Callable[[dict, dict, np.ndarray, np.ndarray], dict], outputs: dict[str, tuple[str, pa.DataType]], block: int | None = None, loose: str | None = None, apart: bool = False) -> DataFrame:
    """(recording_id, outputs...): what a kernel makes of each pair of tiles of a recording.

    ``units`` (recording_id, unit_id, trace, ...). The kernel gets the columns of both tiles, the
    correlations of their units, and which of the pairs to count (within one tile each pair once).
    Pairs of blocks are the tasks, so rows are copied as often as a recording has blocks, whose number
    does not grow with its units as long as two of them fit a task. With ``loose``, a column of 0 and 1,
    only pairs count of which a unit has 1. With ``apart`` they are dealt to partitions by the pairs of
    units that they make, ``TASK_PAIRS`` each as long as there are pairs of blocks enough, ``MOST_TASKS`` at most:
    adaptive execution goes by what they read, which is small, though what they make grows with the square of it.
    """
    columns = [c for c in units.columns if c not in ("recording_id", loose)]
    kinds = dict(units.dtypes)
    bounded_batches(units.sparkSession)
    flag = F.col(loose) if loose else F.lit(1)
    longest = F.max(F.size("trace"))
    counts = units.groupBy("recording_id").agg(_blocks_for(F.count(F.when(flag == 1, 1)), longest, block).alias("_loose"), _blocks_for(F.count(F.when(flag == 0, 1)), longest, block).alias("_rest"))
    dealt_to = lambda n: F.pmod(F.xxhash64("unit_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    own = F.when(flag == 1, dealt_to("_loose")).otherwise(F.col("_loose") + dealt_to("_rest"))
    meets = F.when(flag == 1, F.col("_loose") + F.col("_rest")).otherwise(F.col("_loose"))
    lanes = _beside_recordings(units, counts).withColumn("blk", own).withColumn("_meets", meets).filter("_meets > 0")
    lanes = lanes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_meets") - 1)))
    low, high = F.least("blk", "other"), F.greatest("blk", "other")
    lanes = lanes.select("recording_id", low.alias("_low"), high.alias("_high"), (F.col("blk") == high).cast("int").alias("_side"), *columns)
    tasks = []
    if apart:
        many = lambda n: F.col(n) * (F.col(n) + 1.0) / 2
        sizes = counts.join(units.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_units")), "recording_id")
        blocks, made = sizes.agg(F.sum(many("_loose") + F.col("_loose") * F.col("_rest")), F.sum(many("_units"))).first()
        tasks = [max(1, min(int(blocks or 1), math.ceil((made or 1) / TASK_PAIRS), MOST_TASKS))]
    lanes = lanes.repartition(*tasks, "recording_id", "_low", "_high").sortWithinPartitions("recording_id", "_low", "_high", "_side", "unit_id")

    def tiles(table: pa.Table) -> Iterator[tuple[dict, dict, np.ndarray, np.ndarray, bool]]:
        side = table.column("_side").to_numpy()
        one_block = table.column("_low")[0] == table.column("_high")[0]
        a = {c: table.column(c).combine_chunks() for c in columns} if one_block else {c: table.column(c).filter(pa.array(side == 0)).combine_chunks() for c in columns}
        b = a if one_block else {c: table.column(c).filter(pa.array(side == 1)).combine_chunks() for c in columns}
        if not len(a["unit_id"]) or not len(b["unit_id"]):
            return
        x = padded(a["trace"])
        y = x if one_block else padded(b["trace"])
        if x.shape[1] != y.shape[1]:
            wide = max(x.shape[1], y.shape[1])
            x, y = (np.pad(m, ((0, 0), (0, wide - m.shape[1])), constant_values=np.nan) for m in (x, y))
        cut = lambda of, i: {c: v.slice(i, TILE) for c, v in of.items()}
        for i in range(0, len(x), TILE):
            for j in range(i if one_block else 0, len(y), TILE):
                yield cut(a, i), cut(b, j), x[i : i + TILE], y[j : j + TILE], one_block and i == j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, 3):
            for a, b, x, y, same in tiles(table):
                r = k.pairwise_corr(x, y)
                count = np.triu(np.ones(r.shape, bool), 1) if same else np.ones(r.shape, bool)
                out = kernel(a, b, r, count)
                n = len(next(iter(out.values())))
                rec = pa.array([table.column(0)[0].as_py()] * n, table.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([rec, *[pa.array(out[c], t) for c, (_, t) in outputs.items()]], names=["recording_id", *outputs])

    schema = ", ".join([f"recording_id {kinds['recording_id']}", *[f"{c} {t}" for c, (t, _) in outputs.items()]])
    return lanes.mapInArrow(run, schema)


def whole_and_loose(units: DataFrame) -> DataFrame:
    """``units`` (recording_id, unit_id, trace, ...) with ``loose``: 0 for traces that are known throughout and as long as any of their recording, which become unit vectors around their mean; 1 for others.

    The correlation of two whole traces is the product of their vectors, so sums over pairs come from sums
    of vectors. Traces without spread or values, which correlate with nothing, are left out.
    """
    columns = ["trace", *[c for c in units.columns if c != "trace"]]
    rows = _beside_recordings(units.select(*columns).withColumn("trace", F.col("trace").cast("array<double>")), units.groupBy("recording_id").agg(F.max(F.size("trace")).alias("_longest")))
    rows = rows.select(*columns, "_longest")
    kinds = dict(rows.dtypes)
    bounded_batches(units.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = batch.column(len(columns)).to_numpy()
            for at, x in matrices(batch.column(0)):
                if not x.shape[1]:
                    continue
                known = np.isfinite(x)
                spread = np.where(known, x, -np.inf).max(axis=1) > np.where(known, x, np.inf).min(axis=1)
                at, x, loose = at[spread], x[spread], (~known.all(axis=1) | (longest[at] > x.shape[1]))[spread]
                whole = ~loose
                z = x[whole] - x[whole].mean(axis=1, keepdims=True)
                x[whole] = z / np.sqrt((z * z).sum(axis=1, keepdims=True))
                rows = pa.array(at)
                traces = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([traces, *[batch.column(i).take(rows) for i in range(1, len(columns))], pa.array(loose.astype(np.int32))], names=[*columns, "loose"])

    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in columns], "loose int"]))


def _id_kind(units: DataFrame) -> tuple[str, pa.DataType]:
    kind = dict(units.dtypes)["unit_id"]
    return kind, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def pair_corr(arrays: DataFrame, block: int | None = None) -> DataFrame:
    """(recording_id, a, b, r) for all unit pairs a < b of a recording, over the frames where both have values.

    r is NULL for pairs with fewer than two such frames or without spread there.
    """
    def kernel(a, b, r, count):
        ia, ib = (x["unit_id"].to_numpy(zero_copy_only=False) for x in (a, b))
        low, high = np.minimum(ia[:, None], ib[None]), np.maximum(ia[:, None], ib[None])
        return {"a": low[count], "b": high[count], "r": pa.array(r[count], from_pandas=True)}

    outputs = {"a": _id_kind(arrays), "b": _id_kind(arrays), "r": ("double", pa.float64())}
    return block_pairs(arrays.select("recording_id", "unit_id", "trace"), kernel, outputs, block, apart=True)


#: Bins of a histogram of pair values, and the number of values in an interval from which on they are counted one by one.
BINS, FEW = 4096, 4096
#: Correlations as whole numbers: steps of 2 ** -52 from -1 on, so that bins and their edges are exact.
STEPS = 2**52


def band_vs_rest(arrays: DataFrame, band: DataFrame, block: int | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(recording_id, within, across and their medians and counts): pairs inside a band (recording_id, unit_id) against pairs of inside and outside.

    Medians are exact without holding pairs: each pass of the block products counts a histogram of
    the interval that must hold the middle values, and the next pass takes the bins that do. An
    interval with few values has its distinct values counted. Correlations count as multiples of 2 ** -52.
    """
    spark = arrays.sparkSession
    units = arrays.join(band.select("recording_id", "unit_id", F.lit(1).alias("inside")), ["recording_id", "unit_id"], "left")
    units = staged(spark, units.select("recording_id", "unit_id", "trace", F.coalesce("inside", F.lit(0)).alias("inside")), "band-units")
    key = ["recording_id", "inside"]
    kinds = {"inside": ("int", pa.int32()), "place": ("long", pa.int64()), "n": ("long", pa.int64()), "total": ("double", pa.float64())}

    def histogram(limits: DataFrame, single: bool) -> DataFrame:
        """(recording_id, inside, place, n, total): values within the limits per bin, or per distinct value."""
        wide = limits.groupBy("recording_id").agg(*[F.max(F.when(F.col("inside") == g, F.col(c))).alias(f"{c}{g}") for g in (1, 2) for c in ("low", "high")])

        def kernel(a, b, r, count):
            members = a["inside"].to_numpy()[:, None] + b["inside"].to_numpy()[None]
            known = count & np.isfinite(r)
            out: dict[str, list] = {c: [] for c in kinds}
            for g in (1, 2):
                low, high = (a[f"{c}{g}"][0].as_py() for c in ("low", "high"))
                if low is None:
                    continue
                v = r[known & (members == g)]
                steps = np.rint((np.clip(v, -1.0, 1.0) + 1.0) * STEPS).astype(np.int64)
                own = (steps >= low) & (steps <= high)
                v, steps = v[own], steps[own]
                at = steps if single else (steps - low) // ((high - low) // bins + 1)
                place, which, n = np.unique(at, return_inverse=True, return_counts=True)
                for c, x in (("inside", [g] * len(place)), ("place", place), ("n", n), ("total", np.bincount(which, v, len(place)))):
                    out[c] += list(x)
            return out

        pairs = block_pairs(units.join(wide, "recording_id"), kernel, kinds, block)
        return pairs.groupBy(*key, "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def middle(counts: DataFrame) -> DataFrame:
        """Rows of ``counts`` (with below and pairs) that hold a middle value."""
        before = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows, or few values
        told = counts.withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        first, last = F.floor((F.col("pairs") - 1) / 2), F.floor(F.col("pairs") / 2)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        return told.withColumn("one", holds(first)).withColumn("two", holds(last)).filter(F.col("one") | F.col("two"))

    whole = units.select("recording_id").distinct().select("recording_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("inside"), F.lit(0).cast("long").alias("low"), F.lit(2 * STEPS).cast("long").alias("high"))
    counts = staged(spark, histogram(whole, False), "band-histogram")
    sums = staged(spark, counts.groupBy(*key).agg(F.sum("n").alias("pairs"), (F.sum("total") / F.sum("n")).alias("mean")), "band-sums")
    limits = whole.join(sums.select(*key, "pairs"), key).withColumn("below", F.lit(0).cast("long"))
    while True:
        step = F.floor((F.col("high") - F.col("low")) / bins) + 1
        edge = F.col("low") + F.col("place") * step
        found = middle(counts.join(limits, key)).groupBy(*key, "pairs").agg(F.min(edge).alias("low"), F.max(F.least(edge + step - 1, F.col("high"))).alias("high"), F.min("before").alias("below"), F.sum("n").alias("held"))
        limits = staged(spark, found, "band-limits")
        if not limits.filter((F.col("held") > few) & (F.col("high") > F.col("low"))).limit(1).count():
            break
        counts = staged(spark, histogram(limits.select(*key, "low", "high"), False), "band-histogram")
    values = staged(spark, histogram(limits.select(*key, "low", "high"), True), "band-values")
    told = middle(values.join(limits.select(*key, "pairs", "below"), key))
    value = lambda c: F.max(F.when(F.col(c), F.col("place"))).cast("double") / STEPS - 1.0
    medians = told.groupBy(*key).agg(((value("one") + value("two")) / 2).alias("median"))
    rows = sums.join(medians, key, "left")
    parts = []
    for name, g in (("within", 2), ("across", 1)):
        at = lambda c: F.max(F.when(F.col("inside") == g, F.col(c)))  # noqa: E731, B023
        parts += [at("mean").alias(name), at("median").alias(f"{name}_median"), F.coalesce(at("pairs"), F.lit(0)).cast("long").alias(f"{name}_pairs")]
    return rows.groupBy("recording_id").agg(*parts)


def distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(sum(((F.col(x) - F.col(y)) ** 2 for x, y in zip(a, b)), F.lit(0.0)))


def pair_distances(positions: DataFrame) -> DataFrame:
    """(recording_id, a, b, d, dz): distance in x and y of unit pairs; whether they lie on one side is told by ``same_side``."""
    p = unit_pairs(positions, ["x", "y"])
    return p.select("recording_id", "a", "b", distance(["x_a", "y_a"], ["x_b", "y_b"]).alias("d"), "y_a", "y_b")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points in the plane, in order; at most two points stay as they are."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    sides = []
    for rows in (p, p[::-1]):
        side: list = []
        for q in rows.tolist():
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (q[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (q[0] - side[-2][0]):
                side.pop()
            side.append(q)
        sides += side[:-1]
    return np.array(sides)


def widest(corners: np.ndarray) -> float:
    """Largest distance of two of the corners of a hull, each compared in one array."""
    return float(max((np.hypot(*(corners[i:] - corners[i]).T).max() for i in range(len(corners))), default=0.0))


def span(positions: DataFrame) -> DataFrame:
    """(recording_id, units, top): how many units have a place, and the largest distance of two of them in x and y.

    Tasks reduce the places that they read to the corners of their convex hull, hulls of hulls meet in two
    steps, and only the corners of the last one are compared with each other.
    """
    kind = dict(positions.dtypes)["recording_id"]
    known = positions.filter("x is not null and y is not null").select("recording_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = f"recording_id {kind}, units long, xs array<double>, ys array<double>"
    names = [c.split()[0] for c in schema.split(", ")]

    def reduced(held: dict, arrow: pa.DataType) -> pa.RecordBatch:
        corners = [hull(np.concatenate(h)) for _, h in held.values()]
        cells = [pa.array(list(held), arrow), pa.array([n for n, _ in held.values()], pa.int64()), *[pa.array([c[:, i] for c in corners], pa.list_(pa.float64())) for i in (0, 1)]]
        held.clear()
        return pa.RecordBatch.from_arrays(cells, names=names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            recs = np.array(batch.column(0).to_pylist())
            places = np.column_stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            for rec in np.unique(recs).tolist():
                own = places[recs == rec]
                n, before = held.get(rec, (0, []))
                held[rec] = (n + len(own), [hull(np.concatenate([*before, own]))])
            if len(held) > 1000:
                yield reduced(held, batch.schema.field(0).type)
        if held:
            yield reduced(held, batch.schema.field(0).type)

    def meet(table: pa.Table) -> pa.Table:
        corners = hull(np.column_stack([table[c].combine_chunks().flatten().to_numpy() for c in ("xs", "ys")]))
        row = [table["recording_id"].slice(0, 1).combine_chunks(), pa.array([sum(table["units"].to_pylist())]), *[pa.array([corners[:, i]], pa.list_(pa.float64())) for i in (0, 1)]]
        return pa.table(row, names=names)

    def last(table: pa.Table) -> pa.Table:
        one = meet(table)
        corners = np.column_stack([np.array(one[c][0].as_py()) for c in ("xs", "ys")])
        return pa.table([one["recording_id"], one["units"], pa.array([widest(corners)])], names=["recording_id", "units", "top"])

    parts = known.mapInArrow(first, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    met = parts.groupBy("recording_id", "salt").applyInArrow(lambda t: meet(t), schema)
    return met.groupBy("recording_id").applyInArrow(last, f"recording_id {kind}, units long, top double")


def distance_edges(positions: DataFrame, bins: int = 50, least: float = 50.0, fallback: float = 100.0) -> DataFrame:
    """(recording_id, edge): the distinct whole edges of evenly spaced bins from 0 to the largest distance of two units.

    Where that is under ``least``, or a recording has fewer than two units, the bins span ``fallback``.
    """
    far = span(positions)
    top = F.when((F.col("units") > 1) & (F.col("top") >= least), F.col("top")).otherwise(F.lit(float(fallback)))
    return far.select("recording_id", top.alias("top")).select("recording_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.floor(F.col("top") * i / bins)))).alias("edge"))


def fixed_edges(positions: DataFrame, step: float = 5.0) -> DataFrame:
    """(recording_id, edge): edges ``step`` apart from 0 up to the first at or beyond the largest distance, one bin at least."""
    last = F.greatest(F.ceil(F.col("top") / step), F.lit(1)).cast("int")
    return span(positions).select("recording_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("edge"))


def _binned(out: dict[str, list], seed: int, d: np.ndarray, side: np.ndarray | int, placed: np.ndarray, total: np.ndarray, n: np.ndarray | None, step: float | None, edges: np.ndarray | None) -> None:
    """Adds the sums per side and distance bin of one placing to ``out``."""
    if step is None:
        placed = placed & (d >= edges[0]) & (d < edges[-1])
    at = np.searchsorted(edges, d[placed], "right") - 1 if step is None else np.floor(d[placed] / step).astype(int)
    code = at * 2 + (side if np.isscalar(side) else side[placed])
    n, total = np.bincount(code, None if n is None else n[placed]), np.bincount(code, total[placed])
    at = np.flatnonzero(n)
    for c, v in (("seed", np.full(len(at), seed)), ("side", at % 2), ("bin", at // 2), ("total", total[at]), ("n", n[at].astype(np.int64))):
        out[c] += v.tolist()


#: Units of a block whose vectors are summed by place, and places of a block whose sums are multiplied.
PLACED, PLACES = 8192, 1024


def _pair_distance_sums(units: DataFrame, step: float | None, split: float | None, block: int | None) -> DataFrame:
    """``_distance_sums`` pair by pair, for the pairs that have a loose unit."""
    def kernel(a, b, r, count):
        known = count & np.isfinite(r)
        values = r[known]
        ax, ay, bx, by = (padded(x[c]) for x, c in ((a, "xs"), (a, "ys"), (b, "xs"), (b, "ys")))
        out: dict[str, list] = {c: [] for c in ("seed", "side", "bin", "total", "n")}
        edges = np.array(a["edges"][0].as_py()) if step is None else None
        for seed in range(ax.shape[1]):
            d = np.hypot(ax[:, seed, None] - bx[None, :, seed], ay[:, seed, None] - by[None, :, seed])[known]
            placed, side = np.isfinite(d), 0
            if split is not None:
                sa, sb = (y[:, seed] >= split for y in (ay, by))
                placed &= (sa[:, None] == sb[None])[known]
                side = np.broadcast_to(sa[:, None], r.shape)[known].astype(int)
            _binned(out, seed, d, side, placed, values, None, step, edges)
        return out

    return block_pairs(units, kernel, _SUMS, block, "loose")


_SUMS = {"seed": ("int", pa.int32()), "side": ("int", pa.int32()), "bin": ("int", pa.int32()), "total": ("double", pa.float64()), "n": ("long", pa.int64())}


def _place_distance_sums(units: DataFrame, step: float | None, split: float | None) -> DataFrame:
    """``_distance_sums`` of whole units by the places that they share.

    The correlations of the units of two places add up to the product of their summed vectors. Blocks of
    units sum their vectors by place and placing, blocks of places multiply the sums, so nothing is done pair by pair of units.
    """
    spark = units.sparkSession
    kind = dict(units.dtypes)["recording_id"]
    more = ["edges"] if step is None else []
    counts = units.groupBy("recording_id").agg(F.ceil(F.count(F.lit(1)) / F.least(F.lit(PLACED), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / F.max(8 * F.size("trace") + 16 * F.size("xs")))))).cast("int").alias("blocks"))
    blocks = _beside_recordings(units, counts).withColumn("blk", F.pmod(F.xxhash64("unit_id"), F.col("blocks")).cast("int"))
    blocks = blocks.select("recording_id", "blk", "trace", "xs", "ys").repartition("recording_id", "blk").sortWithinPartitions("recording_id", "blk")

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, 2):
            z, xs, ys = (padded(table.column(c)) for c in ("trace", "xs", "ys"))
            for seed in range(xs.shape[1]):
                own = np.flatnonzero(np.isfinite(xs[:, seed]) & np.isfinite(ys[:, seed]))
                if not len(own):
                    continue
                own = own[np.lexsort((ys[own, seed], xs[own, seed]))]
                x, y = xs[own, seed] + 0.0, ys[own, seed] + 0.0  # no minus zero, so that equal places have equal hashes
                first = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)]))
                sums = np.add.reduceat(z[own], first, axis=0)
                n = np.diff(np.append(first, len(own)))
                rec = pa.array([table.column(0)[0].as_py()] * len(n), table.schema.field(0).type)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([rec, pa.array(np.full(len(n), seed, np.int32)), pa.array(x[first]), pa.array(y[first]), pa.array(n.astype(np.int64)), vectors], names=["recording_id", "seed", "x", "y", "n", "v"])

    parts = staged(spark, blocks.mapInArrow(by_place, f"recording_id {kind}, seed int, x double, y double, n long, v array<double>"), "place-sums")
    key = ["recording_id", "seed"]
    sizes = parts.groupBy(*key).agg(F.approx_count_distinct(F.struct("x", "y")).alias("_places"), F.max(F.size("v")).alias("_long"))
    sizes = sizes.select(*key, F.greatest(F.lit(1), F.least(F.ceil(F.col("_places") / PLACES), F.greatest(F.lit(BLOCKS), F.ceil(F.col("_places") * F.col("_long") * 8 / BLOCK_BYTES)))).cast("int").alias("blocks"))
    lanes = parts.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_RECORDINGS else sizes, key)
    lanes = lanes.withColumn("blk", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if more:
        edges = units.groupBy("recording_id").agg(F.first("edges").alias("edges"))
        lanes = _beside_recordings(lanes, edges)
    low, high = F.least("blk", "other"), F.greatest("blk", "other")
    lanes = lanes.select(*key, low.alias("_low"), high.alias("_high"), (F.col("blk") == high).cast("int").alias("_side"), "x", "y", "n", "v", *more)
    lanes = lanes.repartition(*key, "_low", "_high").sortWithinPartitions(*key, "_low", "_high", "_side", "x", "y")

    def met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of one side, each once."""
        x, y, n = (table.column(c).to_numpy() for c in ("x", "y", "n"))
        v = padded(table.column("v"))
        if not len(x):
            return x, y, n.astype(float), v
        first = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)]))
        return x[first], y[first], np.add.reduceat(n, first).astype(float), np.add.reduceat(v, first, axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, 4):
            rec, seed = table.column(0)[0].as_py(), table.column(1)[0].as_py()
            one_block = table.column("_low")[0] == table.column("_high")[0]
            side = table.column("_side").to_numpy()
            a = met(table if one_block else table.filter(pa.array(side == 0)))
            b = a if one_block else met(table.filter(pa.array(side == 1)))
            edges = np.array(table.column("edges")[0].as_py()) if more else None
            out: dict[str, list] = {c: [] for c in _SUMS}
            for i in range(0, len(a[0]), PLACES):
                for j in range(i if one_block else 0, len(b[0]), PLACES):
                    (ax, ay, an, av), (bx, by, bn, bv) = (tuple(c[at : at + PLACES] for c in of) for of, at in ((a, i), (b, j)))
                    total, n = av @ bv.T, an[:, None] * bn[None]
                    if one_block and i == j:
                        # the pairs within a place, then each pair of places once
                        np.fill_diagonal(total, (total.diagonal() - an) / 2)
                        np.fill_diagonal(n, an * (an - 1) / 2)
                        n = np.triu(n)
                    placed = n > 0
                    which = np.zeros(n.shape, int)
                    if split is not None:
                        sa, sb = ay >= split, by >= split
                        placed &= sa[:, None] == sb[None]
                        which = np.broadcast_to(sa[:, None], n.shape).astype(int)
                    d = np.hypot(ax[:, None] - bx[None], ay[:, None] - by[None])
                    _binned(out, seed, d, which, placed, total, n, step, edges)
            recs = pa.array([rec] * len(out["n"]), table.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([recs, *[pa.array(out[c], t) for c, (_, t) in _SUMS.items()]], names=["recording_id", *_SUMS])

    return lanes.mapInArrow(run, ", ".join([f"recording_id {kind}", *[f"{c} {t}" for c, (t, _) in _SUMS.items()]]))


def _distance_sums(units: DataFrame, step: float | None, split: float | None, block: int | None, by_place: bool | None = None) -> DataFrame:
    """(recording_id, seed, side, bin, total, n): sums of correlations per distance bin, for each of the placings xs, ys of a unit.

    Bins are ``step`` wide, or lie between the recording's own ``edges``, which then are a column of the units.
    Whole units go by the places that they share, unless a recording has so many places that their sums are
    much more bytes than its units (``by_place`` decides for all); pairs of units with missing values go one by one.
    """
    spark = units.sparkSession
    rows = staged(spark, whole_and_loose(units), "placed-units")
    if by_place is None:
        n, t, seeds = F.count(F.lit(1)), F.max(F.size("trace")), F.max(F.size("xs"))
        first = F.filter(F.arrays_zip("xs", "ys"), lambda p: p["xs"].isNotNull())
        some = F.approx_count_distinct(F.when(F.size(first) > 0, F.get(first, F.lit(0))))
        sizes = rows.filter("loose = 0").groupBy("recording_id").agg(n.alias("_n"), t.alias("_t"), seeds.alias("_s"), some.alias("_u"))
        moved = F.col("_s") * F.col("_u") * (F.col("_t") + 3) * F.least(F.lit(BLOCKS), F.ceil(F.col("_u") / PLACES))
        paired = F.col("_n") * (F.col("_t") + 2 * F.col("_s")) * F.least(F.lit(BLOCKS), F.ceil(F.col("_n") / TILE))
        apart = sizes.filter(moved > 4 * paired).select("recording_id", F.lit(1).alias("_apart"))
        rows = rows.join(F.broadcast(apart) if apart.count() <= BROADCAST_RECORDINGS else apart, "recording_id", "left").withColumn("loose", F.greatest("loose", F.coalesce("_apart", F.lit(0)))).drop("_apart")
    elif not by_place:
        rows = rows.withColumn("loose", F.lit(1))
    sums = _place_distance_sums(rows.filter("loose = 0"), step, split)
    if rows.filter("loose = 1").limit(1).count():
        sums = sums.unionByName(_pair_distance_sums(rows, step, split, block))
    return sums.groupBy("recording_id", "seed", "side", "bin").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def corr_vs_distance(arrays: DataFrame, positions: DataFrame, step: float, split: float | None = None, block: int | None = None) -> DataFrame:
    """(recording_id, [side,] bin, r, pairs): mean correlation per distance bin of width ``step``, within each side of ``split`` on y if given."""
    units = arrays.join(positions.select("recording_id", "unit_id", F.array("x").alias("xs"), F.array("y").alias("ys")), ["recording_id", "unit_id"])
    sums = _distance_sums(units.select("recording_id", "unit_id", "trace", "xs", "ys"), step, split, block)
    by = ["recording_id", "bin"] if split is None else ["recording_id", "side", "bin"]
    return sums.select(*by, (F.col("total") / F.col("n")).alias("r"), F.col("n").alias("pairs"))


def _edges_of(edges: DataFrame) -> DataFrame:
    """(recording_id, edges): the edges of each recording that has a bin at all."""
    return edges.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.col("edge").cast("double"))).alias("edges")).filter(F.size("edges") > 1)


def corr_between_edges(arrays: DataFrame, positions: DataFrame, edges: DataFrame, split: float | None = None, block: int | None = None) -> DataFrame:
    """(recording_id, [side,] bin, edge, r, pairs): mean correlation of pairs whose distance is at least an edge and less than the next, on each recording's ``edges`` (recording_id, edge)."""
    own = _edges_of(edges)
    units = arrays.join(positions.select("recording_id", "unit_id", F.array("x").alias("xs"), F.array("y").alias("ys")), ["recording_id", "unit_id"]).join(own, "recording_id")
    sums = _distance_sums(units.select("recording_id", "unit_id", "trace", "xs", "ys", "edges"), None, split, block).join(own, "recording_id")
    by = ["recording_id", "bin"] if split is None else ["recording_id", "side", "bin"]
    return sums.select(*by, F.get("edges", F.col("bin")).alias("edge"), (F.col("total") / F.col("n")).alias("r"), F.col("n").alias("pairs"))


def shuffle_key(unit: Column, seed: Column) -> Column:
    """An arithmetic order key, the same in any engine."""
    return (unit * 7919 + seed * 104729 + (unit * unit) % 7907 * seed) % 1000003


def permuted(units: DataFrame, seeds: int, by: list[str] = ["recording_id"]) -> DataFrame:
    """(by..., seed, unit_id, other): for each seed every unit with the unit that takes its place.

    The places in the order of the ids are the same for all seeds, so they are told once.
    """
    own = units.select(*by, "unit_id")
    plain = places(own, by, F.col("unit_id"), ["unit_id"], "_k").drop("_k_all")
    mixed = own.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    mixed = mixed.withColumn("_key", shuffle_key(F.col("unit_id"), F.col("seed")))
    mixed = mixed.select(*by, "seed", F.col("unit_id").alias("other"), F.row_number().over(Window.partitionBy(*by, "seed").orderBy("_key", "unit_id")).cast("long").alias("_k"))
    return mixed.join(plain.hint("merge"), [*by, "_k"]).select(*by, "seed", "unit_id", "other")


def shuffled_between_edges(arrays: DataFrame, positions: DataFrame, edges: DataFrame, seeds: int, block: int | None = None) -> DataFrame:
    """As ``shuffled_curve``, on each recording's own edges."""
    return shuffled_curve(arrays.join(_edges_of(edges), "recording_id"), positions, None, seeds, block)


def shuffled_curve(arrays: DataFrame, positions: DataFrame, step: float | None, seeds: int, block: int | None = None) -> DataFrame:
    """(recording_id, bin, null_mean, null_sem): correlation by distance with positions permuted.

    The correlations of two blocks are computed once; each unit carries its place under every seed.
    """
    moved = permuted(positions, seeds).join(positions.select("recording_id", F.col("unit_id").alias("other"), "x", "y").hint("merge"), ["recording_id", "other"])
    given = moved.groupBy("recording_id", "unit_id").agg(F.sort_array(F.collect_list(F.struct("seed", "x", "y"))).alias("p"))
    units = arrays.join(given.select("recording_id", "unit_id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys")), ["recording_id", "unit_id"])
    more = ["edges"] if step is None else []
    per_seed = _distance_sums(units.select("recording_id", "unit_id", "trace", "xs", "ys", *more), step, None, block).withColumn("r", F.col("total") / F.col("n"))
    return per_seed.groupBy("recording_id", "bin").agg(F.avg("r").alias("null_mean"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("null_sem"))


def random_subsets(units: DataFrame, band: DataFrame, seeds: int) -> DataFrame:
    """(recording_id, seed, unit_id, other): for each seed other units, as many as the band (recording_id, unit_id) has, drawn from the whole recording without replacement, one for each of the band's units.

    The units of least ``shuffle_key`` are drawn. Each task passes on only the first of its own.
    """
    own = places(band.select("recording_id", "unit_id"), ["recording_id"], F.col("unit_id"), ["unit_id"], "_k").withColumnRenamed("_k_all", "_n")
    size = own.groupBy("recording_id").agg(F.max("_n").alias("_n"))
    drawn = _beside_recordings(units.select("recording_id", "unit_id"), size).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    drawn = drawn.withColumn("_key", shuffle_key(F.col("unit_id"), F.col("seed"))).withColumn("salt", F.pmod(F.xxhash64("unit_id"), F.lit(16)))
    for by in (["recording_id", "seed", "salt"], ["recording_id", "seed"]):
        drawn = drawn.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "unit_id")).cast("long")).filter(F.col("_k") <= F.col("_n"))
    drawn = drawn.select("recording_id", "seed", F.col("unit_id").alias("other"), "_k")
    return drawn.join(own.select("recording_id", "unit_id", "_k").hint("merge"), ["recording_id", "_k"]).select("recording_id", "seed", "unit_id", "other")


def random_subset_curve(arrays: DataFrame, positions: DataFrame, band: DataFrame, step: float, seeds: int, split: float | None = None, block: int | None = None) -> DataFrame:
    """(recording_id, bin, null_mean, null_sem): correlation by distance with random units of the recording at the places of the band's units.

    A unit carries the place that each seed gives it, if any, so the correlations of two blocks serve all seeds.
    With ``split`` pairs count within a side of it on y, and a seed's curve is the mean of its sides.
    """
    placed = random_subsets(positions, band, seeds).join(positions.select("recording_id", "unit_id", "x", "y").hint("merge"), ["recording_id", "unit_id"])
    given = placed.groupBy("recording_id", F.col("other").alias("unit_id")).agg(F.map_from_entries(F.collect_list(F.struct("seed", F.struct("x", "y")))).alias("p"))
    at = lambda c: F.transform(F.sequence(F.lit(1), F.lit(seeds)), lambda i: F.try_element_at("p", i)[c])
    units = arrays.join(given, ["recording_id", "unit_id"]).select("recording_id", "unit_id", "trace", at("x").alias("xs"), at("y").alias("ys"))
    sums = _distance_sums(units, step, split, block)
    per_seed = sums.groupBy("recording_id", "seed", "bin").agg(F.avg(F.col("total") / F.col("n")).alias("r"))
    return per_seed.groupBy("recording_id", "bin").agg(F.avg("r").alias("null_mean"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("null_sem"))


def curve_summaries(curves: DataFrame, by: list[str], x: str, value: str, near: tuple[float, float], whole: tuple[float, float]) -> DataFrame:
    """(by..., near_mean, all_mean, auc): means of a curve over two ranges of x, and its area over the second (two places at least)."""
    known = curves.filter(F.col(value).isNotNull())
    mean = lambda r: F.avg(F.when(F.col(x).between(*r), F.col(value)))
    means = known.groupBy(*by).agg(mean(near).alias("near_mean"), mean(whole).alias("all_mean"), F.count(F.when(F.col(x).between(*whole), 1)).alias("_n"))
    area = trapz(known.filter(F.col(x).between(*whole)), by, x, value, "auc")
    return means.join(area, by, "left").select(*by, "near_mean", "all_mean", F.when(F.col("_n") >= 2, F.col("auc")).alias("auc"))


def curve_difference(a: DataFrame, b: DataFrame, by: list[str], x: str, value: str, first: int = 5) -> DataFrame:
    """(by..., auc, near): area under the difference of two curves on common places, and its mean over the first of them."""
    both = a.select(*by, x, F.col(value).alias("_a")).join(b.select(*by, x, F.col(value).alias("_b")), [*by, x]).filter("_a is not null and _b is not null").withColumn("_d", F.col("_a") - F.col("_b"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(x))
    near = both.withColumn("_k", rank).groupBy(*by).agg(F.avg(F.when(F.col("_k") <= first, F.col("_d"))).alias("near"))
    return trapz(both, by, x, "_d", "auc").join(near, by)


def curve_regrid(curves: DataFrame, key: str, x: str, value: str) -> DataFrame:
    """(key, x, value): every curve on the places of the first one (smallest key), linear between its own and extended beyond."""
    known = curves.filter(F.col(value).isNotNull()).select(F.col(key), F.col(x).cast("double").alias("t"), F.col(value).alias("value"))
    # the places of one curve are one array, which each curve unfolds
    places = known.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("_places")).agg(F.min_by("_places", key).alias("_places"))
    clock = known.select(key).distinct().join(F.broadcast(places), F.lit(True)).select(key, F.explode("_places").alias("t"))
    return interpolate_to(known, clock, [key], "extend").select(key, F.col("t").alias(x), F.col("value").alias(value))


def common_prefix(curves: DataFrame, key: str, x: str, value: str, most: float) -> DataFrame:
    """Rows up to the last place that every curve still reaches, and not beyond ``most``."""
    last = curves.filter(F.col(value).isNotNull()).groupBy(key).agg(F.max(x).alias("_l")).agg(F.min("_l").alias("_last"))
    return curves.crossJoin(F.broadcast(last)).filter((F.col(x) <= F.col("_last")) & (F.col(x) <= most)).drop("_last")


def spatial_gradient(units: DataFrame, axis: str, order: str, by: list[str] = ["recording_id"]) -> DataFrame:
    """(by..., rho, slope): Spearman correlation and slope of the position along an axis against an order."""
    ranked = mean_rank(mean_rank(units, by, axis, "_ra"), by, order, "_ro")
    return ranked.groupBy(*by).agg(corr("_ra", "_ro").alias("rho"), F.regr_slope(axis, order).alias("slope"))


def permutation_test(units: DataFrame, axes: list[str], order: str, seeds: int, plus_one: bool = False) -> DataFrame:
    """(recording_id, axis, rho, p): share of permuted orders whose absolute Spearman correlation reaches the observed one.

    Ranks of a recording's units fit one row; the permutations are dealt to tasks in groups of seeds, which
    order the units by ``shuffle_key`` and correlate all axes at once.
    """
    ranked = units.filter(F.col(order).isNotNull())
    ranked = mean_rank(ranked, ["recording_id"], order, "_ro")
    for i, axis in enumerate(axes):
        ranked = mean_rank(ranked, ["recording_id"], axis, f"_r{i}")
    lists = ranked.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct(F.col("unit_id").cast("long").alias("u"), "_ro", *[f"_r{i}" for i in range(len(axes))]))).alias("s"))
    group = 64
    starts = F.explode(F.sequence(F.lit(1), F.lit(seeds), F.lit(group))).alias("first")
    rows = lists.select("recording_id", starts, F.col("s.u").alias("u"), F.col("s._ro").alias("ro"), *[F.col(f"s._r{i}").alias(f"r{i}") for i in range(len(axes))])
    rows = rows.repartition("recording_id", "first")
    kind = dict(units.dtypes)["recording_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                rec, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                u = batch.column(2)[i].values.to_numpy().astype(np.int64)
                ro, *ranks = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(3, batch.num_columns))
                for axis, ra in enumerate(ranks):
                    known = np.isfinite(ra)
                    a = np.where(known, ra - ra[known].mean() if known.any() else 0.0, 0.0)

                    def corr(o):
                        o = np.where(known, o - (o[known].mean() if known.any() else 0.0), 0.0)
                        scale = np.sqrt((a @ a) * (o @ o))
                        return a @ o / scale if scale > 0 else np.nan

                    seen = corr(ro)
                    hits = n = 0
                    for seed in range(first, min(first + group, seeds + 1)):
                        key = (u * 7919 + seed * 104729 + (u * u) % 7907 * seed) % 1000003
                        r = corr(ro[np.lexsort((u, key))])
                        hits, n = hits + int(abs(r) >= abs(seen) - 1e-12), n + 1
                    out.append((rec, axes[axis], None if seen != seen else float(seen), hits, n))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = (batch.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["recording_id", "axis", "rho", "hits", "n"])

    found = rows.mapInArrow(run, f"recording_id {kind}, axis string, rho double, hits long, n long")
    hit, n = F.sum("hits"), F.sum("n")
    p = (hit + 1) / (n + 1) if plus_one else hit / n
    return found.groupBy("recording_id", "axis").agg(F.first("rho").alias("rho"), F.when(F.first("rho").isNotNull(), p).alias("p"))


def kde_grid(points: DataFrame, nx: int, ny: int, hx: float, hy: float) -> DataFrame:
    """(recording_id, gi, gj, gx, gy, density): Gaussian density of (recording_id, x, y) on an even grid over each recording's range, its largest value 1.

    The kernel is a product over the axes, so a task's points meet the grid in one matrix product.
    """
    known = points.filter("x is not null and y is not null").select("recording_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    span = known.groupBy("recording_id").agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))], F.count(F.lit(1)).alias("n"))
    if span.count() <= BROADCAST_RECORDINGS:
        span = F.broadcast(span)
    rows = known.join(span, "recording_id").select("recording_id", "x", "y", "x0", "x1", "y0", "y1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            recs = np.array(batch.column(0).to_pylist())
            x, y, x0, x1, y0, y1 = (batch.column(i).to_numpy() for i in range(1, 7))
            for rec in np.unique(recs).tolist():
                own = recs == rec
                gx, gy = np.linspace(x0[own][0], x1[own][0], nx), np.linspace(y0[own][0], y1[own][0], ny)
                kx = np.exp(-0.5 * ((gx[:, None] - x[own][None]) / hx) ** 2)
                ky = np.exp(-0.5 * ((gy[:, None] - y[own][None]) / hy) ** 2)
                total[rec] = total.get(rec, 0.0) + kx @ ky.T
        if total:
            sums = pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), kind), sums], names=["recording_id", "sums"])

    part = rows.mapInArrow(run, f"recording_id {dict(points.dtypes)['recording_id']}, sums array<double>")
    cells = part.select("recording_id", F.posexplode("sums").alias("c", "s")).groupBy("recording_id", "c").agg(F.sum("s").alias("s")).join(span, "recording_id")
    gi, gj = F.floor(F.col("c") / ny).cast("int"), (F.col("c") % ny).cast("int")
    place = lambda low, high, i, n: F.col(low) + i * (F.col(high) - F.col(low)) / max(n - 1, 1)
    top = F.max("s").over(Window.partitionBy("recording_id"))
    return cells.select("recording_id", gi.alias("gi"), gj.alias("gj"), place("x0", "x1", gi, nx).alias("gx"), place("y0", "y1", gj, ny).alias("gy"), (F.col("s") / top).alias("density"))


def kde_bandwidth(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by..., bw): 1.06 times the smaller spread estimate IQR / 1.349 (the sd where that is 0) times n to the -1/5."""
    spread = df.groupBy(*by).agg(F.stddev_samp(col).alias("_sd"), F.count(col).alias("_n"))
    both = spread.join(iqr(df, by, col), by)
    s = F.when(F.col("iqr") > 0, F.col("iqr") / 1.349).otherwise(F.col("_sd"))
    return both.select(*by, (1.06 * s * F.pow(F.col("_n").cast("double"), -0.2)).alias("bw"))


def kde_at_points(units: DataFrame, col: str) -> DataFrame:
    """(recording_id, unit_id, density): one-dimensional Gaussian density at the units' own values.

    The values of a recording are one array, which each group of its points is compared with.
    """
    known = units.filter(F.col(col).isNotNull()).select("recording_id", "unit_id", F.col(col).cast("double").alias("v"))
    values = known.groupBy("recording_id").agg(F.collect_list("v").alias("all")).join(kde_bandwidth(known, ["recording_id"], "v"), "recording_id")
    groups = dealt(known, 4096).groupBy("recording_id", "blk").agg(F.collect_list(F.struct("unit_id", "v")).alias("p"))
    rows = groups.join(values, "recording_id").select("recording_id", F.col("p.unit_id").alias("ids"), F.col("p.v").alias("at"), "all", "bw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, at, values, bw = (batch.column(c)[i] for c in range(1, 5))
                v, h = values.values.to_numpy(), bw.as_py()
                if not h:
                    density = [None] * len(ids)
                else:
                    density = [float(np.exp(-0.5 * ((x - v) / h) ** 2).mean() / (h * (2 * np.pi) ** 0.5)) for x in at.values.to_pylist()]
                rec = pa.array([batch.column(0)[i].as_py()] * len(density), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([rec, ids.values, pa.array(density, pa.float64())], names=["recording_id", "unit_id", "density"])

    kinds = dict(units.dtypes)
    return rows.mapInArrow(run, f"recording_id {kinds['recording_id']}, unit_id {kinds['unit_id']}, density double")


def spectrum_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """(recording_id, units, mse, ssim): two periods' spectra (recording_id, unit_id, f, pxx) on common units, two at least; SSIM over the whole picture."""
    both = a.join(b.withColumnRenamed("pxx", "pyy"), ["recording_id", "unit_id", "f"])
    x, y = F.col("pxx"), F.col("pyy")
    s = both.groupBy("recording_id").agg(
        F.count_distinct("unit_id").alias("units"), F.avg((x - y) ** 2).alias("mse"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"), (F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))).alias("range"),
    ).filter("units >= 2")
    c1, c2 = (0.01 * F.col("range")) ** 2, (0.03 * F.col("range")) ** 2
    ssim = (2 * F.col("mx") * F.col("my") + c1) * (2 * F.col("cxy") + c2) / ((F.col("mx") ** 2 + F.col("my") ** 2 + c1) * (F.col("vx") + F.col("vy") + c2))
    return s.select("recording_id", "units", "mse", ssim.alias("ssim"))
