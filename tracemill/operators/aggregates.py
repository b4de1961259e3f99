"""Group statistics whose definitions differ from Spark's defaults, and pooled curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import clip


def summary(df: DataFrame, by: list[str], col: str = "value") -> DataFrame:
    """n, mean, median, sd (n - 1) and standard error, without missing values."""
    sd = F.stddev_samp(col)
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.median(col).alias("median"), sd.alias("sd"), (sd / F.sqrt(F.count(col))).alias("sem"))


def corr(x: str, y: str) -> Column:
    """Correlation of the rows where both have values; NaN without spread in one of them, NULL without such rows.

    Spark's own divides by zero where a column does not vary.
    """
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread)).when(spread.isNotNull(), F.lit(float("nan")))


def mad(df: DataFrame, by: list[str], col: str = "value") -> DataFrame:
    """Unscaled median absolute deviation."""
    med = df.groupBy(*by).agg(F.median(col).alias("median"))
    return df.join(med, by).groupBy(*by).agg(F.median(F.abs(F.col(col) - F.col("median"))).alias("mad"))


def hazen(df: DataFrame, by: list[str], probs: list[float], col: str = "value") -> DataFrame:
    """(by..., p, q): percentiles at plotting positions (i - 0.5) / n with linear interpolation, clamped at the ends."""
    known = df.filter(F.col(col).isNotNull())
    w = Window.partitionBy(*by).orderBy(col)
    rows = known.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(col).over(Window.partitionBy(*by))).withColumn("_next", F.lead(col).over(w))
    p = F.explode(F.array(*[F.lit(float(x)) for x in probs]))
    at = rows.select(*by, col, "_i", "_n", "_next", p.alias("p")).withColumn("_x", F.least(F.greatest(F.col("p") * F.col("_n") + 0.5, F.lit(1.0)), F.col("_n").cast("double")))
    hit = at.filter(F.floor("_x") == F.col("_i"))
    part = F.col("_x") - F.col("_i")
    return hit.select(*by, "p", (F.col(col) + F.coalesce(part * (F.col("_next") - F.col(col)), F.lit(0.0))).alias("q"))


def iqr(df: DataFrame, by: list[str], col: str = "value") -> DataFrame:
    return hazen(df, by, [0.25, 0.75], col).groupBy(*by).agg((F.max("q") - F.min("q")).alias("iqr"))


def bin_of(value: Column, low: float, width: float, bins: int) -> Column:
    """Bin 0 to bins - 1 of equal width, the last closed on the right; NULL outside."""
    k = F.floor((value - low) / width)
    return F.when((value >= low) & (value <= low + width * bins), F.least(k, F.lit(bins - 1))).cast("int")


def histogram_pct(df: DataFrame, by: list[str], low: float, width: float, bins: int, col: str = "value") -> DataFrame:
    """(by..., bin, n, pct) per group and, with NULL for the group, pooled; shares of the values in range."""
    binned = df.select(*by, bin_of(F.col(col), low, width, bins).alias("bin")).filter("bin is not null")
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    pooled = counts.groupBy("bin").agg(F.sum("n").alias("n")).select(*[F.lit(None).cast(dict(counts.dtypes)[c]).alias(c) for c in by], "bin", "n")
    both = counts.unionByName(pooled)
    return both.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def binned_median(df: DataFrame, by: list[str], x: str, y: str, low: float, width: float, bins: int) -> DataFrame:
    """(by..., bin, median): a row for every bin of every group, NULL where it is empty."""
    found = df.withColumn("bin", bin_of(F.col(x), low, width, bins)).filter("bin is not null").groupBy(*by, "bin").agg(F.median(y).alias("median"))
    grid = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(found, [*by, "bin"], "left")


def weighted_mean_curve(curves: DataFrame, x: str, value: str, pairs: str, least_pairs: int = 200, least_curves: int = 8) -> DataFrame:
    """Mean curve weighted by pair counts with its standard error, and the plain mean; the first is NULL where too little is behind it."""
    known = curves.filter(F.col(value).isNotNull())
    w = Window.partitionBy(x)
    share = known.withColumn("_w", F.col(pairs) / F.sum(pairs).over(w)).withColumn("_m", F.sum(F.col("_w") * F.col(value)).over(w))
    enough = (F.sum(pairs) >= least_pairs) & (F.count(F.lit(1)) >= least_curves)
    sem = F.sqrt(F.sum(F.col("_w") ** 2 * (F.col(value) - F.col("_m")) ** 2))
    return share.groupBy(x).agg(F.sum(pairs).alias("pairs"), F.count(F.lit(1)).alias("curves"), F.when(enough, F.first("_m")).alias("weighted"), F.when(enough, sem).alias("weighted_sem"), F.avg(value).alias("plain"))


def mean_curve(df: DataFrame, x: list[str], col: str = "value") -> DataFrame:
    """Mean and standard error per place on the curve."""
    return df.groupBy(*x).agg(F.avg(col).alias("mean"), (F.stddev_samp(col) / F.sqrt(F.count(col))).alias("sem"), F.count(col).alias("n"))


def stack_grids(grids: DataFrame) -> DataFrame:
    """Mean and median of density grids (subject, period, gi, gj, density) over subjects, and the change from period 0."""
    cells = grids.groupBy("period", "gi", "gj").agg(F.avg("density").alias("mean"), F.median("density").alias("median"))
    first = cells.filter("period = 0").select("gi", "gj", F.col("mean").alias("_first"))
    return cells.join(first, ["gi", "gj"], "left").withColumn("change", F.col("mean") - F.col("_first")).drop("_first")


def trapz(df: DataFrame, by: list[str], x: str, y: str, out: str = "area") -> DataFrame:
    """Trapezoid integral over ordered x."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_part", part).groupBy(*by).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias(out))


def share_of(condition: Column) -> Column:
    """Share of rows where a condition holds; rows where it is unknown do not count."""
    return F.avg(condition.cast("double"))


def occupied(df: DataFrame, by: list[str], mode: str, n: str) -> DataFrame:
    """Number of modes with members."""
    return df.groupBy(*by).agg(F.count_distinct(F.when(F.col(n) > 0, F.col(mode))).alias("occupied"))


def population_mean(df: DataFrame) -> DataFrame:
    return df.groupBy("recording_id", "frame").agg(F.avg("value").alias("value"))


def by_condition(df: DataFrame, key: str, cond: str, value: str, conditions: list[str]) -> DataFrame:
    """One column per condition."""
    return df.groupBy(key).pivot(cond, conditions).agg(F.first(value))


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "scenario", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def fisher_z_mean(r: Column) -> Column:
    """tanh of the mean of atanh, with r held inside (-1, 1)."""
    return F.tanh(F.avg(F.atanh(clip(r, -0.999999, 0.999999))))


def resultant(phase: Column) -> Column:
    """Length of the mean unit vector of the phases."""
    return F.sqrt(F.pow(F.avg(F.cos(phase)), 2) + F.pow(F.avg(F.sin(phase)), 2))
