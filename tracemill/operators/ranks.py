"""Running sums, ranks and medians of large groups in two levels.

The values of a group are cut into ranges of about equal size. A range's total is one row, so sums
over the ranges before it are cheap; inside a range an ordinary window runs. No task orders more than
one range, however large the group. Ranks are taken over distinct values with their counts, which
tasks sum up before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Ranges that a group's values are cut into, and the accuracy of the cuts (they only balance the ranges).
RANGES, ACCURACY = 256, 10_000


def beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the table row of their keys; NULL keys match each other, no keys mean a table of one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(table))  # one row
    own = table.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *[c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return rows.join(own, same, "left").drop(*[f"_of_{c}" for c in keys])


def running(df: DataFrame, by: list[str], lead: Column, order: list, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Adds each of ``sums`` summed up to and with the row in the order of its group, and over the whole group as ``<name>_all``.

    ``lead`` is a number that never falls along ``order``; rows with equal leads share a range, NULL ones come last.
    """
    rows = staged(df.sparkSession, df.withColumn("_lead", lead.cast("double")), "running")
    cuts = rows.groupBy(*by).agg(F.percentile_approx("_lead", [i / ranges for i in range(1, ranges)], ACCURACY).alias("_cuts"))
    at = F.when(F.col("_lead").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("_lead")))).otherwise(ranges)
    rows = beside(rows, cuts, by).withColumn("_range", at).drop("_cuts", "_lead")
    parts = rows.groupBy(*by, "_range").agg(*[F.sum(e).alias(f"_{n}_part") for n, e in sums.items()])
    earlier, group = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    parts = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}_part").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in sums], *[F.sum(f"_{n}_part").over(group).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = beside(rows, parts, [*by, "_range"])
    return told.select(*df.columns, *[(F.col(f"_{n}_before") + F.sum(e).over(inside)).alias(n) for n, e in sums.items()], *[f"{n}_all" for n in sums])


def places(df: DataFrame, by: list[str], lead: Column, order: list, out: str = "place", ranges: int = RANGES) -> DataFrame:
    """Adds the place of each row (from 1) in the order of its group, and the group's size as ``<out>_all``."""
    return running(df, by, lead, order, {out: F.lit(1)}, ranges)


def value_counts(df: DataFrame, by: list[str], col: str, **counts: Column) -> DataFrame:
    """(by..., col, n, counts...): each distinct value of a group with its rows, and how many of them meet each condition."""
    return df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()])


def value_ranks(counts: DataFrame, by: list[str], col: str, ranges: int = RANGES) -> DataFrame:
    """Adds the mean rank of each distinct value of (by..., col, n)."""
    told = running(counts, by, F.col(col), [col], {"_upto": F.col("n")}, ranges)
    return told.withColumn("rank", F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0).drop("_upto", "_upto_all")


def mean_rank(df: DataFrame, by: list[str], col: str, out: str = "rank", ranges: int = RANGES) -> DataFrame:
    """Rank with mean ranks on ties; NULL values keep a NULL rank."""
    known = df.filter(F.col(col).isNotNull())
    ranks = value_ranks(value_counts(known, by, col), by, col, ranges).drop("n").withColumnRenamed("rank", "_rank")
    return beside(df, ranks, [*by, col]).withColumn(out, F.col("_rank")).drop("_rank")


def group_median(df: DataFrame, by: list[str], col: str, out: str = "median", ranges: int = RANGES) -> DataFrame:
    """(by..., out, n): exact median of each group's known values, and how many there are."""
    told = running(value_counts(df.filter(F.col(col).isNotNull()), by, col), by, F.col(col), [col], {"_upto": F.col("n")}, ranges)
    half = lambda up: F.min(F.when(F.col("_upto") >= F.floor((F.col("_upto_all") + up) / 2), F.col(col)))
    return told.groupBy(*by).agg(((half(1) + half(2)) / 2).alias(out), F.max("_upto_all").alias("n"))
