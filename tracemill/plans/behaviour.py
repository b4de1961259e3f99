"""Behaviour by condition: metrics per subject and condition, then tests across conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats


def condition_tests(metrics: DataFrame, conditions: list[str], col: str, p: bool = True) -> DataFrame:
    """(a, b, n, w, ties, median[, p, p_holm]): sign-rank tests of all pairs of conditions, corrected together."""
    parts = []
    for i, a in enumerate(conditions):
        for b in conditions[i + 1 :]:
            side = lambda c, name: metrics.filter(F.col("cond") == c).select("subject_id", F.col(col).alias(name))
            both = side(a, "x").join(side(b, "y"), "subject_id").withColumn("a", F.lit(a)).withColumn("b", F.lit(b))
            parts.append(both)
    tests = stats.signrank(reduce(DataFrame.unionByName, parts), ["a", "b"], "x", "y", p)
    return stats.holm(tests.withColumn("_f", F.lit(1)), ["_f"], "p").drop("_f") if p else tests
