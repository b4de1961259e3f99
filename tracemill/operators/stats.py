"""Rank tests, corrections and mixed models over group tables.

Statistics come from ranks in two levels and sums; only the last step, from a statistic to a p value,
is a vectorised function over one row per test.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..sources.staging import staged
from .aggregates import corr
from .ranks import group_median, mean_rank, value_counts, value_ranks
from .windows import rank_within


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


def _exact_signrank(w: float, n: int) -> float:
    """Exact two-sided p of a signed-rank sum without ties; the count of subsets per sum by dynamic programming."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    w = min(w, n * (n + 1) / 2 - w)
    return min(1.0, 2 * ways[: int(math.floor(w)) + 1].sum() / 2.0**n)


@pandas_udf(DoubleType())
def signrank_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    """p of a signed-rank sum: exact for up to 15 pairs without ties, else normal with tie correction."""
    def one(w, n, ties):
        if n is None or n != n or n < 1:
            return None
        n = int(n)
        if n <= 15 and ties == 0:
            return _exact_signrank(w, n)
        var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
        z = w - n * (n + 1) / 4
        return math.erfc(abs(z) / math.sqrt(2 * var)) if var > 0 else 1.0

    return pd.Series([one(*x) for x in zip(w, n, ties)])


def signrank(pairs: DataFrame, by: list[str], a: str, b: str | None = None, p: bool = True, small: bool = False) -> DataFrame:
    """(by..., n, w, ties, median[, p]): Wilcoxon signed-rank test of complete pairs (or of one sample against 0), two pairs at least.

    ``small`` tells that groups are few rows by design (a unit's trials); else ranks run in two levels.
    """
    d = F.col(a) - F.col(b) if b else F.col(a)
    known = pairs.select(*by, d.cast("double").alias("_d")).filter(F.col("_d").isNotNull() & ~F.isnan("_d"))
    if small:
        med = known.groupBy(*by).agg(F.median("_d").alias("median"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
        told = rank_within(known.filter("_d <> 0").withColumn("_abs", F.abs("_d")), by, "_abs").withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*by, "_abs")))
        s = told.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("rank"))), F.lit(0.0)).alias("w"), F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("ties"))
        out = med.join(s, by, "left")
        return out.withColumn("p", signrank_p("w", F.col("n").cast("double"), "ties")) if p else out
    med = group_median(known, by, "_d").filter("n >= 2").drop("n")
    counts = value_counts(known.filter("_d <> 0").withColumn("_abs", F.abs("_d")), by, "_abs", up=F.col("_d") > 0)
    t = F.col("n").cast("double")
    s = value_ranks(counts, by, "_abs").groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(t * t * t - t).alias("ties"))
    out = med.join(s, by, "left") if by else med.crossJoin(s)
    return out.withColumn("p", signrank_p("w", F.col("n").cast("double"), "ties")) if p else out


def ranksum(values: DataFrame, by: list[str], group: str, first: str, col: str = "value", p: bool = True) -> DataFrame:
    """(by..., n1, n2, w, z[, p]): Wilcoxon rank-sum test of one group against the rest, normal with tie and continuity correction."""
    known = values.filter(F.col(col).isNotNull())
    one = F.col(group) == first
    t = F.col("n").cast("double")
    ranked = value_ranks(value_counts(known, by, col, one=one, other=~one), by, col)
    s = ranked.groupBy(*by).agg(F.sum("one").alias("n1"), F.sum("other").alias("n2"), F.when(F.sum("one") > 0, F.sum(F.col("rank") * F.col("one"))).alias("w"), F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n1") + F.col("n2")
    gap = F.col("w") - F.col("n1") * (n + 1) / 2
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    out = s.withColumn("z", F.when(var > 0, (gap - 0.5 * F.signum(gap)) / F.sqrt(var))).drop("_ties")
    return out.withColumn("p", normal_two_sided("z")) if p else out


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


@pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else _gamma_q(k / 2, v / 2) for v, k in zip(x, df)])


@pandas_udf(DoubleType())
def corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs by Student's t."""
    def one(r, n):
        if r is None or r != r or n < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        t2 = r * r * (n - 2) / (1 - r * r)
        return _beta_i((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))

    return pd.Series([one(*x) for x in zip(r, n)])


def friedman(df: DataFrame, subject: str, cond: str, col: str, k: int, p: bool = True) -> DataFrame:
    """(n, chi2[, p]): Friedman test over subjects with all k conditions, corrected for ties."""
    full = df.filter(F.col(col).isNotNull()).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(subject))).filter(F.col("_k") == k)
    ranked = rank_within(full, [subject], col, "_r")  # k rows
    sums = ranked.groupBy(cond).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_r") * F.col("_r")).alias("_q"))
    t = sums.agg(F.sum(F.col("_s") * F.col("_s")).alias("ss"), F.max("_n").alias("n"), F.sum("_q").alias("q"))
    n, mean = F.col("n"), (k + 1) / 2
    top = (k - 1) * (F.col("ss") / n - n * k * mean * mean)
    spread = F.col("q") / n - k * mean * mean  # of the ranks within a subject, ties included
    out = t.select("n", F.when(spread > 0, top / spread).alias("chi2"))
    return out.withColumn("p", chi2_p("chi2", F.lit(float(k - 1)))) if p else out


def holm(tests: DataFrame, by: list[str], p: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p values within each family."""
    w = Window.partitionBy(*by).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*by))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    return tests.withColumn("_s", step).withColumn(out, F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def fdr_mask(tests: DataFrame, by: list[str], p: str, alpha: float = 0.05, method: str = "fdr") -> DataFrame:
    """Adds ``significant`` within each family: step-up (fdr), bonferroni, or none.

    The step-up limit of place i is i * alpha / m, with i * alpha rounded once: as decimals multiply, 3 * 0.05 is 0.15.
    """
    whole = Window.partitionBy(*by)
    m = F.count(p).over(whole)
    if method == "none":
        return tests.withColumn("significant", F.col(p) <= alpha)
    if method == "bonferroni":
        return tests.withColumn("_m", m).withColumn("significant", F.col(p) <= alpha / F.col("_m")).drop("_m")
    ranked = tests.withColumn("_i", F.row_number().over(whole.orderBy(F.col(p).asc_nulls_last()))).withColumn("_m", m)
    part = Fraction(str(alpha))
    limit = F.col("_i") * float(part.numerator) / float(part.denominator) / F.col("_m")
    last = F.max(F.when(F.col(p) <= limit, F.col("_i"))).over(whole)
    return ranked.withColumn("_k", last).withColumn("significant", F.coalesce(F.col("_i") <= F.col("_k"), F.lit(False))).drop("_i", "_m", "_k")


@pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of a 2 x 2 table."""
    def one(a, b, c, d):
        a, b, c, d = int(a), int(b), int(c), int(d)
        lf = lambda n: math.lgamma(n + 1)
        fixed = lf(a + b) + lf(c + d) + lf(a + c) + lf(b + d) - lf(a + b + c + d)
        prob = lambda x: fixed - lf(x) - lf(a + b - x) - lf(a + c - x) - lf(d - a + x)
        seen = prob(a)
        return min(1.0, sum(math.exp(q) for x in range(max(0, a - d), min(a + b, a + c) + 1) if (q := prob(x)) <= seen + 1e-7))

    return pd.Series([one(*x) for x in zip(a, b, c, d)])


def fisher_table(df: DataFrame, by: list[str], row: Column, col: Column) -> DataFrame:
    """(by..., a, b, c, d, p): counts of two conditions and the test of their independence."""
    n = lambda r, c: F.count(F.when(r & c, 1))
    t = df.groupBy(*by).agg(n(row, col).alias("a"), n(row, ~col).alias("b"), n(~row, col).alias("c"), n(~row, ~col).alias("d"))
    return t.withColumn("p", fisher_p("a", "b", "c", "d"))


def correlation(df: DataFrame, by: list[str], x: str, y: str, spearman: bool = False, p: bool = True) -> DataFrame:
    """(by..., r, n[, p]) over complete pairs."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if spearman:
        known = mean_rank(mean_rank(known, by, x, "_x"), by, y, "_y")
        x, y = "_x", "_y"
    out = known.groupBy(*by).agg(corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("p", corr_p("r", "n")) if p else out


#: Logarithms of the variance ratio that a pass tries on each side of the best so far, the first step between them, and passes.
_SIDE, _STEP, _PASSES = 6, 1.5, 6


def _profile(tried: DataFrame, keys: list[str]) -> DataFrame:
    """Fits per (keys..., slope, t), the logarithm of the variance ratio, from the sums of the subjects; null where there is none.

    Weighted sums over subjects: within a subject of n rows, the mean counts n / (1 + n ratio).
    """
    ratio = F.exp("t")
    pull = ratio / (1 + F.col("n") * ratio)
    full = {"nn": "n", "nx": "x", "ny": "y"}
    sums = [F.sum(F.col(full.get(k, k)) - pull * F.col(k[0]) * F.col(k[1])).alias(f"s_{k}") for k in ("nn", "nx", "ny", "xx", "xy", "yy")]
    rows = tried.groupBy(*keys, "slope", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("subjects"), F.sum(F.log1p(F.col("n") * ratio)).alias("ld"), *sums)
    det = F.expr("s_nn * s_xx - s_nx * s_nx")
    some = F.when(det > 1e-12 * F.col("s_nn") * F.col("s_xx"), det)
    rows = rows.withColumn("det", some).withColumn("b1", F.when(F.col("slope"), F.expr("(s_nn * s_xy - s_nx * s_ny) / det")).otherwise(0.0))
    rows = rows.withColumn("b0", F.expr("(s_ny - b1 * s_nx) / s_nn")).withColumn("var", F.expr("(s_yy - b0 * s_ny - b1 * s_xy) / n"))
    rows = rows.withColumn("ll", F.when(F.col("var") > 0, -0.5 * (F.col("n") * F.log(2 * math.pi * F.col("var")) + F.col("ld") + F.col("n"))))
    return rows.select(*keys, "slope", "t", "n", "subjects", "b0", "b1", F.expr("sqrt(s_nn / det * var)").alias("se"), "ll")


def random_intercept(df: DataFrame, by: list[str], subject: str, x: str, y: str, p: bool = True) -> DataFrame:
    """(by..., n, subjects, b0, b1, se, z, ratio, ll, lr[, p, lr_p]): maximum likelihood fit of y = b0 + b1 x + subject + error in each group.

    ``ratio`` is the subjects' variance over the error's, z and p test b1 by its standard error, lr and
    lr_p by the likelihood without it. The data shrink to six sums per subject. Each pass tries thirteen
    ratios of every group at once and the next looks closer around the best, so all groups are fitted
    together and nothing but tables of groups goes from pass to pass.

    Rows with a null in x, y, the subject or a key are left out. A group without spread in x
    has null results; where the line meets every row, its likelihood is that of rounding errors. An empty table gives no rows.
    """
    known = df.dropna(subset=[*by, subject, x, y]).select(*by, F.col(subject).alias("_subject"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_all"))
    keys = [*by, "_all"]
    sums = known.groupBy(*keys, "_subject").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_x").alias("x"), F.sum("_y").alias("y"), F.sum(F.expr("_x * _x")).alias("xx"), F.sum(F.expr("_x * _y")).alias("xy"), F.sum(F.expr("_y * _y")).alias("yy"))
    sums = staged(df.sparkSession, sums, "subject-sums")
    around = lambda t, step: F.transform(F.sequence(F.lit(-_SIDE), F.lit(_SIDE)), lambda i: t + i * step)
    tried = sums.withColumn("slope", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("t", F.explode(around(F.lit(-3.0), _STEP)))
    for i in range(_PASSES):
        fits = _profile(tried, keys)
        # nearly equal likelihoods count as ties, the smaller ratio wins
        order = F.when(F.col("ll").isNotNull(), F.struct(F.round("ll", 8), -F.col("t")))
        best = fits.groupBy(*keys, "slope").agg(F.max("n").alias("n"), F.max("subjects").alias("subjects"), F.max_by(F.struct("t", "b0", "b1", "se", "ll"), order).alias("fit"))
        best = staged(df.sparkSession, best, "mixed-fits")
        tried = sums.join(best.select(*keys, "slope", F.col("fit.t").alias("_t")), keys).withColumn("t", F.explode(around(F.coalesce("_t", F.lit(-3.0)), _STEP / _SIDE ** (i + 1)))).drop("_t")
    with_slope = lambda c: F.max(F.when(F.col("slope"), F.col(f"fit.{c}"))).alias(c)
    out = best.groupBy(*keys).agg(F.max("n").alias("n"), F.max("subjects").alias("subjects"), *map(with_slope, ("b0", "b1", "se", "t", "ll")), F.max(F.when(~F.col("slope"), F.col("fit.ll"))).alias("ll0"))
    z = F.when(F.col("se") > 0, F.col("b1") / F.col("se")).alias("z")
    out = out.select(*by, "n", "subjects", "b0", "b1", "se", z, F.exp("t").alias("ratio"), "ll", F.when(F.col("ll").isNotNull(), F.greatest(F.lit(0.0), 2 * (F.col("ll") - F.col("ll0")))).alias("lr"))
    return out.withColumn("p", normal_two_sided("z")).withColumn("lr_p", normal_two_sided(F.sqrt("lr"))) if p else out


def p_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "n.s.")


def surrogate_scores(observed: DataFrame, surrogates: DataFrame, lower_is_better: list[str], share: float = 0.95) -> DataFrame:
    """(recording_id, kind, metric, z, passed): metrics against their surrogates; for some metrics smaller values count."""
    from .aggregates import hazen

    key = ["recording_id", "kind", "metric"]
    m = surrogates.groupBy(*key).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    q = hazen(surrogates, key, [1 - share, share])
    q = q.groupBy(*key).agg(F.min("q").alias("_lo"), F.max("q").alias("_hi"))
    low = F.col("metric").isin(lower_is_better)
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s"))
    both = observed.join(m, ["recording_id", "metric"]).join(q, key)
    return both.select(*key, F.when(low, -z).otherwise(z).alias("z"), F.when(low, F.col("value") < F.col("_lo")).otherwise(F.col("value") > F.col("_hi")).alias("passed"))


#: Classes of a recording's rhythm: fixed values.
OSCILLATOR, QUASI, NOISE = "Oscillator-like", "Quasi-oscillatory / structured rhythmic dynamics", "Structured slow noise / weak rhythmic structure"
#: Metrics that make up the score, smaller values being better for the last two.
SCORED = ("peak_power", "q", "acf_prominence", "window_cv", "inst_cv")


def oscillator_class(score: Column, passes: Column) -> Column:
    return F.when((passes >= 8) & (score > 1.5), OSCILLATOR).when((passes >= 4) & (score > 0.5), QUASI).otherwise(NOISE)


def paired_summary(df: DataFrame, key: str, cond: str, col: str, conditions: list[str], p: bool = True) -> DataFrame:
    """(cond, n, q25, q50, q75, test): quartiles per condition, and the test of the conditions in words.

    Two conditions are compared by the signed-rank test of complete pairs, three by the Friedman test of complete subjects.
    """
    from .aggregates import hazen

    known = df.filter(F.col(cond).isin(*conditions) & F.col(col).isNotNull())
    q = hazen(known, [cond], [0.25, 0.5, 0.75], col).groupBy(cond).agg(*[F.max(F.when(F.col("p") == x, F.col("q"))).alias(n) for x, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    n = known.groupBy(cond).agg(F.count(F.lit(1)).alias("n"))
    number = lambda c, digits: F.format_string(f"%.{digits}f", F.col(c).cast("double"))
    if len(conditions) == 2:
        a, b = (known.filter(F.col(cond) == c).select(key, F.col(col).alias(f"_{i}")) for i, c in enumerate(conditions))
        t = signrank(a.join(b, key), [], "_0", "_1", p)
        told = F.concat(F.lit("signed rank w="), number("w", 1), *([F.lit(" p="), number("p", 4)] if p else []))
    else:
        t = friedman(known, key, cond, col, len(conditions), p)
        told = F.concat(F.lit("friedman chi2="), number("chi2", 3), *([F.lit(" p="), number("p", 4)] if p else []))
    return q.join(n, cond).crossJoin(F.broadcast(t.select(told.alias("test")))).select(F.col(cond).alias("cond"), "n", "q25", "q50", "q75", "test")
