"""Exact dedup by skew-safe combining, in DataFrame operations only.

Each map task first collapses the equal texts it holds, the survivors meet in salted digest
groups, and the winners of the salts are combined once more. The whole normalised text is a
grouping key in each of these steps, so equality is always decided on content; the digest
only makes the keys cheap to tell apart. The fixed-width aggregation state (one number that
orders rows, one count) keeps all steps in hash aggregation with map-side combining: a group
that holds a third of all rows reaches the shuffle as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_or_empty

#: Characters that do not count for equality: blank, tab, line feed, vertical tab, form feed, carriage return.
IGNORED = " \t\n\x0b\x0c\r"
#: Salts per digest group: how many tasks may share the rows of one hot text.
SALTS = 8

_TWO_64 = "18446744073709551616BD"
_MAX_ID = "9223372036854775807BD"


def _preference(length: Column, doc_id: Column) -> Column:
    """A number that is larger for more code points, then for the smaller id; null ids come last."""
    rank = F.expr(_MAX_ID) - doc_id.cast("decimal(19,0)")
    tail = F.when(doc_id.isNull(), F.expr("0BD")).otherwise(rank + F.expr("1BD"))
    return (length.cast("decimal(12,0)") * F.expr(_TWO_64) * F.expr("2BD") + tail).cast("decimal(38,0)")


def _preferred_id(preference: Column) -> Column:
    tail = F.pmod(preference, (F.expr(_TWO_64) * F.expr("2BD")).cast("decimal(38,0)"))
    return F.when(tail > 0, F.expr(_MAX_ID) - (tail - F.expr("1BD"))).cast("long")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without the characters in ``IGNORED``. Of equal
    texts the row with the most code points stays, then the smallest id.

    Defined cases: a null text counts as empty, and all empty texts are one group. Rows that
    repeat an id share its verdict. A row with a null id stays only if its group has no
    other id among its longest rows; its ``keep_id`` is then null. Other columns of the input are ignored,
    whatever their names. An empty table gives an empty result.

    ``digest`` (a function of the normalised text column) is replaced in tests only, to force
    collisions: where one digest has several texts, rows find their group by content too.
    """
    spark = docs.sparkSession
    digest = digest or (lambda text: F.unhex(F.sha2(text, 256)))
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.translate(text, IGNORED, "").alias("norm"),
        F.length(text).alias("chars"),
    ).withColumn("digest", digest(F.col("norm")))
    local = rows.select(
        "digest",
        "norm",
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        _preference(F.col("chars"), F.col("doc_id")).alias("preference"),
    )
    salted = local.groupBy("digest", "norm", "salt").agg(
        F.max("preference").alias("preference"), F.count(F.lit(1)).alias("n")
    )
    winners = salted.groupBy("digest", "norm").agg(
        F.max("preference").alias("preference"), F.sum("n").alias("group_size")
    )
    chosen = winners.select("digest", _preferred_id(F.col("preference")).alias("keep_id"), "group_size")
    by, staged_winners = ["digest"], staged(spark, chosen, "dedup-winners")
    if staged_winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").limit(1).count():
        # two texts share a digest: rows find their winner by content
        by, chosen = ["digest", "norm"], winners.select("digest", "norm", _preferred_id(F.col("preference")).alias("keep_id"), "group_size")
        staged_winners = staged(spark, chosen, "dedup-winners-by-content")
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).select("doc_id", "text_sha256", *by)
    joined = rows.join(staged_winners, by)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
