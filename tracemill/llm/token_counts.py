"""Token counts through an exact histogram of encoded lengths.

Documents shrink to (length, how many) in the first aggregation; everything else is arithmetic
on that histogram. Suffix sums over it answer, for every context limit, how many documents are
longer, how many tokens there are in all, how many remain when each document is cut to the
limit, and any quantile. The sums run in two levels, over ranges of lengths and inside each
range, so that no single task sees the whole histogram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import bounded_batches, staged, text_or_empty

#: Lengths that share a range of the two-level sums.
RANGE = 512
#: Distinct chunks whose token count a task remembers, and the longest chunk remembered.
MEMO_CHUNKS, MEMO_CHARS = 1_000_000, 48

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than blank and line feed: beside it a blank is no safe place to cut.
_ODD_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ChunkCounts(dict):
    """Number of tokens of a chunk; remembers short chunks."""

    def __init__(self, path: str, pattern: str):
        self.encode = codec(path, pattern).encode

    def __missing__(self, chunk: str) -> int:
        n = len(self.encode(chunk))
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if _ODD_SPACE.search(text):
            return len(self.encode(text))
        n = sum(map(self.__getitem__, _CHUNK.findall(text)))
        if len(self) > MEMO_CHUNKS:
            self.clear()
        return n


_COUNTERS: dict[tuple[str, str], ChunkCounts] = {}


def encoded_lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens.

    Defined cases: a null or empty text has 0 tokens. Whole texts count, however long. Repeated
    rows and null ids stay. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _COUNTERS.setdefault((path, pattern), ChunkCounts(path, pattern))
        for batch in batches:
            n = pa.array([counts.count(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs), one row per distinct length; null lengths are left out."""
    return lengths.filter(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, width: int = RANGE) -> DataFrame:
    """The histogram with, at each length L taken as a context limit:

    docs_longer (documents over L), docs_up_to, tokens_up_to (tokens of documents of at most L),
    tokens_total (of all documents), truncated_total (tokens left when each document is cut to
    L), quantile (share of documents of at most L).
    An empty histogram gives an empty result.
    """
    h = staged(histogram.sparkSession, histogram.withColumn("part", F.floor(F.col("n_tokens") / width)), "lengths")
    tokens = F.col("n_tokens") * F.col("n_docs")
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum(tokens).alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("part_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("part_docs").over(whole).alias("docs_total"),
        F.sum("part_tokens").over(whole).alias("tokens_total"),
    )
    inside = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(parts, "part")
        .withColumn("docs_up_to", F.col("docs_before") + F.sum("n_docs").over(inside))
        .withColumn("tokens_up_to", F.col("tokens_before") + F.sum(tokens).over(inside))
        .withColumn("docs_longer", F.col("docs_total") - F.col("docs_up_to"))
        .select(
            "n_tokens", "n_docs", "docs_longer", "docs_up_to", "tokens_up_to", "tokens_total",
            (F.col("tokens_up_to") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
            (F.col("docs_up_to") / F.col("docs_total")).alias("quantile"),
        )
    )


def totals_for_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, truncated_total) for limits that need not be lengths that occur."""
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    at = sums.select(wanted, "*").groupBy("context_limit").agg(
        F.max_by("docs_longer", F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_tokens"))).alias("docs_longer"),
        F.max_by("tokens_up_to", F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_tokens"))).alias("tokens_up_to"),
        F.max("docs_up_to").alias("docs_total"),
    )
    longer = F.coalesce("docs_longer", "docs_total")
    return at.select("context_limit", longer.alias("docs_longer"),
                     (F.coalesce("tokens_up_to", F.lit(0)) + longer * F.col("context_limit")).alias("truncated_total"))
