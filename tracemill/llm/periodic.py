"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run repeats with a period q, so each of its words occurs at least ``TIMES`` times in it. A word
that is rarer than that within a segment can be in no run there and splits the segment; what is
left is counted and split again until no segment changes. Most of a text is gone after the first
count. The surviving segments are scanned lag by lag.

The scan takes the lags of [Q, 2Q) together, for Q = 1, 2, 4 and so on. A run whose period is
such a lag holds two neighbouring blocks of Q words, at multiples of Q, that both come again at
that lag. Fingerprints of all stretches of Q words (doubled from level to level) are compared per
block with those at the level's lags, n comparisons a level; what agrees is extended word by word,
which also removes what only the fingerprints had in common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

#: A run has at least LEAST_WORDS words and TIMES periods.
LEAST_WORDS, TIMES = 6, 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def surviving_segments(codes: np.ndarray, least_words: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs at least ``times`` times; negative codes split from the start."""
    fewest = min(times, least_words)

    def parts(cut: np.ndarray, base: int) -> list[tuple[int, int]]:
        """The stretches between the places of ``cut`` that are long enough for a run."""
        edges = np.concatenate(([-1], np.flatnonzero(cut), [len(cut)]))
        wide = np.flatnonzero(np.diff(edges) > least_words)
        return [(base + int(edges[i]) + 1, base + int(edges[i + 1])) for i in wide]

    todo, stable = parts(codes < 0, 0), []
    while todo:
        start, end = todo.pop()
        _, at, counts = np.unique(codes[start:end], return_inverse=True, return_counts=True)
        rare = counts < fewest
        if rare.any():
            todo += parts(rare[at], start)
        else:
            stable.append((start, end))
    return sorted(stable)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements ``a`` and ``b`` have in common from their beginnings on."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def lag_scan(x: np.ndarray, least_words: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of the segment, in no order."""
    n, q0 = len(x), 1
    marks = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    found: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    while max(least_words, times * q0) <= n:
        # agrees[j, d]: block j and the stretch of q0 words that lies q0 + d further on have equal fingerprints
        blocks = marks[::q0]
        rows = len(blocks)
        later = np.zeros(rows * q0, np.uint64)
        later[: len(marks) - q0] = marks[q0:]
        agrees = later.reshape(rows, q0) == blocks[:, None]
        agrees.reshape(-1)[len(marks) - q0 :] = False
        both = agrees[:-1] & agrees[1:]
        for start, length, period in found:  # multiples of a known period add nothing inside its run
            for q in range(-(-q0 // period) * period, 2 * q0, period):
                first, last = -(-start // q0), (start + length - q) // q0 - 2
                if last >= first:
                    both[first : last + 1, q - q0] = False
        reached: dict[int, int] = {}
        for d, j in np.argwhere(both.T).tolist():
            q, i = q0 + d, j * q0
            if i < reached.get(q, -1):
                continue
            right = _agree(x[i:], x[i + q :])
            left = _agree(x[:i][::-1], x[: i + q][::-1])
            start, length = i - left, left + right + q
            reached[q] = i + right
            if length >= max(least_words, times * q) and (start, length) not in seen:
                seen.add((start, length))
                found.append((start, length, q))
        wider = len(marks) - q0
        marks = (marks[:wider] * np.uint64(0xD6E8FEB86659FD93)) ^ (marks[q0 : q0 + wider] * np.uint64(0xA0761D6478BD642F) + np.uint64(1))
        marks ^= marks >> np.uint64(29)
        q0 *= 2
    return found


def word_runs(words: list, least_words: int = LEAST_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a list of words, by start, then period."""
    if len(words) < least_words:
        return []
    often = {w: i for i, (w, n) in enumerate(Counter(words).items()) if n >= min(times, least_words)}
    if not often:
        return []
    codes = np.fromiter((often.get(w, -1) for w in words), np.int64, len(words))
    runs = []
    for start, end in surviving_segments(codes, least_words, times):
        runs += [(start + s, length, q) for s, length, q in lag_scan(codes[start:end], least_words, times)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def without_repeats(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, by start), collapsed (the text with one period of each run, words joined by one blank).

    Words are what stands between blanks, tabs, line feeds, vertical tabs, form feeds and carriage
    returns. A run is a maximal stretch of words with smallest period q and at least
    max(``least_words``, ``times`` * q) words; ``times`` is at least 4, or the scan would not see every run.

    Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text.
    Whole texts count, however long; a task holds one batch of texts. Of overlapping runs each is
    reported. Repeated rows and null ids stay. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    if times < TIMES:
        raise ValueError(f"times must be at least {TIMES}")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()  # of bytes: splits at just the six characters named above
                found = word_runs(words, least_words, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(without_repeats(words, found)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, _SCHEMA)


def run_report(runs: DataFrame) -> DataFrame:
    """Digests of ``periodic_runs``: the run of greatest length / period (then smallest start, then period) and hashes of all runs and of the collapsed text."""
    greater = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, r) -> case when a is null or r.length * a.period > a.length * r.period then r else a end)"
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr(greater).alias("best"), "runs", "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.expr("sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the documents, told by the checksum of their ids, repeat a stretch of their own words to the end.

    With h the checksum and g = h div 10, the words from place a = g mod n on repeat the
    1 + (n - a) div (3 + g mod 8) words that stand there.
    """
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(text_or_empty("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.col("k"))), F.lit(1), F.col("n") - F.col("a"))
    # the ids' decimal text; a null id counts as the empty one
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.crc32(ids.cast("binary")).alias("h"))
        .withColumn("words", words)
        .withColumn("n", F.size("words"))
        .withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("k", (3 + F.col("g") % 8).cast("int"))
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("k"))).cast("int"))
        .select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).alias("text"))
    )
