"""Spelling variants: words one edit apart, found through pivotal grams.

Bigrams are ordered by how many words have them, the rare ones first. A word's prefix is its three
first bigrams in that order (and further places of the third); among these, dynamic programming
chooses the two rarest that share no letter, its pivots. One edit breaks at most one of two
disjoint bigrams. So of two words one edit apart, the one whose prefix ends earlier in the order
has a pivot that is whole in the other word and, its order being known, in the other's prefix.

Position limits: the edit lies to the right of the first pivot or to the left of the second. In
the first case the pivot has its place from the word's beginning, and what is left of it is the
same in both words; in the second its place from the end, with what is right of it. Pivots and
prefixes are rows keyed by that side and the length of the longer or shorter word, one equi-join
finds the candidates, and each is verified by its edit distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged

#: Words have at least LEAST_CHARS code points and LEAST_COUNT occurrences.
LEAST_CHARS, LEAST_COUNT = 6, 5
#: A word's form is a near word that is at least RATIO times as frequent.
RATIO = 5
#: Bigrams whose frequency is broadcast, the most frequent; all others rank before them.
BIGRAMS = 100_000
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 200_000
#: Rows of a key beyond which it is dealt to several tasks.
HOT = 2000

#: Latin-1 as the counting sees it: A-Z become a-z, a-z and U+00C0 to U+00FF stay, all else separates.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_ROWS = "indexed boolean, side string, size int, part string, last string, word string, n long"


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
    edit: Callable[[int | None, bytes], bytes] | None = None,
) -> DataFrame:
    """(word, n): words of at least ``least_chars`` code points with at least ``least_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. ``edit`` may change
    a document's words (Latin-1 bytes) before they are counted; it must not make them longer.

    Defined cases: a null or empty text has no words. Whole texts count, however long. Repeated
    rows count each; a null id is passed on as None. An empty table gives no words. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                for word, n in words.items():
                    if len(word) >= least_chars:
                        if edit:
                            word = edit(doc_id, word)
                            if len(word) < least_chars:
                                continue
                        total[word] += n
                if len(total) > COUNTED:
                    yield counted()
        yield counted()

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return wanted.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def pivots(grams: list[tuple[str, int]]) -> tuple[int, int]:
    """Places of the two rarest disjoint bigrams among (order, place) in ascending places.

    Dynamic programming over the places: the best single bigram that ends before the present one,
    and the best pair so far. Orders are compared as pairs, the greater first.
    """
    pair = single = None
    waiting: list[tuple[str, int]] = []
    for order, at in grams:
        while waiting and waiting[0][1] <= at - 2:
            single = min(filter(None, (single, waiting.pop(0))))
        if single is not None:
            cost = (max(single[0], order), min(single[0], order))
            pair = min(filter(None, (pair, (cost, single[1], at))))
        waiting.append((order, at))
    return pair[1], pair[2]


def _rows_of(word: str, n: int, order: dict[str, str]) -> Iterator[tuple]:
    """The word's rows: its prefix for the index, its pivots with the lengths that a word one edit away can have."""
    size = len(word)
    grams = [(order.get(word[i : i + 2]) or "0000000" + word[i : i + 2], i) for i in range(size - 1)]
    last = sorted(grams)[2][0]
    prefix = [(o, i) for o, i in grams if o <= last]
    for _, i in prefix:
        yield True, "L", size, word[: i + 2], last, word, n
        yield True, "R", size, word[i:], last, word, n
    # the pivots come from the three first bigrams; further places of the third only serve the index
    first, second = pivots(sorted(sorted(grams)[:3], key=lambda g: g[1]))
    for other in (size - 1, size, size + 1):
        yield False, "L", other, word[: first + 2], last, word, n
        yield False, "R", other, word[second:], last, word, n


def _bigram_order(words: DataFrame) -> dict[str, str]:
    """The frequent bigrams with a text that sorts by frequency, then bigram; at most BIGRAMS of them."""
    grams = F.explode(F.expr("array_distinct(transform(sequence(1, length(word) - 1), i -> substring(word, i, 2)))"))
    counts = words.select(grams.alias("gram")).groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(BIGRAMS).collect()
    return {r.gram: f"{i + 1:07d}{r.gram}" for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r.gram)))}


def near_words(spark: SparkSession, words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words that differ by exactly one inserted, deleted or replaced code point.

    ``words`` has distinct words of at least four code points. A key that many words share is dealt
    by the indexed word to as many tasks as it needs, and its pivots go to each of them.
    """
    order = spark.sparkContext.broadcast(_bigram_order(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
        names = ["indexed", "side", "size", "part", "last", "word", "n"]
        for batch in batches:
            rows = [r for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _rows_of(w, n, order.value)]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    rows = staged(spark, words.select("word", "n").mapInArrow(run, _ROWS), "grams")
    key = ["side", "size", "part"]
    index, probes = rows.filter("indexed").drop("indexed"), rows.filter("not indexed").drop("indexed")
    crowded = staged(spark, index.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > hot).select(*key, F.ceil(F.col("members") / hot).cast("int").alias("salts")), "hot-grams")
    index = index.join(crowded, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("word"), F.col("salts")), F.lit(0)).cast("int"))
    probes = probes.join(crowded, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    a, b = probes.alias("a"), index.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "salt")]
    checks = [F.col("a.last") <= F.col("b.last"), F.col("a.word") != F.col("b.word"), F.levenshtein("a.word", "b.word", 1) == 1]
    condition = same[0]
    for c in same[1:] + checks:
        condition = condition & c
    once = a.join(b, condition).select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    turned = once.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return once.union(turned).distinct()


def _roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form. Each pass doubles the steps taken; counts grow at least fivefold along a chain, so a few passes do."""
    links = staged(spark, forms.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        further = staged(spark, links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        links = further.select("word", "root")
        if not further.filter("moved").limit(1).count():
            return links


def spelling_variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    Near words differ by exactly one code point. A word's form is its near word of largest n (ties:
    the smallest in code-point order) if that is at least ``ratio`` times the word's n; root follows
    the forms to the last.

    Defined cases: words without near words have n_near 0, no form and themselves as root. Words of
    fewer than four code points have no two disjoint bigrams among their first three and raise a
    ValueError. Rows that repeat a word are added up, a null n counts as 0, and null words are left
    out. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = words.sparkSession
    known = words.filter(F.col("word").isNotNull()).select("word", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    words = staged(spark, known.groupBy("word").agg(F.sum("n").alias("n")), "words")
    if words.filter(F.length("word") < 4).limit(1).count():
        raise ValueError("words of fewer than four code points have no pivotal grams")
    pairs = near_words(spark, words, hot)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"), F.first("n").alias("n"))
    fits = -F.col("best.order") >= ratio * F.col("n")
    forms = staged(spark, best.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.order")).alias("form_n")), "near")
    return (
        words.join(forms, "word", "left").join(_roots(spark, forms), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
