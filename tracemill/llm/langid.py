"""Language identification, words first and shorter and shorter character n-grams behind them.

Training counts words per language over all training documents and derives character n-gram
counts from the distinct words. Every counted word and n-gram is in the model: the most frequent
ones, as many as ``WORD_CELLS`` and ``GRAM_CELLS`` allow, are broadcast; the rest stays in tables
that words are joined with.

Scoring: a known word adds its log frequency in each language. An unseen word is covered from
the left by the longest known n-grams, four characters at most, and adds theirs. A task scores
what the broadcast core can tell; if the core is not the whole model, the other words of a
document are listed, joined with the tables, and their scores added. Both ways give the same.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, staged, text_or_empty

#: Numbers (entries times languages) of words and of n-grams that are broadcast.
WORD_CELLS, GRAM_CELLS = 1_000_000, 8_000_000
LONGEST_GRAM = 4
#: What a word or n-gram of another language counts in a language that never had it.
UNSEEN = 0.5
#: Counts that a task gathers before it passes them on, and words a scorer remembers.
HELD_WORDS, MEMO_WORDS = 400_000, 300_000
#: Words beyond this length are scored like any other, but not remembered.
MEMO_CHARS = 48
#: Language of texts without a letter.
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over whole texts, lower-cased; null languages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            langs = [lang for lang, c in held.items() for _ in range(len(c))]
            words = [w for c in held.values() for w in c]
            counts = [n for c in held.values() for n in c.values()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(lang, Counter())
                own.update(_WORD.findall(text.lower()))
                if len(own) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int = LONGEST_GRAM) -> DataFrame:
    """(lang, size, gram, n) over distinct words between ``^`` and ``$``, each word counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, len(g), g, n) for lang, c in held.items() for g, n in c.items()]
            held.clear()
            columns = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "gram", "n"])

        for batch in batches:
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(lang, Counter())
                word = f"^{word}$"
                for size in range(1, longest + 1):
                    own.update([word[i : i + size] for i in range(len(word) - size + 1)])
                if len(own) > HELD_WORDS:
                    yield flush()
        yield flush()

    return words.select("lang", "word").mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def _log_table(counts: DataFrame, name: str, langs: list[str], totals: Column) -> DataFrame:
    """(name, total, logs): log frequency per language of each counted word or n-gram; ``totals`` is an array per row.

    Logs are rounded to what a 32-bit float holds, so that an entry counts the same from the core and from the table.
    """
    wide = counts.groupBy(F.col(name).alias("name")).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("own"))
    log = lambda lang, i: F.log(F.coalesce(F.try_element_at("own", lang).cast("double"), F.lit(UNSEEN)) / F.element_at(totals, i + 1)).cast("float").cast("double")
    return wide.select("name", "total", F.transform(F.lit(langs), log).alias("logs"))


class Core:
    """The most frequent entries of a table by their hash: sorted hashes, and a row of logs for each."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, whole: bool):
        order = np.argsort(keys, kind="stable")
        self.keys, self.logs, self.whole = keys[order], logs[order], whole

    def row(self, name: str) -> int:
        """Row of an entry, -1 if it is not in the core."""
        key = np.uint64(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 42))
        at = int(self.keys.searchsorted(key))
        return at if at < len(self.keys) and self.keys[at] == key else -1


def _core(table: DataFrame, langs: int, cells: int) -> Core:
    """Entries above a frequency that is chosen so that ``cells`` numbers suffice; equal frequencies go together."""
    step = F.floor(F.log2(F.col("total").cast("double")) * 8)
    sizes = sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)  # some 500 rows at most
    left, lowest = cells // max(langs, 1), None
    for at, n in sizes:
        left -= n
        if left < 0:
            break
        lowest = at
    if lowest is None:
        return Core(np.zeros(0, np.uint64), np.zeros((0, langs), np.float32), not sizes)
    got = table.filter(step >= lowest).select(F.xxhash64("name").alias("key"), F.col("logs").cast("array<float>").alias("logs")).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    logs = got.column("logs").combine_chunks().flatten().to_numpy().reshape(len(keys), langs)
    return Core(keys, logs, left >= 0)


class Model:
    """Languages, the broadcast cores of words and n-grams, and the tables behind them."""

    def __init__(self, langs: list[str], words: Core, grams: Core, unknown: list[float], tables: tuple[DataFrame, DataFrame] | None):
        self.langs, self.words, self.grams, self.unknown, self.tables = langs, words, grams, unknown, tables
        self.whole = words.whole and grams.whole


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", word_cells: int = WORD_CELLS, gram_cells: int = GRAM_CELLS) -> Model:
    """Counts everything; only totals and the bounded cores come to the driver.

    Rows with a null language are left out; without any other the model knows no language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    words = staged(spark, word_counts(docs, text_col, lang_col), "lang-words")
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        nothing = Core(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), True)
        return Model([], nothing, nothing, [], None)
    grams = staged(spark, gram_counts(words), "lang-grams")
    gram_totals = {(r.lang, r["size"]): r.n for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    by_size = [[float(max(gram_totals.get((lang, size), 0), 1)) for lang in langs] for size in range(1, LONGEST_GRAM + 1)]
    word_table = staged(spark, _log_table(words, "word", langs, F.lit([float(max(totals[x], 1)) for x in langs])), "lang-word-logs")
    of_size = F.element_at(F.array(*[F.lit(t) for t in by_size]), F.length("name"))
    gram_table = staged(spark, _log_table(grams, "gram", langs, of_size), "lang-gram-logs")
    unknown = [float(np.float32(np.log(UNSEEN / t))) for t in by_size[0]]  # a character that no language has
    return Model(langs, _core(word_table, len(langs), word_cells), _core(gram_table, len(langs), gram_cells), unknown, (word_table, gram_table))


def cover(marked: str, known) -> list[str | None]:
    """The longest n-grams for which ``known`` holds, from the left; None for a character that is in none."""
    out, at = [], 0
    while at < len(marked):
        for size in range(min(LONGEST_GRAM, len(marked) - at), 0, -1):
            if known(marked[at : at + size]):
                out.append(marked[at : at + size])
                at += size
                break
        else:
            out.append(None)
            at += 1
    return out


class Scorer(dict):
    """Word to the rows of logs that it adds; empty for a word that the core cannot tell."""

    def __init__(self, langs: int, words: Core, grams: Core, unknown: list[float]):
        self.words, self.grams, self.whole = words, grams, words.whole and grams.whole
        self.logs = np.concatenate([words.logs, grams.logs, np.array(unknown, np.float32).reshape(1, langs)]) if self.whole else words.logs
        self.gram_rows: dict[str, int] = {}

    def _gram(self, gram: str) -> int:
        if gram not in self.gram_rows:
            if len(self.gram_rows) > MEMO_WORDS:
                self.gram_rows.clear()
            self.gram_rows[gram] = self.grams.row(gram)
        return self.gram_rows[gram]

    def __missing__(self, word: str) -> tuple[int, ...]:
        at = self.words.row(word)
        if at >= 0:
            rows = (at,)
        elif self.whole:
            first = len(self.words.keys)
            rows = tuple(len(self.logs) - 1 if g is None else first + self._gram(g) for g in cover(f"^{word}$", lambda g: self._gram(g) >= 0))
        else:
            rows = ()
        if len(word) <= MEMO_CHARS:
            self[word] = rows
        return rows

    def add_up(self, text: str) -> tuple[bool, np.ndarray, int, list[tuple[str, int]]]:
        """Whether there is a letter, the summed logs, how many parts they have, and the words left over with their counts."""
        words = _WORD.findall(text.lower())
        if not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return False, np.zeros(self.logs.shape[1]), 0, []
        own = list(map(self.__getitem__, words))
        rows = list(chain.from_iterable(own))
        if len(self) > MEMO_WORDS:
            self.clear()
        rest = [] if self.whole else list(Counter(w for w, r in zip(words, own) if not r).items())
        return True, self.logs[rows].sum(axis=0, dtype=np.float64), len(rows), rest


_SCORERS: dict[str, Scorer] = {}


def _added(docs: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, letters, sums, parts, rest) of each of (row, doc_id, text)."""
    nothing = Core(np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32), False)
    # bounded by WORD_CELLS and GRAM_CELLS
    shared = docs.sparkSession.sparkContext.broadcast((len(model.langs), model.words, model.grams if model.whole else nothing, model.unknown))
    name = uuid.uuid4().hex
    pair = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SCORERS:  # one scorer per Python worker, what it remembers lasts for a task
            _SCORERS.clear()
            _SCORERS[name] = Scorer(*shared.value)
        scorer = _SCORERS[name]
        for batch in batches:
            found = [scorer.add_up(t) for t in batch.column(2).to_pylist()]
            rest = [[{"word": w, "n": n} for w, n in x[3]] for x in found]
            data = [[x[0] for x in found], [x[1].tolist() for x in found], [x[2] for x in found], rest]
            kinds = (pa.bool_(), pa.list_(pa.float64()), pa.int64(), pa.list_(pair))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(data, kinds)]], names=["row", "doc_id", "letters", "sums", "parts", "rest"])
        release(scorer, scorer.gram_rows)

    return docs.mapInArrow(run, "row long, doc_id long, letters boolean, sums array<double>, parts long, rest array<struct<word: string, n: long>>")


def _covered(words: DataFrame, model: Model) -> DataFrame:
    """(word, logs, parts) of distinct words that no language has, by the n-grams: from the core if that holds all, else joined."""
    if model.grams.whole:
        only = Core(np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32), True)
        shared = words.sparkSession.sparkContext.broadcast((len(model.langs), only, model.grams, model.unknown))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value)
            for batch in batches:
                rows = [scorer.__missing__(w) for w in batch.column(0).to_pylist()]
                scorer.clear()
                logs = [scorer.logs[list(r)].sum(axis=0, dtype=np.float64) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs, pa.list_(pa.float64())), pa.array([len(r) for r in rows], pa.int64())], names=["word", "logs", "parts"])

        return words.mapInArrow(told, "word string, logs array<double>, parts long")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                marked = f"^{word}$"
                own = sorted({marked[i : i + size] for size in range(1, LONGEST_GRAM + 1) for i in range(len(marked) - size + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([word] * len(own), pa.string()), pa.array(own, pa.string())], names=["word", "name"])

    size, unknown = len(model.langs), np.array(model.unknown)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, parts = [], []
            for word, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = {g["name"]: g["logs"] for g in known or ()}
                found = cover(f"^{word}$", table.__contains__)
                logs.append(np.sum([unknown if g is None else table[g] for g in found], axis=0).tolist() if size else [])
                parts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs, pa.list_(pa.float64())), pa.array(parts, pa.int64())], names=["word", "logs", "parts"])

    known = words.mapInArrow(grams, "word string, name string").join(model.tables[1].select("name", "logs"), "name")
    lists = known.groupBy("word").agg(F.collect_list(F.struct("name", "logs")).alias("known"))
    return words.join(lists, "word", "left").select("word", "known").mapInArrow(add_up, "word string, logs array<double>, parts long")


def _rest_added(added: DataFrame, model: Model) -> DataFrame:
    """``added`` with the words that the core could not tell added to the sums."""
    spark, size = added.sparkSession, len(model.langs)
    rest = staged(spark, added.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n"), "lang-rest")
    known = rest.join(model.tables[0].select(F.col("name").alias("word"), "logs"), "word", "left")
    known = staged(spark, known.select("row", "word", "n", "logs"), "lang-rest-known")
    unseen = staged(spark, known.filter("logs is null").select("word").distinct(), "lang-unseen")
    covered = known.filter("logs is null").select("row", "word", "n").join(_covered(unseen, model), "word")
    told = known.filter("logs is not null").select("row", "n", "logs", F.lit(1).cast("long").alias("parts")).unionByName(covered.select("row", "n", "logs", "parts"))
    sums = told.groupBy("row").agg(F.sum(F.col("n") * F.col("parts")).alias("more_parts"), F.array(*[F.sum(F.col("n") * F.get("logs", F.lit(i))) for i in range(size)]).alias("more"))
    both = added.drop("rest").join(sums, "row", "left")
    total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    return both.select("row", "doc_id", "letters", total.alias("sums"), (F.col("parts") + F.coalesce("more_parts", F.lit(0))).alias("parts"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1, the language's share against the others).

    Defined cases: null, empty and letterless texts (and every text, if nothing was learned) are
    ``und`` with score 0. Of equally likely languages the first in alphabetical order is taken.
    Whole texts count, however long. Repeated rows and null ids stay. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    added = _added(rows, model)
    if not model.whole:
        added = _rest_added(staged(docs.sparkSession, added, "lang-added"), model)
    best = F.array_max("sums")
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp((x - best) / F.sqrt(F.col("parts").cast("double"))))
    known = F.col("letters") & (F.size("sums") > 0)
    lang = F.element_at(F.lit(model.langs or [UNDETERMINED]), F.array_position("sums", best).cast("int"))
    return added.select("doc_id", F.when(known, lang).otherwise(UNDETERMINED).alias("lang_pred"), F.when(known, share).otherwise(0.0).alias("score"))
