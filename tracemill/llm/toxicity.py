"""Toxicity of whole texts behind a noisy channel.

1. A character trigram model is counted over every document of the corpus (a table of fixed size
   that each task fills and Spark sums).
2. Spans that may be disguised are found: letters next to look-alike digits or signs, a letter
   three times in a row, single letters spelt out with separators. Each span is a lattice, where
   a sign may stand for a letter or for itself, a separator may be dropped or kept, a repetition
   may be dropped. Viterbi search under the character model and the channel's costs restores the
   likeliest reading. Text outside such spans has one reading only: itself.
3. The restored text is scored by a logistic model over the words and word beginnings in it. It
   is fitted on a bounded sample of labelled rows; features are all those whose likelihood ratio
   chance does not explain.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, staged, text_or_empty

#: Labelled rows that the classifier is fitted on (the smallest hashes of their ids).
SAMPLE_ROWS = 30_000
#: Features that chance alone may bring past the likelihood ratio's threshold, expected over all that occur.
CHANCE = 0.05
#: Word beginnings that are features beside the words.
STEMS = (4, 5, 6)
#: Least labelled documents in which a feature occurs.
LEAST_DOCS = 3
#: What a sign may stand for (look-alikes).
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: What may stand between spelt-out letters.
SEPARATORS = " .-_*"
#: Log costs of the channel: a letter written as a sign, a sign that is itself, a separator put in, a letter repeated.
SUBSTITUTED, LITERAL, SPACED, REPEATED = math.log(0.2), math.log(0.05), math.log(0.3), math.log(0.3)
#: At the ends of a word a sign is often just itself: marks behind it, marks before it, digits.
MARK_BEHIND, MARK_BEFORE, DIGIT_AT_END = math.log(0.9), math.log(0.5), math.log(0.3)
#: Characters after which the paths of a span give up what they have in common.
COMMIT_CHARS = 64
#: Restored spans and words that a task remembers; longer spans are read but not remembered.
MEMO_SPANS, MEMO_WORDS, MEMO_CHARS = 50_000, 200_000, 80

_WORD = re.compile(r"[^\W\d_]+")

# Symbols of the character model: 0 is everything between words, 1-26 a-z, then Latin-1 letters, then any other letter.
_EDGE, _OTHER, _SYMBOLS = 0, 60, 61


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x300, np.uint8)
    for c in range(0x300):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else low - 0xDF + 27 if 0xDF <= low <= 0xFF else _OTHER
    return table


_TABLE = _symbol_table()


def _symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of code points; letters past the table count as one symbol."""
    out = _TABLE[np.minimum(points, 0x2FF)]
    far = points >= 0x300
    if far.any():
        out[far] = [_OTHER if chr(p).isalpha() else _EDGE for p in points[far]]
    return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): counts of symbol triples over all whole texts; at most ``_SYMBOLS`` cubed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = _symbols(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
                s = np.concatenate([np.zeros(2, np.uint8), s, np.zeros(1, np.uint8)]).astype(np.int32)
                s = s[np.concatenate([[True], (s[1:] != _EDGE) | (s[:-1] != _EDGE)])]  # one edge between words
                s = np.concatenate([np.zeros(1, np.int32), s])
                if len(s) > 2:
                    total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(total))
        codes = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(total[codes])], names=["code", "n"])

    return docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities [symbol before last, last, next], smoothed by shorter contexts."""
    n = np.zeros(_SYMBOLS**3)
    for r in counts.collect():  # at most _SYMBOLS cubed rows
        n[r.code] = r.n
    n = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    pairs = n.sum(axis=0)
    single = pairs.sum(axis=0)
    p1 = (single + 1) / (single.sum() + _SYMBOLS)
    p2 = (pairs + 5 * p1) / (pairs.sum(axis=1, keepdims=True) + 5)
    p3 = (n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


def literal_costs(span: str) -> list[float]:
    """What it costs to read each sign of a span as itself, by its place; 0 for other characters."""
    letters = [i for i, c in enumerate(span) if c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (len(span), -1)
    place = lambda at, c: LITERAL if first < at < last else DIGIT_AT_END if c.isdigit() else MARK_BEHIND if at > last else MARK_BEFORE
    return [place(at, c) if c in LOOKALIKES else 0.0 for at, c in enumerate(span)]


class Restorer(dict):
    """Reads disguised spans; remembers what it has read."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()
        kinds = np.zeros(0x300, np.uint8)  # 1 letter, 2 look-alike, 4 separator
        kinds[_TABLE != _EDGE] = 1
        for c in LOOKALIKES:
            kinds[ord(c)] = 2
        for c in SEPARATORS:
            kinds[ord(c)] = 4
        self.kinds = kinds

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the spans that may be disguised, in order, not overlapping."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) < 3:
            return []
        kind = self.kinds[np.minimum(points, 0x2FF)]
        inside = (kind == 1) | (kind == 2)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return []
        mixed = np.flatnonzero((kind[1:] + kind[:-1] == 3) & inside[1:] & inside[:-1])
        thrice = np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]) & (kind[2:] == 1))
        found = set()
        if len(mixed) or len(thrice):
            for i in set(np.searchsorted(starts, np.concatenate([mixed, thrice]), side="right") - 1):
                found.add((int(starts[i]), int(ends[i])))
        alone = ends - starts == 1
        if alone.sum() > 2:
            near = alone[1:] & alone[:-1] & (starts[1:] - starts[:-1] == 2)
            near &= kind[np.minimum(ends[:-1], len(kind) - 1)] == 4
            runs = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).view(np.int8)))
            for a, b in zip(runs[::2], runs[1::2]):
                if b - a >= 2:
                    found.add((int(starts[a]), int(ends[b])))
        return sorted(found)

    def __missing__(self, span: str) -> str:
        out = self._read(span)
        if len(span) <= MEMO_CHARS:
            self[span] = out
        return out

    def _read(self, span: str) -> str:
        """The likeliest reading: letters, with a blank for whatever is kept between words.

        Paths that survive soon agree on all but their ends; what they share is set aside now and
        then, so that a span of any length is read whole in time and room proportional to it.
        """
        logs, kept, done = self.logs, literal_costs(span), []
        paths = {(_EDGE, _EDGE): (0.0, "")}
        for at, c in enumerate(span):
            low = c.lower()
            symbol = int(_symbols(np.array([ord(c)], np.uint32))[0])
            readings: list[tuple[float, str, int]] = []
            if symbol != _EDGE:
                readings.append((0.0, low, symbol))
                if 0 < at and span[at - 1].lower() == low and (span[at - 2 : at - 1].lower() == low or span[at + 1 : at + 2].lower() == low):
                    readings.append((REPEATED, "", -1))
            else:
                readings.append((kept[at], " ", _EDGE))
                for letter in LOOKALIKES.get(c, ""):
                    readings.append((SUBSTITUTED, letter, ord(letter) - 96))
                if c in SEPARATORS:
                    readings.append((SPACED, "", -1))
            ahead: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in paths.items():
                for cost, letter, s in readings:
                    if s == -1 or (s == _EDGE and b == _EDGE):
                        key, total, out = (a, b), score + cost, text
                    else:
                        key, total, out = (b, s), score + cost + logs[a][b][s], text + letter
                    if key not in ahead or (total, out) > ahead[key]:
                        ahead[key] = total, out
            paths = ahead
            if at % COMMIT_CHARS == COMMIT_CHARS - 1:
                done.append(os.path.commonprefix([text for _, text in paths.values()]))
                paths = {key: (score, text[len(done[-1]) :]) for key, (score, text) in paths.items()}
        best = max((score + (0.0 if b == _EDGE else logs[a][b][_EDGE]), text) for (a, b), (score, text) in paths.items())[1]
        return "".join([*done, best])

    def restore(self, text: str) -> str:
        """The text with its disguised spans restored."""
        found = self.spans(text)
        if not found:
            return text
        parts, done = [], 0
        for start, end in found:
            if start < done:
                continue
            parts.append(text[done:start])
            parts.append(self[text[start:end]])
            done = end
        if len(self) > MEMO_SPANS:
            self.clear()
        return "".join([*parts, text[done:]])


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


class Features(dict):
    """Word to the indices of its features among those chosen."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
        return out

    def present(self, text: str) -> list[int]:
        words = set(_WORD.findall(text.lower()))
        found = sorted({i for own in map(self.__getitem__, words) if own for i in own})
        if len(self) > MEMO_WORDS:
            self.clear()
        return found


def labelled_sample(labels: DataFrame, train, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, toxic): at most ``rows`` labelled ids where ``train`` (a condition on the id) holds.

    A null id or label is no label; an id labelled twice counts as toxic if any label says so.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train(id_col))
    own = own.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _restored(docs: DataFrame, logs_shared, extra: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(logs_shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            text = pa.array([restorer.restore(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, "text", text)

    return docs.select("doc_id", "text", *extra).mapInArrow(run, docs.select("doc_id", "text", *extra).schema)


def _feature_counts(restored: DataFrame) -> DataFrame:
    """(feature, n, n_toxic): in how many labelled documents a feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(counts[0])
            out = [pa.array(names, pa.string()), pa.array([counts[0][f] for f in names], pa.int64()), pa.array([counts[1][f] for f in names], pa.int64())]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays(out, names=["feature", "n", "n_toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}
                counts[0].update(found)
                if toxic:
                    counts[1].update(found)
                if len(counts[0]) > 500_000:
                    yield flush()
        yield flush()

    return restored.mapInArrow(run, "feature string, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _fit(rows: list[list[int]], toxic: list[int], size: int) -> np.ndarray:
    """Weights of the features and, last, the constant: logistic regression with a quadratic penalty.

    Newton steps, each solved by conjugate gradients on the features that the rows hold.
    """
    at = np.array([i for found in rows for i in [*found, size]], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(found) + 1 for found in rows])
    times = lambda v: np.bincount(row, v[at], len(rows))
    back = lambda v: np.bincount(at, v[row], size + 1)
    y, w = np.array(toxic, float), np.zeros(size + 1)
    penalty = np.full(size + 1, 0.1)
    penalty[size] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        weight, rest = p * (1 - p), back(y - p) - penalty * w
        step, towards, left = np.zeros(size + 1), rest.copy(), rest @ rest
        for _ in range(200):
            if left < 1e-16:
                break
            curve = back(weight * times(towards)) + penalty * towards
            far = left / (towards @ curve)
            step, rest = step + far * towards, rest - far * curve
            left, was = rest @ rest, left
            towards = rest + left / was * towards
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class ToxicityModel:
    def __init__(self, logs: np.ndarray, index: dict[str, int], weights: np.ndarray):
        self.name, self.logs, self.index, self.weights = uuid.uuid4().hex, logs, index, weights


def train(docs: DataFrame, labels: DataFrame, train_fold, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, chance: float = CHANCE) -> ToxicityModel:
    """Character model over all of ``docs``; classifier over a bounded sample of its labelled rows.

    A feature counts if exp(-ratio), which bounds the chance of its likelihood ratio, times the number of
    features is below ``chance``; so the sample bounds their number. Labels without two classes,
    or none, give a model of the constant alone.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    logs = character_model(trigram_counts(docs, text_col))
    shared = spark.sparkContext.broadcast(logs)  # fixed size, 2 MB
    sample = labelled_sample(labels, train_fold, sample_rows, id_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # at most sample_rows pairs of numbers are broadcast
    restored = staged(spark, _restored(own.join(F.broadcast(sample), "doc_id"), shared, ["toxic"]), "toxicity-sample")
    totals = restored.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = totals.n, totals.t or 0
    if not n or t in (0, n):
        return ToxicityModel(logs, {}, np.array([math.log((t + 0.5) / (n - t + 0.5))]))
    a, b = F.col("n_toxic").cast("double"), (F.col("n") - F.col("n_toxic")).cast("double")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = (part(a, F.col("n") * t / n) + part(b, F.col("n") * (n - t) / n)
             + part(t - a, (n - F.col("n")) * t / n) + part((n - t) - b, (n - F.col("n")) * (n - t) / n))
    seen = staged(spark, _feature_counts(restored).filter(F.col("n") >= LEAST_DOCS), "toxicity-features")
    chosen = seen.filter(ratio > math.log(max(seen.count(), 1) / chance)).select("feature").collect()  # words of a bounded sample
    index = {feature: i for i, feature in enumerate(sorted(r.feature for r in chosen))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(index)
        for batch in batches:
            found = [features.present(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "found"])

    # a bounded number of rows with their features
    rows = sorted((r.doc_id, r.toxic, list(r.found)) for r in restored.mapInArrow(run, "doc_id long, toxic int, found array<int>").toLocalIterator())
    return ToxicityModel(logs, index, _fit([r[2] for r in rows], [r[1] for r in rows], len(index)))


_WORKERS: dict[str, tuple[Restorer, Features, np.ndarray]] = {}


def _scores(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """Scores of texts; the model is kept per Python worker, what it remembers lasts for a task."""
    if model.name not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[model.name] = Restorer(model.logs), Features(model.index), model.weights
    restorer, features, weights = _WORKERS[model.name]
    z = np.array([weights[features.present(restorer.restore(t or ""))].sum() + weights[-1] for t in texts])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if the score is at least 0.5).

    Defined cases: a null text counts as empty and gets the score of a text without features.
    Whole texts are scored, however long. Without two classes of labels every text gets the share
    of toxic labels. Repeated rows and null ids stay; equal texts get equal scores. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        release(*_WORKERS.get(shared.value.name, ())[:2])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic.

    Defined cases: as for ``score``; rows with a null text or id and repeated rows stay or go by
    their text alone.
    """
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_scores(shared.value, batch.column(at).to_pylist()) < 0.5))
        release(*_WORKERS.get(shared.value.name, ())[:2])

    # columns travel under plain names, whatever their own
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
