"""Mixture-controlled packing: deficit round-robin over one queue per source.

All tokens of a source, document after document, form its queue. Queues are drained at rates in
proportion to their targets; when one is empty, the others share its rate. How far each queue
should have come when R tokens are packed is therefore a formula (``Plan.due``), and a queue's
deficit is what is due to it less what it has given. Each window gives every queue its deficit in
whole tokens, then deals what is left one by one to the largest remainders. What a queue is owed
or owes is carried to the next window.

The corpus is cut into parts of a fixed number of windows, and a part's share of each queue is a
range of places that follows from the same formula. So a part knows, without its predecessors,
where they stopped: it begins with their deficits and in the middle of their last window, and no
part leaves a window unfilled. Only the very last tokens of the corpus fill no window; they are
cut into sequences whose lengths are powers of two.

A task holds the tokens of one part, a bounded number, however long a document or a source is.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release, staged, text_or_empty
from .packing import _memo, word_model

SEQUENCE_TOKENS = 4096
END_ID = 2
#: Windows that one task packs.
WINDOWS_PER_PART = 1024
#: Tokens of a document that travel as one row.
CHUNK_TOKENS = 512
#: Queues: the largest sources have one each, all others share the last.
QUEUES = 1000
#: Rows of the table of queue beginnings up to which it is broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000

_CHUNKS = "doc_id long, source string, part int, within long, start long, doc_tokens long, length int, ids binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Plan:
    """How queues of ``totals`` tokens are drained at ``rates`` (any scale), each until it is empty."""

    totals: np.ndarray
    rates: np.ndarray

    @property
    def phases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times at which the set of open queues changes, tokens packed by then, and tokens per unit of time from then on."""
        ends = self.totals / self.rates
        order = np.argsort(ends, kind="stable")
        times = np.concatenate(([0.0], ends[order]))
        open_rates = np.concatenate((np.cumsum(self.rates[order][::-1])[::-1], [0.0]))
        packed = np.concatenate(([0.0], np.cumsum(np.diff(times) * open_rates[:-1])))
        keep = np.flatnonzero(np.append(np.diff(times) > 0, False))  # queues that end together change the set once
        return times[keep], packed[keep], open_rates[keep]

    def due(self, packed: float) -> np.ndarray:
        """Tokens that each queue should have given when ``packed`` tokens are packed in all."""
        times, before, speed = self.phases
        at = max(int(np.searchsorted(before, packed, side="right")) - 1, 0)
        return np.minimum(self.totals, self.rates * (times[at] + (packed - before[at]) / speed[at]))

    def bounds(self, part: int, size: int) -> np.ndarray:
        """The place in each queue at which part number ``part`` of ``size`` tokens begins."""
        total = int(self.totals.sum())
        if part * size >= total:
            return self.totals.astype(np.int64)
        return np.minimum(np.ceil(self.due(part * size)), self.totals).astype(np.int64)

    def packed_at(self, queue_place: Column, queue: Column) -> Column:
        """As an expression: tokens packed in all when ``queue`` has given ``queue_place`` tokens."""
        lists = [F.array(*map(F.lit, map(float, a))) for a in (*self.phases, self.rates)]
        times, before, speed, rates = lists
        time = queue_place / F.element_at(rates, queue + 1)
        if len(self.phases[0]) == 1:
            return time * float(self.phases[2][0])
        at = F.greatest(F.lit(1), F.size(F.filter(times, lambda t: t <= time)))
        return F.element_at(before, at) + (time - F.element_at(times, at)) * F.element_at(speed, at)


def token_chunks(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    end_id: int = END_ID, chunk: int = CHUNK_TOKENS,
) -> DataFrame:
    """Documents as rows of at most ``chunk`` tokens: the source, the task that read them (part) and the tokens of this source before them in that task (within).

    Ids are unsigned little-endian numbers of two bytes where the vocabulary allows it, else of four.
    """
    bounded_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    ranked = docs.sparkSession.sparkContext.broadcast(word_model(tokenizer_path))  # a vocabulary, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _memo(tokenizer_path, ranked), TaskContext.get().partitionId()
        kind = _id_kind(encoder.tokenizer.get_vocab_size())
        given: defaultdict = defaultdict(int)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(encoder.encode(text) + end, "<u4").astype(kind)
                for at in range(0, len(ids), chunk):
                    some = ids[at : at + chunk]
                    out.append((doc_id, source, part, given[source] + at, at, len(ids), len(some), some.tobytes()))
                given[source] += len(ids)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)
        release(encoder)

    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), text_or_empty(text_col).alias("text"))
    return wanted.mapInArrow(run, _CHUNKS)


def _id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def shares(deficit: np.ndarray, available: np.ndarray, room: int, rates: np.ndarray) -> np.ndarray:
    """Tokens that each queue gives to a window with ``room``: its deficit in whole tokens, the rest by round-robin over the largest deficits left."""
    take = np.clip(np.floor(deficit), 0, available).astype(np.int64)
    if (given := int(take.sum())) > room:
        take = np.floor(take * (room / given)).astype(np.int64)
    while left := room - int(take.sum()):
        spare = available - take
        weight = np.where(spare > 0, rates, 0.0)
        more = np.minimum(np.floor(left * weight / weight.sum()), spare).astype(np.int64) if left > len(take) else 0 * take
        if not more.any():
            behind = np.argsort(np.where(spare > 0, take - deficit, np.inf), kind="stable")[: min(left, int((spare > 0).sum()))]
            more = np.zeros_like(take)
            more[behind] = 1
        take += more
    return take


def window_end(place: int, total: int, capacity: int) -> tuple[int, int, int]:
    """Start, end and number of the sequence that holds token ``place`` of ``total``: full ones, then powers of two."""
    full = total // capacity
    if place < full * capacity:
        number = place // capacity
        return number * capacity, (number + 1) * capacity, number
    start, number, rest = full * capacity, full, total - full * capacity
    while True:
        size = 1 << (rest.bit_length() - 1)
        if place < start + size:
            return start, start + size, number
        start, number, rest = start + size, number + 1, rest - size


def _pack_part(table: pa.Table, plan: Plan, size: int, capacity: int, kind: str) -> pa.RecordBatch:
    """The windows of one part. ``table`` has every chunk that touches it; what lies outside its places is left to other parts."""
    part, total = table["target"][0].as_py(), int(plan.totals.sum())
    first, last = plan.bounds(part, size), plan.bounds(part + 1, size)
    table = table.sort_by([("queue", "ascending"), ("place", "ascending")])
    queues = table["queue"].to_numpy()
    ids, docs = [], []  # per queue: its tokens here, and its documents as (first token here, id, tokens, place in the document)
    for q in range(len(first)):
        parts, known, at = [], [], 0
        for row in table.slice(int(np.searchsorted(queues, q)), int((queues == q).sum())).select(["place", "length", "ids", "doc_id", "doc_tokens", "start"]).to_pylist():
            skip, until = max(int(first[q]) - row["place"], 0), min(row["length"], int(last[q]) - row["place"])
            if until <= skip:
                continue
            if not known or row["start"] == 0:
                known.append((at, row["doc_id"], row["doc_tokens"], row["start"] + skip))
            parts.append(np.frombuffer(row["ids"], kind)[skip:until])
            at += until - skip
        ids.append(np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4"))
        docs.append((known, at))
    here = last - first
    assert [a for _, a in docs] == here.tolist(), "a part has not all of its tokens"
    given, place, doc_at = np.zeros_like(here), int(first.sum()), [0] * len(here)
    stop, out = place + int(here.sum()), []
    while place < stop:
        start, end, number = window_end(place, total, capacity)
        room = min(end, stop) - place
        take = shares(plan.due(place + room) - first - given, here - given, room, plan.rates)
        offset = place - start
        for q in np.flatnonzero(take).tolist():
            at, upto, (known, held) = int(given[q]), int(given[q] + take[q]), docs[q]
            while at < upto:
                i = doc_at[q]
                begins, doc_id, doc_tokens, inside = known[i]
                doc_end = known[i + 1][0] if i + 1 < len(known) else held
                n = min(upto, doc_end) - at
                out.append((doc_id, inside + at - begins, n, zlib.crc32(ids[q][at : at + n]), doc_tokens, number, offset))
                at, offset = at + n, offset + n
                doc_at[q] += at == doc_end
        given += take
        place += room
    columns = zip(*out) if out else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=[c.split()[0] for c in _PACKED.split(", ")])


def queue_beginnings(sums: DataFrame) -> DataFrame:
    """(part, source, queue, base): tokens of the queue before those that ``part`` read of ``source``, from (part, source, queue, tokens)."""
    parts = sums.groupBy("queue", "part").agg(F.sum("tokens").alias("part_tokens"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("queue", "part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("queue", "part").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(parts, ["queue", "part"]).select("part", "source", "queue", (F.col("parts_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base"))


def pack_mixture(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, targets: dict[str, float] | None = None,
    windows: int = WINDOWS_PER_PART, queues: int = QUEUES, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` gives sources their shares of each window; sources that it does not name share what
    it leaves in proportion to their tokens. Without it each source has its share of the corpus, so
    that all queues end together. The ``queues`` largest sources have queues of their own and the
    others share one.

    Defined cases: a null or empty text is a document of just the end mark. A null source counts as
    the empty one. Documents are cut wherever a window ends or the queues take turns; each token is
    in exactly one piece. Repeated rows and rows with a null id are packed each on its own. Targets
    must be positive and sum to at most 1, below 1 if sources are left over. An empty table gives no
    pieces. Other columns are ignored, whatever their names.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = _id_kind(Tokenizer.from_file(tokenizer_path).get_vocab_size())
    chunks = staged(spark, token_chunks(docs, tokenizer_path, id_col, source_col, text_col, end_id), "chunks")
    sums = staged(spark, chunks.groupBy("part", "source").agg(F.sum("length").alias("tokens")), "chunk-sums")
    by_source = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    largest = by_source.orderBy(F.desc("tokens"), "source").limit(queues).collect()
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], _PACKED)
    names, totals = [r.source for r in largest], [r.tokens for r in largest]
    if rest := total - sum(totals):
        totals.append(rest)
    plan = Plan(np.array(totals, np.float64), _rates(names, totals, targets or {}))
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, queue int")
    sums = sums.join(F.broadcast(numbers), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    beginnings = staged(spark, queue_beginnings(sums), "beginnings")
    if beginnings.count() <= broadcast_rows:
        beginnings = F.broadcast(beginnings)
    size = windows * capacity
    place = F.col("base") + F.col("within")
    # a chunk goes to every part that it touches; where rounding is in doubt to one more, which then takes nothing of it
    first = F.floor(plan.packed_at(F.col("place"), F.col("queue")) / size * (1 - 1e-12) - 1e-9)
    last = F.floor(plan.packed_at(F.col("place") + F.col("length"), F.col("queue")) / size * (1 + 1e-12) + 1e-9)
    most = F.lit(-(-total // size) - 1)
    targeted = chunks.join(beginnings, ["part", "source"]).withColumn("place", place).withColumn(
        "target", F.explode(F.sequence(F.greatest(F.lit(0), F.least(first, most)).cast("long"), F.least(last, most).cast("long"))))
    rows = targeted.select("target", "queue", "place", "length", "ids", "doc_id", "doc_tokens", "start")

    def pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_pack_part(table, plan, size, capacity, kind)])

    return rows.groupBy("target").applyInArrow(pack, _PACKED)


def _rates(names: list[str], totals: list[int], targets: dict[str, float]) -> np.ndarray:
    """Target shares per queue; unnamed queues share what ``targets`` leaves by their tokens."""
    named = np.array([targets.get(n, 0.0) for n in names] + [0.0] * (len(totals) - len(names)))
    free = np.where(named > 0, 0.0, np.array(totals, np.float64))
    left = 1.0 - sum(targets.values())
    if any(t <= 0 for t in targets.values()) or left < -1e-9 or (free.any() and left <= 1e-9):
        raise ValueError("targets must be positive and sum to at most 1, below 1 if they leave sources out")
    return named + (left * free / free.sum() if free.any() else 0.0)
