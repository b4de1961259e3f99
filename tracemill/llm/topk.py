"""Exact top-k inner products through a bit-sliced index.

Vectors are quantised to integers and indexed in blocks of rows: for each component the offsets
from the block's minimum are kept as bit slices, one bitmap over the block's rows per bit. A
query adds up slices with bitmap arithmetic only: bit i of the query's component and slice j
meet at weight i + j (complemented slices stand for negative components), and carry-save adders
reduce each weight to one bitmap. The sum's own slices then give the best rows, read from the
most significant slice downward: rows are taken while fewer than k are certain, and the rows
tied at the boundary are settled exactly, by id. Each block yields k rows per query; these are
merged at the end. Vectors whose products could pass 64 bits have small blocks of their own, with
integers of any size.

The stated queries meet the rows in blocks: row blocks are dealt to lanes, and query blocks go to
each lane of their length. A task gets the row blocks of a lane once, holds them, and query blocks
pass by one at a time; nothing but the list of lanes goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged

#: Rows of an index block, of one with large components, and of a query block.
BLOCK_ROWS, LARGE_ROWS, BLOCK_QUERIES = 16_384, 512, 128
#: Lanes that index blocks are dealt to, by lengths of vectors up to which the list of lanes is broadcast.
LANES, BROADCAST_DIMS = 4096, 1000


def narrow_limit(dim: int) -> int:
    """Largest absolute component for which inner products of ``dim`` components stay within 62 bits."""
    return math.isqrt(2**62 // max(dim, 1))


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or integers of any size where a component is past ``narrow_limit``."""
    q = np.floor(vectors * scale)
    if not q.size or np.abs(q).max() <= narrow_limit(vectors.shape[1]):
        return q.astype("<i8")
    exact = [[math.floor(Fraction(x) * scale) for x in row] for row in vectors.tolist()]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def inner(values: np.ndarray, query: np.ndarray) -> list[int]:
    if values.dtype == object or query.dtype == object:
        values, query = values.astype(object), query.astype(object)
    return (values @ query).tolist() if len(values) else []


def order_key(score: int) -> bytes:
    """Bytes that are ordered as the scores are, whatever their size."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - b for b in body)


#: Ends of the range that a score is reported in.
_LEAST, _MOST = -(2**63), 2**63 - 1


class SlicedBlock:
    """Index over an integer matrix [rows, components], whose rows are in order of their ids."""

    def __init__(self, values: np.ndarray):
        self.values, (self.rows, dims) = values, values.shape
        self.low = values.min(axis=0) if dims else np.zeros(0, np.int64)
        offsets = values - self.low
        widths = [int(w).bit_length() for w in (offsets.max(axis=0) if dims else [])]
        self.words = -(-self.rows // 64)
        slices = np.zeros((sum(widths), self.words * 8), np.uint8)
        self.of: list[range] = []
        at = 0
        for d, width in enumerate(widths):
            self.of.append(range(at, at + width))
            for j in range(width):
                packed = np.packbits(((offsets[:, d] >> j) & 1).astype(np.uint8), bitorder="little")
                slices[at + j, : len(packed)] = packed
            at += width
        self.slices = np.concatenate([slices, ~slices]).view("<u8")
        self.all = self._bitmap(np.ones(self.rows, np.uint8))

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def sum_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of a number that orders the rows as their inner products with ``query`` do."""
        at_weight: dict[int, list[int]] = {}
        flip = len(self.slices) // 2
        for d, q in enumerate(query.tolist()):
            shift = flip if q < 0 else 0
            q, i = abs(q), 0
            while q >> i:
                if q >> i & 1:
                    for j, row in enumerate(self.of[d]):
                        at_weight.setdefault(i + j, []).append(row + shift)
                i += 1
        out, carries, weight = [], [], 0
        while carries or any(w >= weight for w in at_weight):
            own = self.slices[at_weight[weight]] if weight in at_weight else np.zeros((0, self.words), "<u8")
            stack, carries = np.concatenate([own, *carries]), []
            while len(stack) > 2:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                x = a ^ b
                carries.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * third :]])
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(self.words, "<u8"))
            weight += 1
        return out

    def top(self, query: np.ndarray, k: int, out_of: np.ndarray) -> np.ndarray:
        """Positions of the k best rows among the bitmap ``out_of``; ties go to the first rows."""
        sure, tied = np.zeros(self.words, "<u8"), out_of & self.all
        for s in reversed(self.sum_slices(query)):
            ahead = sure | (tied & s)
            if int(np.bitwise_count(ahead).sum()) > k:
                tied = tied & s
            else:
                sure, tied = ahead, tied & ~s
        chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        return np.concatenate([chosen, rest[: k - len(chosen)]])


def _whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.size(v).alias("dim"), v.alias("v"))


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows packed into blocks of up to ``size``: dim, block, n, ids (64-bit integers), payload (the vectors as doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        made = 0

        def block(kind: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal made
            ids, values = (np.concatenate(x) for x in zip(*held.pop(kind)))
            order = np.argsort(ids, kind="stable")
            made += 1
            name = (TaskContext.get().partitionId() << 32) + made
            data = [[kind[0]], [name], [len(ids)], [ids[order].tobytes()], [values[order].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["dim", "block", "n", "ids", "payload"])

        for batch in batches:
            dims = batch.column(1).to_numpy()
            if batch.num_rows and dims.min() == dims.max():
                parts = [(int(dims[0]), batch)]
            else:
                parts = [(int(d), batch.filter(pa.array(dims == d))) for d in np.unique(dims)]
            for dim, part in parts:
                ids = part.column(0).to_numpy().astype("<i8")
                values = part.column(2).flatten().to_numpy().astype("<f8").reshape(len(ids), dim)
                large = np.abs(values).max(axis=1, initial=0.0) > narrow_limit(dim) / scale - 1
                for is_large, most in ((False, size), (True, min(size, LARGE_ROWS))):
                    at = np.flatnonzero(large == is_large)
                    for one in range(0, len(at), most):
                        own = at[one : one + most]
                        held.setdefault((dim, is_large), []).append((ids[own], values[own]))
                        if sum(len(x) for x, _ in held[dim, is_large]) >= most:
                            yield block((dim, is_large))
        for kind in list(held):
            yield block(kind)

    return rows.mapInArrow(run, "dim int, block long, n long, ids binary, payload binary")


def _best(index: SlicedBlock, names: np.ndarray, q_block: int, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of an index block, whose rows have these names, for each query of a block."""
    found: list[tuple[int, int, int, bytes, int]] = []
    for n, (query_id, query) in enumerate(zip(query_ids.tolist(), queries)):
        others = index.all.copy()
        for own in range(*np.searchsorted(names, [query_id, query_id + 1]).tolist()):
            others[own >> 6] &= ~np.uint64(1 << (own & 63))
        best = index.top(query, k, others)
        scores = inner(index.values[best], query)
        found += [(q_block + (n << 48), query_id, v, order_key(s), min(max(s, _LEAST), _MOST)) for v, s in zip(names[best].tolist(), scores)]
    columns = list(zip(*found)) if found else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["q", "query_id", "vec_id", "order", "score"])


def top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """For each row where ``is_query`` (a condition on vec_id): query_id, rank, vec_id, score.

    Components count as floor(scale * x), exactly, whatever their size. The score is the integer inner
    product; the k highest are returned (all, if fewer), ties to the smaller vec_id. Ranks go by
    exact scores; a score past 64 bits is reported as the nearest 64-bit integer. Rows with the
    query's id are its own and not candidates.

    Defined cases: vectors that are null, or hold a null or non-finite component, and rows with a
    null id take no part. Vectors are compared with those of equal length only. Rows that repeat
    a candidate's id are candidates each; rows that repeat a query's id are one query each, over
    the same candidates, and share ranks only if their vectors differ in score. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = _whole(vectors, id_col, vector_col)
    index = staged(spark, _blocks(rows, block_rows, scale), "topk-index")
    queries = staged(spark, _blocks(rows.filter(is_query(F.col("vec_id"))), block_queries, scale), "topk-queries")
    lane = F.pmod(F.hash("block"), F.lit(LANES))
    lanes = index.groupBy("dim").agg(F.collect_set(lane).alias("lanes"))
    dims, tasks = lanes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("lanes")), F.lit(0))).first()
    # in a lane the index blocks come first, then the query blocks that meet them
    own = index.select("dim", lane.alias("lane"), F.lit(0).alias("side"), "block", "ids", "payload")
    meeting = queries.join(F.broadcast(lanes) if dims <= BROADCAST_DIMS else lanes.hint("merge"), "dim")
    meeting = meeting.select("dim", F.explode("lanes").alias("lane"), F.lit(1).alias("side"), "block", "ids", "payload")
    lined = own.unionByName(meeting).repartition(max(1, min(2 * tasks, LANES)), "dim", "lane").sortWithinPartitions("dim", "lane", "side", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[tuple[SlicedBlock, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                dim, lane, side, q_block, ids, payload = (c[i].as_py() for c in batch.columns)
                if at != (dim, lane):
                    at, held = (dim, lane), []
                names = np.frombuffer(ids, "<i8")
                values = quantise(np.frombuffer(payload, "<f8").reshape(len(names), dim), scale)
                if not side:
                    held.append((SlicedBlock(values), names))
                for index_block, own_names in held if side else ():
                    yield _best(index_block, own_names, q_block, names, values, k)

    hits = lined.mapInArrow(run, "q long, query_id long, vec_id long, `order` binary, score long")
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("order"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
