"""Best-fit packing of tokenised documents into fixed-size sequences by sum of squares.

Tokenising: a text is cut at ASCII white space, across which the tokenizer never merges, and
each distinct chunk is encoded once per task and then looked up.

Packing: a document (plus its end mark) longer than a sequence is cut into pieces; pieces are
dealt evenly to partitions, repeated ones too, and each partition packs its own share. There
the state is the number of open sequences per residual gap; every piece goes where the sum of
the squared counts becomes smallest. The state is bounded by the sequence length, partitions
never exchange sequences, and a rerun of a lost partition gives the same packing, as Spark sorts
rows before it deals them out.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release, staged, text_or_empty

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Pieces that one task packs; bounds its memory and its share of unfilled sequences.
PIECES_PER_TASK = 40_000
#: Distinct chunks that a task remembers before it starts afresh.
MEMO_CHUNKS = 500_000

_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: What Python splits at and the tokenizer does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Latin words with at most one mark behind them: lower-casing and composition are plain there,
#: and the tokenizer always cuts between the word and the mark.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([,.]?)")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level models: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Stands for the end of a word in byte form; no UTF-8 text has this byte.
_WORD_END = b"\xff"


def word_model(path: str):
    """The tokenizer's word model in the form of byte ranks, or None where that is not the same.

    A word is its bytes and the end byte. The end byte joins the last byte before any merge
    (those pairs rank first), then merges apply by rank. The rank form allows any two tokens
    whose join is a token, the pair form only the listed pair; the two are the same exactly if
    every token, built from its own bytes, is reached through its listed pair, which is checked.
    Returns (ranks, id of each rank).
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
        return None
    back = {c: b for b, c in _byte_alphabet().items()}

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(back[c] for c in (token[:-4] if end else token)) + _WORD_END * end

    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _WORD_END: 256 + b for b in range(256)}
    pairs = {}
    try:
        for pair in model["merges"]:
            x, y = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            ranks[x + y], pairs[x + y] = 256 * 2 + len(pairs), (x, y)
        ids = {ranks[raw(t)]: i for t, i in model["vocab"].items() if not t.startswith("<|")}
    except KeyError:
        return None
    for token, pair in pairs.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        if parts[-1] == _WORD_END:
            parts[-2:] = [parts[-2] + _WORD_END]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) + 256))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if tuple(parts) != pair:
            return None
    size = max(ranks.values()) + 1
    return ranks, np.array([ids.get(r, -1) for r in range(size)], dtype="<i8").astype("<u4")


class ChunkMemo(dict):
    """Chunk to its ids as little-endian unsigned 32-bit bytes; encodes what it has not seen.

    A plain Latin word goes straight to the word model, lower-cased; everything else through
    the tokenizer's whole pipeline.
    """

    def __init__(self, path: str, ranked=None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = _byte_alphabet()
        self.ids = None
        if ranked:
            ranks, ids = ranked
            self.ids = [i.tobytes() for i in ids]
            self.ranked = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            self.pieces = self.ranked._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        plain = _WORD.fullmatch(chunk)
        if not plain:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        elif plain[2] or not chunk.islower():
            out = self[chunk] = self[plain[1].lower()] + (self[plain[2]] if plain[2] else b"")
            return out
        elif self.ids is not None:
            ids = self.ids
            out = self[chunk] = b"".join([ids[rank] for rank in self.pieces(chunk.encode() + _WORD_END)])
            return out
        else:
            letters = chunk.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.tokenizer.model.tokenize(letters)]
        out = self[chunk] = np.asarray(ids, dtype="<u4").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        chunks = _SPACE.split(text) if any(c in text for c in _NOT_SPACE) else text.split()
        out = b"".join(map(self.__getitem__, chunks))
        if len(self) > MEMO_CHUNKS:
            self.clear()
        return out


_MEMOS: dict[str, ChunkMemo] = {}


def _memo(path: str, ranked) -> ChunkMemo:
    """One encoder per Python worker; what it remembers lasts for a task."""
    if path not in _MEMOS:
        _MEMOS[path] = ChunkMemo(path, ranked.value)
    return _MEMOS[path]


def tokenised_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    bounded_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    ranked = docs.sparkSession.sparkContext.broadcast(word_model(tokenizer_path))  # a vocabulary, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _memo(tokenizer_path, ranked)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))
        release(encoder)

    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return wanted.mapInArrow(run, _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each length, in the given order.

    ``counts[g]`` is the number of open sequences with residual gap ``g``. Putting a piece of
    length s into gap g changes the sum of squares by ``(1 - 2 counts[g]) + (1 + 2 counts[g-s])``
    (the second part only if the sequence stays open); a new sequence is the gap ``capacity``
    with nothing to give up. Ties go to the smallest gap.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        cost = 1 - 2 * counts[s:]
        cost[1:] += 1 + 2 * counts[1 : capacity - s + 1]
        cost[counts[s:] == 0] = never
        cost[-1] = 0 if s == capacity else 1 + 2 * counts[capacity - s]
        gap = s + int(np.argmin(cost))
        if gap == capacity:
            bin_id = len(used)
            used.append(0)
        else:
            bin_id = open_at[gap].pop()
            counts[gap] -= 1
        where[i], offset[i] = bin_id, used[bin_id]
        used[bin_id] += s
        if gap > s:
            counts[gap - s] += 1
            open_at[gap - s].append(bin_id)
    return where, offset


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ids_crc32).

    Repeated rows and rows with a null id are packed each on its own; no rows give none.
    """
    tasks = max(1, -(-pieces.count() // per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    return pieces.repartition(tasks).mapInArrow(run, _PACKED)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is a document of just the end mark. Only documents
    longer than ``capacity`` are cut. Repeated rows are packed each on its own. Rows with a
    null id are packed like others. An empty table gives no pieces. Other columns are ignored.
    """
    pieces = staged(docs.sparkSession, tokenised_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity)
