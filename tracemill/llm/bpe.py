"""Byte-level BPE by monoid tree reduction over a text.

``encode(text)`` is a monoid: the ids of a whole follow from the ids of its halves and a window
around the cut. A half is encoded recursively, a leaf directly. To join two halves, a window
around the cut grows until each of its ends is an anchor: a place between a visible character
and a blank or line end. The split pattern looks only forward and none of its matches crosses
an anchor, and a match left of an anchor ends there whether the text goes on or not. Therefore
the tokens outside the window are those of the halves, and only the window is encoded again.
A half without an anchor is inside the window as a whole. Decoding concatenates the bytes of
id ranges up a tree in the same way.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

#: Code points that are encoded at once, and the window with which a join begins.
LEAF_CHARS = 4096
WINDOW_CHARS = 64
LEAF_IDS = 8192

_ANCHOR = re.compile(r"(?<=\S)(?=[ \n])")


class TreeCodec:
    """Encoder and decoder over a file of ranks (base64 token and rank on each line)."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.leaf, self.window = max(2, leaf), max(1, window)
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.direct, self.bytes_of = encoding.encode_ordinary, encoding.decode_bytes

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def _node(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf:
            return self.direct(text[start:end])
        cut = (start + end) // 2
        return self._join(text, start, cut, end, self._node(text, start, cut), self._node(text, cut, end))

    def _join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        size, low, high = self.window, None, None
        while low is None or high is None:
            if low is None:
                # one character more, so that an anchor at the window's first place is seen as one
                found = [m.start() for m in _ANCHOR.finditer(text, max(start, cut - size - 1), cut) if start < m.start() < cut]
                low = found[-1] if found else start if cut - size <= start else None
            if high is None:
                found = _ANCHOR.search(text, cut + 1, min(end, cut + size + 1))
                high = found.start() if found and found.start() < end else end if cut + size >= end else None
            size *= 4
        kept = len(left) - len(self.direct(text[low:cut]))
        skipped = len(self.direct(text[cut:high]))
        return left[:kept] + self.direct(text[low:high]) + right[skipped:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return self.bytes_of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """One codec per Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TreeCodec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids.

    Defined cases: a null or empty text has no ids. Very long texts and texts without any blank
    are encoded whole. Repeated rows and null ids stay; equal texts have equal ids. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode
        for batch in batches:
            # a few megabytes of ids at a time: a row's ids take about as much room as its text
            texts, done = batch.column(1), 0
            while done < batch.num_rows:
                lists, held = [], 0
                for i in range(done, batch.num_rows):
                    lists.append(np.array(encode(texts[i].as_py()), np.int32))
                    held += len(lists[-1])
                    if held > 2_000_000:
                        break
                offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                values = pa.array(np.concatenate(lists))
                part = batch.column(0).slice(done, len(lists))
                done += len(lists)
                yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) with the decoded bytes added: doc_id, ids, decoded.

    Defined cases: no ids decode to no bytes. Repeated rows and null ids stay. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    bounded_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, pattern).decode
        for batch in batches:
            decoded = [decode(ids.values.to_pylist()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
