import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tracemill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def naive(lengths, capacity):
    """Sum of squares by trying every open gap and a new sequence."""
    bins, out = [], []
    for s in lengths:
        gaps = sorted({capacity - u for u in bins if u + s <= capacity and u < capacity} | {capacity})

        def squares(gap):
            counts = {}
            for u in bins:
                if u < capacity:
                    counts[capacity - u] = counts.get(capacity - u, 0) + 1
            if gap < capacity:
                counts[gap] -= 1
            if gap > s:
                counts[gap - s] = counts.get(gap - s, 0) + 1
            return sum(c * c for c in counts.values())

        gap = min(gaps, key=lambda g: (squares(g), g))
        if gap == capacity:
            bins.append(0)
            at = len(bins) - 1
        else:
            at = max(i for i, u in enumerate(bins) if capacity - u == gap)
        out.append(gap)
        bins[at] += s
    return out, bins


def test_sum_of_squares_against_trying_every_gap():
    rng = random.Random(2)
    for capacity in (10, 37):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(150)]
        where, offset = packing.sum_of_squares(np.array(lengths), capacity)
        gaps, bins = naive(lengths, capacity)
        assert [capacity - o for o in offset.tolist()] == gaps
        assert sorted(np.bincount(where, weights=lengths).tolist()) == sorted(bins)


def test_word_model_is_the_tokenizers():
    ranked = packing.word_model(PATH)
    assert ranked
    memo, plain = packing.ChunkMemo(PATH, ranked), packing.ChunkMemo(PATH)
    t = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéäßñ") for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts = words + ["Ab, c.", "İ ΑΣ", "don't I'LL", "\x1ca\x85b", "日本 語", "é", "x" * 5000, "", " ", "a.b,,c", "ÀÉ,"]
    for x in texts:
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(memo.encode(x), "<u4").tolist() == want
        assert np.frombuffer(plain.encode(x), "<u4").tolist() == want


@pytest.mark.parametrize("per_task", [50, 10_000])
def test_documents(spark, per_task):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "house", "of", "x1", "Zug"]) for _ in range(rng.randrange(200)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "a b"), (3, rows[3][1]), (502, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, piece int, length int")
    pieces = packing.tokenised_pieces(docs, PATH, capacity=256)
    got = packing.pack_pieces(pieces, 256, per_task).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    least = sum(fill.values()) / 256
    assert max(fill.values()) <= 256 and len(fill) <= least * 1.1 + 3 * (1 + len(got) // per_task)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
