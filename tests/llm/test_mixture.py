import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tracemill.llm import mixture
from tracemill.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, capacity, windows=None, targets=None, slack=None):
    """Every id of every document in exactly one piece, gapless sequences, full but for powers of two; returns tokens per sequence and source."""
    t = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, source, text in rows:
        ids[i].append((source or "", np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")))
    by_doc, fill, mix = defaultdict(list), {}, defaultdict(Counter)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.length > 0 and r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        by_doc[r.doc_id].append(r)
        mix[r.sequence_id][ids[r.doc_id][0][0]] += r.length
    assert set(by_doc) == set(ids)
    for i, copies in ids.items():
        lengths = sorted(len(x) for _, x in copies)
        assert sum(r.length for r in by_doc[i]) == sum(lengths) and {r.doc_tokens for r in by_doc[i]} == set(lengths)
        if len(copies) == 1:
            at, whole = 0, copies[0][1]
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
                at += r.length
    assert all(n == capacity or n & (n - 1) == 0 for n in fill.values()) and max(fill.values()) <= capacity
    total = sum(fill.values())
    assert len(fill) == total // capacity + bin(total % capacity).count("1")
    return mix, total


def documents(rng, n=300):
    rows = [(i, "s" if i % 3 == 0 else rng.choice("abcdefg"), " ".join(rng.choice(["the", "house", "of", "x1", "Zug"]) for _ in range(rng.randrange(300)))) for i in range(n)]
    rows += [(9000, None, "no source " * 50), (9001, "a", None), (9002, "b", ""), (None, "c", "a b"), (9003, "d", "word " * 9000), (3, rows[3][1], rows[3][2])]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, s, t, 7, "x", 9) for i, s, t in rows], "doc_id long, source string, text string, part int, queue string, place int").repartition(parts)


@pytest.mark.parametrize(("windows", "queues", "rows_sent"), [(1024, 1000, 500_000), (5, 1000, 0), (3, 4, 500_000), (1, 1000, 0)])
def test_documents(spark, windows, queues, rows_sent):
    rows = documents(random.Random(7))
    got = mixture.pack_mixture(frame(spark, rows), PATH, capacity=256, windows=windows, queues=queues, broadcast_rows=rows_sent).collect()
    mix, total = check(rows, got, 256)
    if queues == 1000:
        tokens = Counter()
        for c in mix.values():
            tokens.update(c)
        far, packed = 0.0, Counter()
        for number in sorted(mix):
            packed.update(mix[number])
            done = sum(packed.values())
            far = max([far, *(abs(packed[s] - done * tokens[s] / total) for s in tokens)])
            if done <= total - total % 256:
                assert all(abs(mix[number][s] - 256 * tokens[s] / total) < 4 for s in tokens)
        assert far < 3


@pytest.mark.parametrize("windows", [2, 7])
def test_targets(spark, windows):
    rng = random.Random(8)
    rows = documents(rng)
    targets = {"a": 0.5, "b": 0.3}
    mix, total = check(rows, mixture.pack_mixture(frame(spark, rows), PATH, capacity=512, windows=windows, targets=targets).collect(), 512)
    tokens = Counter()
    for c in mix.values():
        tokens.update(c)
    until = min(tokens["a"] / 0.5, tokens["b"] / 0.3)
    for number in range(int(until // 512) - 1):
        assert abs(mix[number]["a"] - 256) < 4 and abs(mix[number]["b"] - 153.6) < 4
    with pytest.raises(ValueError):
        mixture.pack_mixture(frame(spark, rows), PATH, targets={"a": 1.0})


def test_deficits_are_carried():
    rng = np.random.default_rng(1)
    for _ in range(40):
        totals = rng.integers(1, 5000, rng.integers(1, 9))
        plan = mixture.Plan(totals.astype(float), rng.random(len(totals)) + 0.01)
        given, place, total = np.zeros(len(totals), np.int64), 0, int(totals.sum())
        while place < total:
            room = min(64, total - place)
            take = mixture.shares(plan.due(place + room) - given, totals - given, room, plan.rates)
            assert take.sum() == room and (take >= 0).all()
            given, place = given + take, place + room
            assert (np.abs(given - plan.due(place)) < 2).all() and (given <= totals).all()
        parts = [plan.bounds(p, 100) for p in range(total // 100 + 2)]
        assert all((b >= a).all() for a, b in zip(parts, parts[1:])) and (parts[-1] == totals).all()


def test_window_ends():
    for total in (1, 255, 256, 1023, 1025):
        place, seen = 0, []
        while place < total:
            start, end, number = mixture.window_end(place, total, 256)
            assert start == place and number == len(seen) and all(mixture.window_end(p, total, 256) == (start, end, number) for p in range(start, end))
            seen.append(end - start)
            place = end
        assert sum(seen) == total and all(n == 256 or n & (n - 1) == 0 for n in seen)


def test_empty_table(spark):
    assert mixture.pack_mixture(frame(spark, documents(random.Random(1)), 1).limit(0), PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, QUERIES["op12_mixture_packing"](spark, sf).collect(), 4096)
