import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from tracemill.llm import periodic
from tracemill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, times=4):
    """Every maximal stretch by trying each period at each place."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                stretch = words[i : j + q]
                if not any(q % p == 0 and stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def random_words(rng):
    """Words of a small alphabet with repeated blocks, repeats of repeats and noise between."""
    words = [rng.choice("abcde") for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(4)):
        block = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (block * rng.randrange(1, 8))[: rng.randrange(1, 60)]
    return words * rng.choice([1, 1, 1, 2, 4, 5])


def test_runs_against_every_period():
    rng, found = random.Random(11), 0
    for _ in range(1500):
        words = random_words(rng)
        want = brute_runs(words)
        assert periodic.word_runs(words) == want
        found += len(want)
    assert found > 2000
    for least, times in ((2, 4), (9, 4), (3, 5), (30, 7)):
        for _ in range(200):
            words = random_words(rng)
            assert periodic.word_runs(words, least, times) == brute_runs(words, least, times)


def test_segments_are_stable():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        codes = np.array([rng.randrange(-1, 9) for _ in range(300)])
        for start, end in periodic.surviving_segments(codes):
            values, counts = np.unique(codes[start:end], return_counts=True)
            assert counts.min() >= 4 and values.min() >= 0 and end - start >= 6


def test_long_repeats_of_long_blocks():
    rng = random.Random(9)
    block = [str(rng.randrange(400)) for _ in range(3001)]
    words = [str(rng.randrange(400)) for _ in range(5000)] + block * 5 + ["x"] * 20_000 + ["y", "z"] * 10_000
    runs = periodic.word_runs(words)
    assert any(q == 3001 and n >= 5 * 3001 and s <= 5000 for s, n, q in runs)
    assert any(q == 1 and n == 20_000 for _, n, q in runs) and any(q == 2 and n == 20_000 for _, n, q in runs)


@pytest.mark.parametrize("plant", [False, True])
def test_documents(spark, plant):
    rng = random.Random(4)
    rows = [(i, " ".join(random_words(rng))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "a " * 9), (3, rows[3][1]), (3, "b b b b b b"), (903, "\x0ba\x1ca a\x85a é é é é é é é\r\n" * 5), (904, "w " * 30_000)]
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, runs int, words string, h int").repartition(3)
    docs = periodic.with_planted_repeats(frame) if plant else frame
    got = [tuple(r) for r in periodic.run_report(periodic.periodic_runs(docs)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(i, t, plant) for i, t in rows), key=str)
    assert periodic.run_report(periodic.periodic_runs(periodic.with_planted_repeats(frame.limit(0)))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op11_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(brute_row(i, t, True) for i, t in docs) and sum(r[1] > 0 for r in rows) > 5
