import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from tracemill.llm import spelling
from tracemill.llm.queries import QUERIES, misspelt

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, plant=True):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if plant and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(counts):
    near = {w: [] for w in counts}
    shapes = {}
    for w in counts:  # words one apart share the word or the word without some letter
        for shape in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + "*" + w[i + 1 :] for i in range(len(w))}:
            shapes.setdefault(shape, []).append(w)
    for words in shapes.values():
        for a, b in itertools.permutations(words, 2):
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(set(others), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(set(near[w])), counts[form[w]] if form[w] else None))
    return sorted(rows)


def vocabulary(rng):
    """Dense words: few letters, so that many are one apart, with chains of ever more frequent ones."""
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))): rng.randrange(5, 60) for _ in range(700)}
    words |= {"common" + x: 5 for x in ("", "a", "b")} | {"aaaaaa": 10**6, "aaaaaaa": 10**5, "aaaaaaaa": 10**4, "aaaaaaab": 900, "zzzzzzz": 7, "ababab": 10, "bababa": 10}
    return words


@pytest.mark.parametrize("hot", [2000, 3])
def test_variants_against_brute_force(spark, hot):
    for seed in (1, 2):
        words = vocabulary(random.Random(seed))
        frame = spark.createDataFrame([(w, n, 1, "x") for w, n in words.items()], "word string, n long, root int, form string").repartition(3)
        got = sorted(tuple(r) for r in spelling.spelling_variants(frame, hot=hot).select("word", "form", "root", "n", "n_near", "form_n").collect())
        assert got == brute(words)
        assert sum(r[1] is not None for r in got) > 20 and any(r[1] not in (None, r[2]) for r in got)


def test_order_of_bigrams_does_not_matter(spark, monkeypatch):
    words = vocabulary(random.Random(3))
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "BIGRAMS", 2)
    got = sorted(tuple(r) for r in spelling.spelling_variants(frame).collect())
    assert got == brute(words)


def test_pivots_against_all_pairs():
    rng = random.Random(4)
    for _ in range(500):
        size = rng.randrange(3, 7)
        grams = [(rng.choice("abcd"), i) for i in sorted(rng.sample(range(9), size))]
        disjoint = [(max(x[0], y[0]), min(x[0], y[0]), x[1], y[1]) for x, y in itertools.combinations(grams, 2) if y[1] - x[1] >= 2]
        if disjoint:
            first, second = spelling.pivots(grams)
            cost = dict((i, o) for o, i in grams)
            assert second - first >= 2 and tuple(sorted((cost[first], cost[second]), reverse=True)) == min(d[:2] for d in disjoint)


def test_counts(spark):
    rng = random.Random(6)
    alphabet = ["Öffnen", "öffnen", "HOUSEs", "housés", "straße", "naïveté", "x" * 40, "tiny", "a×b÷cde", "ÀÉÎõüÿ", "Ŝtrange", "日本語日本語"]
    rows = [(i, rng.choice([" ", "-", " ", "1", "_"]).join(rng.choice(alphabet) for _ in range(rng.randrange(30)))) for i in range(400)]
    rows += [(None, "öffnen öffnen"), (900, None), (901, ""), (7, rows[7][1]), (902, "Repeated " * 20_000)]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    assert {r.word: r.n for r in spelling.count_words(frame, edit=misspelt).collect()} == brute_counts(rows)
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == brute_counts(rows, plant=False)
    assert spelling.spelling_variants(spelling.count_words(frame.limit(0))).count() == 0


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("abc", 9)], "word string, n long"))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute(brute_counts(rows))


def test_odd_counts(spark):
    """Repeated words, null words and null counts, and words far longer than any other."""
    long = "ab" * 5000
    rows = [("common", 30), ("common", 20), (None, 9), ("comnon", 10), ("comnon", None), (long, 7), (long + "c", 70), ("lonely", None)]
    got = sorted(tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect())
    want = {"common": 50, "comnon": 10, long: 7, long + "c": 70, "lonely": 0}
    assert got == brute(want)
