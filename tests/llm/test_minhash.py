import random

import numpy as np
import pyarrow as pa
import pytest
from tracemill.llm import minhash


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets), key=str)


def corpus(rng, n):
    words = ["w%d" % k for k in range(400)]
    common = [rng.choice(words) for _ in range(40)]
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.6:
            own = list(rng.choice(bases))
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.randrange(3, 90))]
            if rng.random() < 0.5:
                own += common
            bases.append(own)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    return rows


@pytest.mark.parametrize("block", [7, 1024])
def test_groups_against_brute_force(spark, block):
    rng = random.Random(4)
    rows = corpus(rng, 350)
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "one twö"), (1006, "É é"), (1007, "é é"), (None, rows[3][1])]
    base = [f"x{k}" for k in range(60)]
    for i in range(60):  # a large group of near copies, pairwise different
        own = list(base)
        own[i] = "changed"
        rows.append((2000 + i, " ".join(own)))
    rows += [(2000, rows[-60][1])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, digest string").repartition(5)
    got = sorted(map(tuple, minhash.near_duplicates(frame, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)


def test_lanes_of_a_large_group_against_brute_force(spark):
    """A list of many lanes: near copies around one text, some of them linked only through others, and texts that share most of their words."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(120)] = f"c{i}x{rng.randrange(9)}"
        rows.append((5000 - i, " ".join(own)))
    for i in range(60):  # 60 % in common with the group
        rows.append((100 + i, " ".join(base[:72] + [f"d{i}x{k}" for k in range(48)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (4, 16):
        got = sorted(map(tuple, minhash.near_duplicates(frame, block=block).collect()), key=str)
        assert got == brute(rows)


def test_pairs_of_equal_first_coordinates_are_kept():
    """Two signatures whose values agree only in part of their bits at an early coordinate are still compared."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, minhash.COORDINATES, dtype=np.uint64).astype("<u4")
    b = a.copy()
    b[:20] ^= np.uint32(0x00010001)  # equal under a 16-bit fold of high and low half
    table = pa.table({"key": [np.int64((20 << 32) | int(a[20]))] * 2, "lane": [0, 0], "side": [-1, -1], "part": [0, 0], "rep": [1, 2], "n": [50, 50], "mask": np.array([-1, -1]), "sig": [a.tobytes(), b.tobytes()]})
    assert minhash.Lane(table).candidates(0, 75).tolist() == [1]


def test_recall_on_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    sets, lists = {}, {}
    for i, t in rows:
        sets[i] = shingles(t)
        for x in sets[i]:
            lists.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        shared = {}
        for x in own:
            for j in lists[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == sorted(((i, len(s), find(i), find(i) == i) for i, s in sets.items()), key=str)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{k % 9973}" for k in range(150_000))
    frame = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 400_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 102), (7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    seen = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 400, dtype=np.uint64)
        b = np.concatenate([a[:343], rng.integers(0, 2**63, 57, dtype=np.uint64)])  # Jaccard 0.75
        seen.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(seen) - 343 / 457) < 0.03 and min(seen) * 64 >= minhash.LEAST_MATCHES


def test_merged_collisions_against_whole_signatures(monkeypatch):
    """Lists merged and skipped find just the pairs that comparing whole signatures finds, however many entries are merged at once."""
    rng = np.random.default_rng(5)
    for at_once in (50, 1_000_000):
        monkeypatch.setattr(minhash, "MERGED_AT_ONCE", at_once)
        for second in (False, True):
            base = rng.integers(0, 2**32, (6, minhash.COORDINATES)).astype("<u4")
            sig = base[rng.integers(0, 6, 80)]
            change = rng.random(sig.shape) < rng.choice([0.0, 0.1, 0.3, 0.45], (80, 1))
            sig = np.where(change, rng.integers(0, 4, sig.shape), sig).astype("<u4")
            side = rng.integers(0, 3, 80) if second else np.full(80, -1)
            part, rep, n, mask = rng.integers(0, 3, 80), np.sort(rng.choice(1000, 80, False)), rng.integers(80, 100, 80), rng.integers(0, 2**62, 80)
            table = pa.table({"key": [3 << 32] * 80, "lane": [0] * 80, "side": side, "part": part, "rep": rep, "n": n, "mask": mask, "sig": [r.tobytes() for r in sig]})
            want = set()
            for i in range(80):
                for j in range(80):
                    meets = j > i if side[i] < 0 else side[i] == 0 and (side[j] == 1 or (side[j] == 2 and rep[j] > rep[i])) and part[i] != part[j]
                    agree = sig[i] == sig[j]
                    shared = [c for c in range(64) if agree[c] and mask[i] >> c & mask[j] >> c & 1]
                    if meets and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and agree.sum() >= minhash.LEAST_MATCHES and shared and shared[0] == 3:
                        want.add((i, j))
            got = [(int(a), int(b)) for i, j in minhash.Lane(table).collisions(75) for a, b in zip(i, j)]
            assert got == sorted(got) and len(got) == len(set(got)) and set(got) == want and want
