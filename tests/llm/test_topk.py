import random
from fractions import Fraction
from math import floor

import numpy as np

from tracemill.llm import topk
from tracemill.llm.topk import SlicedBlock, order_key, top_k


def brute(rows, is_query, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if is_query(q):
            hits = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def test_block_orders_rows_like_inner_products():
    rng = np.random.default_rng(0)
    for rows, dims, reach in ((1, 3, 5), (64, 1, 1), (130, 7, 300), (200, 4, 2), (70, 0, 1)):
        values = rng.integers(-reach, reach + 1, (rows, dims))
        block = SlicedBlock(values)
        for _ in range(20):
            q = rng.integers(-reach, reach + 1, dims)
            want = sorted(range(rows), key=lambda i: (-int(values[i] @ q), i))[:5]
            assert sorted(block.top(q, 5, block.all).tolist()) == sorted(want)


def test_top_k_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.1, 0.25]) + rng.random() * 0.01 * (i % 3) for _ in range(6)]) for i in range(700)]
    rows += [(900, None), (950, [None] * 6), (1000, [float("nan")] * 6), (1050, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (1100, []), (1150, []), (1201, [1.0, 2.0]), (1200, [0.5, -1.0]), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    got = sorted(map(tuple, top_k(frame, lambda c: c % 50 == 0, block_rows=100, block_queries=4).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(rows, lambda i: i % 50 == 0)
    few = top_k(frame.filter("vec_id < 3"), lambda c: c % 50 == 0)
    assert few.count() == 2
    assert top_k(frame.limit(0), lambda c: c % 50 == 0).count() == 0


def test_components_of_any_size(spark):
    rng = random.Random(9)
    sizes = [1.0, 5000.0, -5000.0, 3e9, -7.5e17, 1e300, -1.7e308, 5e-324, 0.0]
    rows = [(i, [rng.choice(sizes) * rng.choice([1.0, 0.5, 1.0]) if i % 4 == 0 else rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    exact = {i: [floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for q in range(0, 300, 50):
        hits = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:5]
        want += [(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(hits)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, top_k(frame, lambda c: c % 50 == 0, block_rows=64, block_queries=3).collect()))
    assert got == sorted(want)


def test_order_of_keys():
    scores = sorted({s * 2**e + d for s in (-1, 1) for e in (0, 7, 8, 63, 64, 900) for d in (-1, 0, 1)} | {0})
    assert sorted(scores, key=order_key) == scores


def test_vectors_are_not_broadcast(spark):
    # blocks of queries, once per lane of index blocks, were broadcast through the driver
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0, -0.5]) for i in range(400)], "vec_id long, embedding array<float>").repartition(4)
    lines = top_k(frame, lambda c: c % 50 == 0, block_rows=20)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((i for i in range(n + 1, len(lines)) if depth(lines[i]) <= depth(line)), len(lines))
            assert "payload" not in "".join(lines[n:below])


def test_lanes_of_many_blocks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "LANES", 2)
    monkeypatch.setattr(topk, "BROADCAST_DIMS", 1)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(1 + i % 3)]) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, top_k(frame, lambda c: c % 25 == 0, block_rows=40, block_queries=2).collect()))
    assert got == brute(rows, lambda i: i % 25 == 0)
