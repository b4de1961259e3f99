import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tracemill.llm.exact_dedup import IGNORED, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in IGNORED), []).append((i, len(t or "")))
    out = []
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in IGNORED)
        keep = min(groups[norm], key=lambda r: (-r[1], r[0] is None, r[0] or 0))[0]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_against_brute_force(spark, digest):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab \n\t\x0b") for _ in range(rng.randrange(6)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "zz"), (1002, "z z"), (None, "q"), (-(2**63), "é"), (2**63 - 1, "é "), (5, rows[5][1]), (1003, "x y"), (1004, "xy"), (1005, "long " * 50_000), (1006, "long" * 50_000)]
    frame = spark.createDataFrame([(i, t, 1, True, "s") for i, t in rows], "doc_id long, text string, salt int, kept boolean, norm string").repartition(6)
    got = sorted(map(tuple, exact_dedup(frame, digest=digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
