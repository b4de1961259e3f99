import hashlib
import random

import public_tokenizers
import pytest
from tracemill.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def whole(text):
    return bpe.codec(RANKS, public_tokenizers.PATTERN).direct(text)


@pytest.mark.parametrize("alphabet", ["ab 's", "aé \n\t", "x'lLve  \r\n", "日本 1a.", " ", "a", " \xa0\u2003b1!\x1c"])
def test_tree_equals_whole_encoding(alphabet):
    rng = random.Random(7)
    tree = bpe.TreeCodec(RANKS, public_tokenizers.PATTERN, leaf=5, window=2)
    for n in [0, 1, 2, 5, 6, 11, 40, 200, 700]:
        for _ in range(12):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = tree.encode(text)
            assert ids == whole(text)
            assert tree.decode(ids) == text.encode()


def test_chunk_counts_equal_whole_counts():
    rng = random.Random(3)
    counts = token_counts.ChunkCounts(RANKS, public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice("ab' s\n.1é\t\xa0\x1c") if rng.random() < 0.2 else rng.choice("ab' s\n.1é") for _ in range(rng.randrange(40)))
        assert counts.count(text) == len(whole(text))


def test_documents_round_trip(spark):
    long = "word " * 30_000 + "x" * 30_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "Ein kurzer Text.", None), (3, "Ein kurzer Text.", None), (None, "no id", "c"), (4, long, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = sorted(((i, whole(t or ""), (t or "").encode()) for i, t, _ in rows), key=str)
    assert got == want
    assert bpe.decode_documents(bpe.encode_documents(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


EDGES = [(1, None, 5), (2, "", 6), (3, "It's 12 apples", None), (3, "It's 12 apples", None), (None, "no id é", 7), (4, "word " * 50_000 + "x" * 50_000, 8), (5, " \n\t ", 9)]


def test_encoded_lengths_of_every_kind_of_row(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.encoded_lengths(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted(((i, len(whole(t or ""))) for i, t, _ in EDGES), key=str)
    assert token_counts.encoded_lengths(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_of_token_counts_against_counting(spark):
    from tracemill.llm.queries import op4_token_counts

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    known = [len(bpe.codec(path, public_tokenizers.PATTERN).direct(t or "")) for t in texts]
    rows = {r.n_tokens: r for r in op4_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert {n: r.n_docs for n, r in rows.items()} == {n: known.count(n) for n in known}
    assert all(r.truncated_total == sum(min(n, at) for n in known) and r.tokens_total == sum(known) for at, r in rows.items())


def test_query_of_bpe_against_the_library(spark):
    from tracemill.llm.queries import op8_bpe

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in op8_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        ids = whole(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_histogram_answers_every_limit(spark):
    lengths = [0, 3, 3, 7, 600, 601, 5000, 5000, 5000, None]
    frame = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    sums = token_counts.suffix_sums(token_counts.length_histogram(frame))
    known = [n for n in lengths if n is not None]
    rows = {r.n_tokens: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(known))
    for at, r in rows.items():
        assert r.n_docs == known.count(at)
        assert r.docs_longer == sum(n > at for n in known)
        assert r.tokens_up_to == sum(n for n in known if n <= at)
        assert r.tokens_total == sum(known)
        assert r.truncated_total == sum(min(n, at) for n in known)
        assert r.quantile == pytest.approx(sum(n <= at for n in known) / len(known))
    for r in token_counts.totals_for_limits(sums, [1, 3, 512, 600, 99_999]).collect():
        assert r.truncated_total == sum(min(n, r.context_limit) for n in known)
        assert r.docs_longer == sum(n > r.context_limit for n in known)
    assert token_counts.suffix_sums(token_counts.length_histogram(frame.limit(0))).count() == 0
