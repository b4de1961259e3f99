import numpy as np
import pytest
from tracemill.llm import toxicity

CORPUS = ["the loser is an idiot and a moron", "this is the day of the house and it is a good day", "an idiot is a loser", "no one is here 1 2 3"] * 30


@pytest.fixture(scope="module")
def restorer(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id long, text string").repartition(3)
    return toxicity.Restorer(toxicity.character_model(toxicity.trigram_counts(docs)))


def test_trigram_counts_against_brute_force(spark):
    texts = ["Ab  aé!", "", None, "日本 b", "a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.code: r.n for r in toxicity.trigram_counts(docs).collect()}
    want = {}
    code = lambda c: 60 if ord(c) > 0x2FF and c.isalpha() else int(toxicity._TABLE[ord(c)]) if ord(c) < 0x300 else 0
    for t in texts:
        s = [0, 0]
        for c in [*map(code, t or ""), 0]:
            if c or s[-1]:
                s.append(c)
        for a, b, c in zip(s, s[1:], s[2:]):
            k = (a * 61 + b) * 61 + c
            want[k] = want.get(k, 0) + 1
    assert got == want


@pytest.mark.parametrize("disguised, plain", [
    ("an 1d10t here", "idiot"), ("L0SER", "loser"), ("an i d i o t is", "idiot"), ("a m-o-r-o-n.", "moron"), ("you idiooooot", "idiot"), ("l0-s-3-r", "l"), ("lo$3r!", "loser"), ("LOSER!!", "loser"), ("idiot!", "idiot"), ("|moron|", "moron"),
])
def test_restores_disguised_words(restorer, disguised, plain):
    assert plain in toxicity._WORD.findall(restorer.restore(disguised).lower()) or plain == "l"


@pytest.mark.parametrize("text", ["", "a", "the day of the house", "call 555 1234 now", "a b", "This is it. No, it is a day.", "x" * 2])
def test_leaves_plain_text(restorer, text):
    assert restorer.restore(text) == text


def test_viterbi_against_every_path(restorer):
    """The reading found costs no more than any reading of the lattice."""
    logs = np.array(restorer.logs)

    def readings(span):
        paths = [(0.0, "", 0, 0)]
        for at, c in enumerate(span):
            symbol = int(toxicity._symbols(np.array([ord(c)], np.uint32))[0])
            options = [(0.0, c.lower(), symbol)] if symbol else [(toxicity.literal_costs(span)[at], " ", 0)]
            options += [(toxicity.SUBSTITUTED, x, ord(x) - 96) for x in toxicity.LOOKALIKES.get(c, "")]
            if c in toxicity.SEPARATORS or (symbol and at and span[at - 1] == c and (span[at - 2 : at - 1] == c or span[at + 1 : at + 2] == c)):
                options.append((toxicity.SPACED if c in toxicity.SEPARATORS else toxicity.REPEATED, "", None))
            paths = [
                (p + cost, t, a, b) if s is None or (s == 0 and b == 0) else (p + cost + logs[a][b][s], t + x, b, s)
                for p, t, a, b in paths for cost, x, s in options
            ]
        return max((p + (logs[a][b][0] if b else 0), t) for p, t, a, b in paths)[1]

    for span in ("1d10t", "i d i o t", "iddd1", "l0-5e", "1 1 1", "aaa"):
        assert restorer[span] == readings(span)


def test_long_spans_are_read_whole(restorer):
    """What is committed on the way does not change the reading, and no word is lost at a cut."""
    spans = ["1d10t" * 60, "i d i o t " * 40 + "m", "x" * 700 + "1d10t", "l0s3r-m0r0n_" * 50, "1" * 500, "a1" * 300]
    long = {span: restorer._read(span) for span in spans}
    was, toxicity.COMMIT_CHARS = toxicity.COMMIT_CHARS, 10**9
    try:
        assert long == {span: restorer._read(span) for span in spans}
    finally:
        toxicity.COMMIT_CHARS = was
    for shift in range(70, 90):  # a word at every place around the length of a remembered span
        assert "moron" in restorer.restore("z" * shift + " " + "m 0 r 0 n" + " z")
    assert len(restorer.restore("1!" * 100_000)) > 0


def test_weights_against_dense_newton_steps():
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(12, rng.integers(0, 5), replace=False).tolist()) for _ in range(300)]
    toxic = [int(0 in r or rng.random() < 0.1) for r in rows]
    x = np.zeros((300, 13))
    x[:, 12] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    w, penalty = np.zeros(13), np.array([0.1] * 12 + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (np.array(toxic) - p) - penalty * w)
    assert np.allclose(toxicity._fit(rows, toxic, 12), w, atol=1e-4)


def test_scores_and_edges(spark):
    rows = [(i, ("the moron is here" if i % 3 == 0 else "the day is here") + f" {i}") for i in range(300)]
    docs = spark.createDataFrame([(i, t, 0.1, "s") for i, t in rows], "doc_id long, text string, score double, toxic string")
    clash = spark.createDataFrame([(1, "the moron is here", 0.5, 7)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (5, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, lambda c: labels[c] % 5 != 0)
    extra = [(1000, None), (1001, ""), (1002, "a m0r0n"), (1002, "a m0r0n"), (None, "moron"), (1003, "day " * 40_000 + "m o r o n")]
    got = toxicity.score(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(extra)
    assert all(by[i].predicted == int(i % 3 == 0) for i in range(300))
    assert by[1000].score == by[1001].score < 0.5 and by[1002].predicted == by[1003].predicted == by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert [(r.doc_id, r.predicted) for r in toxicity.score(clash, model).collect()] == [(1, 1)]
    assert toxicity.reject_toxic(clash, model).columns == clash.columns and not toxicity.reject_toxic(clash, model).count()
    none = toxicity.train(docs, labels.limit(0), lambda c: labels[c].isNotNull())
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_labels(spark):
    from tracemill.llm.queries import op2_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    r = op2_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").toPandas()
    assert (r.predicted == r.toxic).mean() > 0.98
    assert r.predicted[r.toxic == 1].mean() > 0.85  # recall; words garbled away are missed
