import math
import random
import re
from collections import Counter

import pytest
from tracemill.llm import langid

TRAIN = [("en", "the cat and the dog and the house"), ("de", "der hund und die katze und das haus"), (None, "the the"), ("de", None), ("en", "")]


def brute(train, texts):
    """(best language, share) of each text by plain counting."""
    langs = sorted({x for x, _ in train if x is not None})
    words = {x: Counter(w for lang, t in train if lang == x for w in re.findall(r"[^\W\d_]+", (t or "").lower())) for x in langs}
    grams = {x: Counter(m[i : i + size] for w in words[x] for m in [f"^{w}$"] for size in range(1, 5) for i in range(len(m) - size + 1)) for x in langs}
    totals = {(x, size): sum(n for g, n in grams[x].items() if len(g) == size) or 1 for x in langs for size in range(1, 5)}
    out = []
    for text in texts:
        own = re.findall(r"[^\W\d_]+", (text or "").lower())
        sums, parts = {x: 0.0 for x in langs}, 0
        for w in own:
            if any(w in words[x] for x in langs):
                parts += 1
                for x in langs:
                    sums[x] += math.log((words[x][w] or 0.5) / (words[x].total() or 1))
                continue
            at, marked = 0, f"^{w}$"
            while at < len(marked):
                size = next((s for s in (4, 3, 2, 1) if at + s <= len(marked) and any(marked[at : at + s] in grams[x] for x in langs)), 0)
                parts += 1
                for x in langs:
                    sums[x] += math.log((grams[x][marked[at : at + size]] if size else 0) / totals[x, size]) if size and grams[x][marked[at : at + size]] else math.log(0.5 / totals[x, max(size, 1)])
                at += size or 1
        if not own or not any(c.isalpha() for w in own for c in w):
            out.append(("und", 0.0))
            continue
        best = max(sums.values())
        out.append((min(x for x in langs if math.isclose(sums[x], best, rel_tol=1e-12)), 1 / sum(math.exp((s - best) / math.sqrt(parts)) for s in sums.values())))
    return out


@pytest.mark.parametrize("word_cells, gram_cells", [(langid.WORD_CELLS, langid.GRAM_CELLS), (40, 40), (40, langid.GRAM_CELLS), (langid.WORD_CELLS, 40), (0, 0)])
def test_query_against_plain_counting(spark, word_cells, gram_cells):
    rng = random.Random(6)
    stems = {"en": ["the", "cat", "house", "river", "walk"], "de": ["der", "hund", "haus", "fluss", "gehen"], "fr": ["le", "chat", "maison", "fleuve", "été"]}
    sentence = lambda x: " ".join(rng.choice(stems[x]) + rng.choice(["", "s", "en", "ing", "é"]) for _ in range(rng.randrange(1, 30)))
    train = TRAIN + [(x, sentence(x)) for x in stems for _ in range(25)]
    texts = [sentence(x) for x in stems for _ in range(20)] + ["undhouse", "zzz qqq", "日本 hund", "x" * 3000 + " the", "a1b2 _ der", "4 5", "", None]
    model = langid.train(spark.createDataFrame(train, "lang string, text string").repartition(3), word_cells=word_cells, gram_cells=gram_cells)
    assert model.whole == (min(word_cells, gram_cells) > 1000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    want = brute(train, texts)
    assert len(got) == len(texts)
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and math.isclose(got[i][1], score, rel_tol=1e-4), (texts[i], got[i], want[i])


def test_ties_go_to_the_first_language(spark):
    model = langid.train(spark.createDataFrame([("b", "same word"), ("a", "same word"), ("c", "same word")], "lang string, text string"))
    got = langid.identify(spark.createDataFrame([(1, "word same word")], "doc_id long, text string"), model).first()
    assert (got.lang_pred, round(got.score, 6)) == ("a", round(1 / 3, 6))


def test_edges(spark):
    model = langid.train(spark.createDataFrame(TRAIN, "lang string, text string"))
    rows = [(1, None), (2, ""), (3, "123 !? ² _"), (4, "der hund"), (4, "der hund"), (5, "the the the " * 50_000), (None, "und"), (6, "日本"), (7, "9a")]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en"), (None, "de"), (6, dict(got)[6]), (7, dict(got)[7])], key=str)
    assert {dict(got)[6], dict(got)[7]} <= set(model.langs)
    assert all(0 <= r.score <= 1 for r in langid.identify(docs, model).collect())
    nothing = langid.train(docs.select("text", docs.lang_pred.alias("lang")).limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from tracemill.llm.queries import op6_language_id

    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = op6_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(truth, "doc_id")
    assert r.filter("lang = lang_pred").count() / r.count() > 0.95


def test_logs_count_the_same_from_core_and_table(spark):
    """However much of the model is broadcast, sums come from the same 32-bit values."""
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for lang, letters in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "ghijka"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=20)) + " " + "".join(rng.choice("abcdefghijkz") for _ in range(6)), lang) for i, lang in enumerate(rng.choices(list(words), k=90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = []
    for word_cells, gram_cells in ((10**6, 10**7), (60, 10**7), (60, 90), (0, 0)):
        model = langid.train(docs.filter("doc_id % 3 <> 0"), word_cells=word_cells, gram_cells=gram_cells)
        found.append({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()})
    for other in found[1:]:
        assert all(other[i][0] == lang and abs(other[i][1] - score) < 1e-12 for i, (lang, score) in found[0].items())
