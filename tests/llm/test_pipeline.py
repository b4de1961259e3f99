import corpus_pipeline
import numpy as np
import public_tokenizers
from tracemill.llm import exact_dedup, minhash, packing, pii, toxicity
from tracemill.llm.queries import toxicity_model

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "pii", "packing"]

    one = stage["toxicity"](spark, docs, SF)
    left = {i: t for i, t in texts.items() if i not in toxic}
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == left

    two = stage["exact dedup"](spark, one, SF)
    best = {}
    for i, t in left.items():
        key = "".join(c for c in t if c not in exact_dedup.IGNORED)
        best[key] = min(best.get(key, (0, i)), (-len(t), i))
    kept = {i for _, i in best.values()}
    assert two.columns == columns and {r.doc_id for r in two.collect()} == kept

    three = stage["near dedup"](spark, two, SF)
    near = {r.doc_id for r in minhash.near_duplicates(two).collect() if r.kept}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == near < kept

    four = stage["pii"](spark, three, SF)
    rows = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns and set(rows) == near
    with_spans = {r.doc_id for r in pii.find_spans(three).filter("kind is not null").collect()}
    assert with_spans and all((rows[i].text == texts[i]) == (i not in with_spans) for i in near)
    assert all(r.n_chars == len(r.text) for r in rows.values())

    pieces = stage["packing"](spark, four, SF).collect()
    assert {p.doc_id for p in pieces} == near
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= packing.SEQUENCE_TOKENS


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    memo = packing.ChunkMemo(public_tokenizers.path("word_bpe_49k.json"))
    assert got.count() > 0 and np.frombuffer(memo.encode("a b"), "<u4").size == 2


def test_null_and_repeated_ids(spark):
    words = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heath", "inlet", "jetty", "knoll", "ledge"]
    text = lambda k: " ".join(words[(k * 5 + j * j * (k + 1)) % 12] + str(k) for j in range(30))
    rows = [(3 * k if k % 3 else None, text(k)) for k in range(12)]
    rows += [(50, text(20)), (50, text(20)), (50, text(21) + " mail a@b.c"), (50, text(22))]  # an id with copies and other texts
    rows += [(None, text(23)), (None, text(23)), (None, text(1)), (2, text(0)), (None, text(24) + " mail ann@b.c"), (60, text(22) + "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    order = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)

    best = {}
    for i, t in rows:
        key = "".join(c for c in t if c not in exact_dedup.IGNORED)
        best[key] = min(best.get(key, ((0,), 0)), ((-len(t), i is None, i or 0), (i, t)))
    want = sorted((r for _, r in best.values()), key=str)
    two = stage["exact dedup"](spark, docs, SF)
    assert two.columns == docs.columns and order(two) == want
    assert len(want) == 17 and sum(i is None for i, _ in want) == 5

    three = stage["near dedup"](spark, two, SF)
    assert three.columns == docs.columns and order(three) == want
    long = " ".join(f"{words[k % 12]}{k}" for k in range(200))
    copy = (None, long + " end"), (15, long)
    near = stage["near dedup"](spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in copy], docs.schema), SF)
    assert order(near) == [(15, long)]

    four = stage["pii"](spark, three, SF)
    assert four.columns == docs.columns
    assert order(four) == sorted(((i, t.replace("a@b.c", "[EMAIL]").replace("ann@b.c", "[EMAIL]")) for i, t in want), key=str)


def test_every_stage_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, and empty tables."""
    long = " ".join(f"w{k % 4999}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, None), (None, "one two"), (4, long), (4, long), (5, long + " mail q@r.s"), (6, "x" * 100_000), (7, "short text"), (7, "short text"), (None, "mail a@b.c")]
    data = [(i, t, None, None, None, k, "r") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int, _row string").repartition(3)
    rest = dict(corpus_pipeline.STAGES)
    places = lambda d: sorted(r.score for r in d.collect())
    assert places(rest["toxicity"](spark, docs, SF)) == list(range(len(rows)))
    exact = places(rest["exact dedup"](spark, docs, SF))
    # blank texts are one group, whose longest text stays; one of each pair of equal rows goes
    assert len(exact) == 7 and 2 in exact and {4, 7, 8, 11} < set(exact) and len({5, 6} & set(exact)) == len({9, 10} & set(exact)) == 1
    near = places(rest["near dedup"](spark, docs, SF))
    assert {0, 1, 2, 3, 4, 8, 11} < set(near) and len({5, 6, 7} & set(near)) == 1 and len({9, 10} & set(near)) == 1
    clean = {r.score: r for r in rest["pii"](spark, docs, SF).collect()}
    assert set(clean) == set(range(len(rows))) and clean[11].text == "mail [EMAIL]" and clean[7].text == long + " mail [EMAIL]"
    assert all(clean[k].text == t for k, (_, t) in enumerate(rows) if k not in (7, 11))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r["_row"] == "r" for r in clean.values())
    packed = rest["packing"](spark, docs, SF).collect()
    assert sum(p.piece == 0 for p in packed) == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0 and (name == "packing" or nothing.columns == docs.columns)


def test_columns_whose_names_clash_with_keys(spark):
    """Names that differ from the stages' own only in case or begin with them, and names with dots, come back with their values."""
    names = ["_ROW", "_rowspans", "_rowplace", "_Row_x", "row", "key", "a.b", "c d", "kind", "salt"]
    rows = [(7, "one mail a@b.c two"), (8, "three four"), (None, "five"), (None, "six +49 30 1234567"), (8, "seven")]
    data = [(i, t, "en", "s", len(t), *range(100 * k, 100 * k + len(names))) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)
    for ids_repeat in (True, False):
        docs = spark.createDataFrame([(k if not ids_repeat else r[0], *r[1:]) for k, r in enumerate(data)], schema).repartition(2)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            assert sorted(tuple(r)[5:] for r in got.collect()) == [tuple(range(100 * k, 100 * k + len(names))) for k in range(len(rows))], name
        assert sum(p.piece == 0 for p in corpus_pipeline.pack(spark, docs, SF).collect()) == len(rows)
