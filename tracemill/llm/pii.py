"""Information-theoretic sanitisation, in DataFrame operations only.

Base: patterns find e-mail, IP, card and phone spans. Each valid span is an occurrence of a
protected entity (its kind and lower-cased text).

Beyond: words that stand in a document with an entity can reveal it even when its own span is
masked. What many entities share recurs more often than they do, so that the groups they belong to
are protected too: e-mail domain, network of an address, card issuer, phone prefix. Over the corpus,
with probabilities as shares of documents, the point-wise mutual information of a term t and an
entity e is ln(n(t,e) N / (n(t) n(e))), where n(t,e) counts whole documents, and what there is to
reveal about e is its information content ln(N / n(e)). Their quotient is 1 where t never occurs
without e. Terms whose quotient reaches ``DISCLOSURE`` for an entity, on evidence that is not
chance (``revealing_terms``), get a span of their own wherever they stand in any document, and are
generalised to a placeholder when the text is sanitised.

Positions come from splitting a text at the matches of a pattern: the lengths of the parts and
of the matches, summed in order, are the starts and ends, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, quoted, staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Least quotient of mutual information and information content.
DISCLOSURE = 0.9
#: So many joint documents are evidence for a whole value without a test.
LEAST_DOCS = 3
#: Chance findings expected in a corpus stay below this for each number of joint documents.
CHANCE = 0.05
#: Joint documents that enter the bound on a pair's probability; more of them can only lower it.
BOUND_DOCS = 64
#: Rows and characters up to which a list is broadcast; beyond either it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 8_000_000

# The contract's patterns in forms that Java matches in linear time and without recursion. A run
# can only be entered at its start, or (\G) where the last match ended; possessive repeats are
# safe where what follows is not in the repeated class. A card is a whole run of 13 to 19 digits
# with at most one blank or hyphen between two of them: other runs fail, and a failed match is
# dropped without retries.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match; saves the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_WORD = r"\p{L}+"
_PLACEHOLDERS = {k: f"[{k.upper()}]" for k in (*KINDS, TERM)}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    part_ok = lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int") <= 255)
    digits = _digits(value)
    n = F.length(digits)

    def luhn(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), luhn), F.lit(0), lambda a, x: a + x)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(value, r"\."), part_ok))
        .when(kind == "card", n.between(13, 19) & (total % 10 == 0))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(False)
    )


def _matches(kind: str, text: Column) -> Column:
    """Array of (kind, at, lead, value) for one pattern; lead is the length of the part before."""
    pattern = _PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in _NEEDS:
        found = F.when(F.contains(text, F.lit(_NEEDS[kind])), found)
    parts, n = F.split(text, pattern, -1), F.size(found)
    # zipped, so that the parts are made once and not for each match
    zipped = F.arrays_zip(F.slice(parts, 1, n).alias("part"), found.alias("value"))

    def entry(m: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(m["part"]).alias("lead"), m["value"].alias("value"))

    none = F.array().cast("array<struct<kind:string,at:int,lead:int,value:string>>")
    return F.when(n > 0, F.transform(zipped, entry)).otherwise(none)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text): ``row`` tells rows with equal ids apart. Written once, so that it stays the same."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return staged(docs.sparkSession, rows, "pii-rows")


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, value): the valid spans of each of the ``numbered`` rows.

    A row without any gets one line with a null kind.
    """
    found = F.concat(*[_matches(kind, F.col("text")) for kind in KINDS])
    lines = rows.select("row", "doc_id", found.alias("found")).select("row", "doc_id", F.explode_outer("found").alias("m")).select("row", "doc_id", "m.*")
    lines = staged(rows.sparkSession, lines, "pii-matches")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hits = lines.filter(F.col("kind").isNotNull()).withColumn("end", F.sum(F.col("lead") + F.length("value")).over(so_far).cast("long"))
    hits = hits.filter(_valid(F.col("kind"), F.col("value"))).select("row", "doc_id", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")
    ids = lines.select("row", "doc_id").distinct()
    none = ids.select("row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in hits.dtypes[2:]])
    return hits.unionByName(none)


def entities(spans: DataFrame) -> DataFrame:
    """(row, entity, whole): the protected entities of each row, its values (whole) and the groups they belong to."""
    kind, value = F.col("kind"), F.lower("value")
    group = (
        F.when(kind == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.concat(F.lit("network:"), F.substring_index(value, ".", 2)))
        .when(kind == "card", F.concat(F.lit("issuer:"), F.left(_digits(value), F.lit(6))))
        .when(kind == "phone", F.concat(F.lit("prefix:"), F.left(_digits(value), F.lit(4))))
    )
    both = F.array(F.struct(F.concat_ws(":", kind, value).alias("entity"), F.lit(True).alias("whole")), F.struct(group.alias("entity"), F.lit(False).alias("whole")))
    return spans.filter(kind.isNotNull()).select("row", F.explode(both).alias("e")).select("row", "e.entity", "e.whole").distinct()


def _terms(text: str) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0)), F.lower))


def _joined(table: DataFrame, listed: DataFrame, key) -> DataFrame:
    """``table`` joined with a staged list, by broadcast if that has few rows and few characters."""
    if listed.count() <= BROADCAST_ROWS:
        size = listed.agg(F.sum(F.length(F.to_json(F.struct(*listed.columns)))).alias("n")).first().n or 0
        if size <= BROADCAST_CHARS:
            return table.join(F.broadcast(listed), key)
    return table.join(listed, key)


def _at_least(table: DataFrame, count: str) -> list[int]:
    """How many rows have a count of at least 1, 2, ... ``BOUND_DOCS``."""
    held = dict(table.groupBy(F.least(F.col(count), F.lit(BOUND_DOCS)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect())
    return [sum(n for k, n in held.items() if k >= least) for least in range(1, BOUND_DOCS + 1)]


def _least_evidence(tests: list[float], total: int, chance: float) -> int:
    """The fewest joint documents that can be enough: a pair with k of them has a bound of at least 1 / C(total, k)."""
    return next((k for k, n in enumerate(tests, 1) if k <= total and n / math.comb(total, k) < chance), BOUND_DOCS + 1)


def revealing_terms(rows: DataFrame, owned: DataFrame, disclosure: float = DISCLOSURE, least_docs: int = LEAST_DOCS, chance: float = CHANCE) -> DataFrame:
    """(term,): the terms that reveal an entity beyond the threshold, counted over whole documents.

    Evidence is enough where chance does not explain it: were the n(t) documents of a term dealt at
    random, k of them or more would be among the n(e) of an entity with a probability of at most
    the product of (n(e) - i)(n(t) - i) / ((k - i)(N - i)) for i < j, for any j up to k. That bound
    times the number of pairs that could have k joint documents (words in k documents at least,
    times values or groups in as many) must be below ``chance``. For whole values ``least_docs``
    joint documents are enough without it.

    Both rules tell beforehand what cannot count, so that only the rest is paired: entities and
    words in fewer documents than any evidence needs, and words so frequent that an entity with
    n(e) documents, all of them theirs, leaves the quotient below the threshold.
    """
    spark = rows.sparkSession
    known = staged(spark, owned.groupBy("entity", "whole").agg(F.count(F.lit(1)).alias("n_entity")), "pii-entities")
    counts = staged(spark, rows.select(F.explode(_terms("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "pii-words")
    total = rows.count()
    of_words = _at_least(counts, "n_term")
    tests = {whole: [float(max(w * e, 1)) for w, e in zip(of_words, _at_least(known.filter(F.col("whole") == whole), "n_entity"))] for whole in (True, False)}
    least = {whole: _least_evidence(t, total, chance) for whole, t in tests.items()}
    least[True] = min(least[True], least_docs)
    # mutual information of at most ln(N / n(t)) reaches the threshold only for so few documents of a term
    most = F.pow(F.col("n_entity").cast("double"), F.lit(disclosure)) * F.pow(F.lit(float(max(total, 1))), F.lit(1 - disclosure)) * (1 + 1e-9)
    known = known.filter((F.col("n_entity") < total) & (F.col("n_entity") >= F.when(F.col("whole"), least[True]).otherwise(least[False]))).withColumn("most", most)
    known = staged(spark, known, "pii-recurring")
    limit = known.agg(F.max("most")).first()[0] or 0.0
    counts = staged(spark, counts.filter((F.col("n_term") >= min(least.values())) & (F.col("n_term") <= limit)), "pii-candidates")
    lists = _joined(owned, known, ["entity", "whole"]).groupBy("row").agg(F.collect_list(F.struct("entity", "whole", "n_entity", "most")).alias("list"))
    near = _joined(rows.select("row", "text"), staged(spark, lists, "pii-lists-of-rows"), "row").select("list", F.explode(_terms("text")).alias("term"))
    near = _joined(near, counts, "term").select("term", "n_term", F.explode(F.filter("list", lambda e: e["most"] >= F.col("n_term"))).alias("e"))
    pairs = near.groupBy("term", "n_term", "e.entity", "e.whole", "e.n_entity").agg(F.count(F.lit(1)).alias("n_both"))
    per_test = lambda own: F.element_at(F.lit(own), F.least(F.col("n_both"), F.lit(BOUND_DOCS)).cast("int"))
    info = F.log(F.lit(float(total)) / F.col("n_entity"))
    mutual = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    factor = lambda i: F.log((F.col("n_entity") - i) * (F.col("n_term") - i) / ((F.col("n_both") - i) * (F.lit(float(total)) - i)))
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("n_both"), F.lit(BOUND_DOCS)) - 1)
    bound = F.aggregate(steps, F.lit(0.0), lambda a, i: a + factor(i))
    enough = (F.col("whole") & (F.col("n_both") >= least_docs)) | (F.exp(bound) * F.when(F.col("whole"), per_test(tests[True])).otherwise(per_test(tests[False])) < chance)
    return pairs.filter((mutual >= disclosure * info - 1e-12) & enough).select("term").distinct()


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, doc_id, start, end): every place of the given terms, in all rows."""
    spark = rows.sparkSession
    where = _joined(rows.select("row", F.explode(_terms("text")).alias("term")), terms, "term").groupBy("row").agg(F.collect_list("term").alias("terms"))
    held = _joined(rows, staged(spark, where, "pii-rows-with-terms"), "row")
    words = F.regexp_extract_all(F.col("text"), F.lit(_WORD), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split("text", _WORD, -1), 1, F.size(words)).alias("part"), words.alias("word"))
    lines = held.select("row", "doc_id", "terms", F.posexplode(pairs).alias("at", "m"))
    lines = lines.select("row", "doc_id", "at", F.length("m.part").alias("lead"), F.length("m.word").alias("size"), F.array_contains("terms", F.lower("m.word")).alias("told"))
    so_far = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("end", F.sum(F.col("lead") + F.col("size")).over(so_far).cast("long"))
    return lines.filter("told").select("row", "doc_id", (F.col("end") - F.col("size")).alias("start"), "end")


def spans_of(rows: DataFrame, disclosure: float = DISCLOSURE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row, doc_id, kind, start, end): base spans of staged rows (row, doc_id, text), then terms that reveal them."""
    spark = rows.sparkSession
    base = staged(spark, base_spans(rows), "pii-spans")
    terms = term_spans(rows, staged(spark, revealing_terms(rows, staged(spark, entities(base), "pii-owned"), disclosure, least_docs), "pii-terms"))
    taken = base.filter(F.col("kind").isNotNull()).select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    clash = (terms["row"] == taken["row"]) & (terms["start"] < taken["e"]) & (terms["end"] > taken["s"])
    terms = terms.join(taken, clash, "left_anti").select("row", "doc_id", F.lit(TERM).alias("kind"), "start", "end")
    return base.select("row", "doc_id", "kind", "start", "end").unionByName(terms)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row, doc_id, kind, start, end): base spans, then terms that reveal them, one line each.

    A row without base spans has one line with a null kind. Terms never overlap base spans. ``row``
    numbers the input rows, so that equal ids are told apart. A null text counts as empty.
    """
    return spans_of(numbered(docs, id_col, text_col), disclosure, least_docs)


def span_report(spans: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans.

    Defined cases: a null text counts as empty; without spans the counts are 0, ``spans`` is empty
    and the digest that of the empty string. Repeated rows and null ids stay. Very long texts are
    searched whole. An empty table gives an empty result. Other columns are ignored.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), F.col("kind")).cast("int")
    listed = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(order.alias("o"), "start", "end", "kind"))))
    rows = spans.groupBy("row", "doc_id").agg(listed.alias("all"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in (*KINDS, TERM)])
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("all", lambda x: x["o"] <= len(KINDS))
    return rows.select("doc_id", *[f"n_{k}" for k in (*KINDS, TERM)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the spans of each text replaced by placeholders; all columns stay.

    Spans that overlap become one, named after the first. Defined cases: each row loses the spans
    of its own text, whatever its id, null and repeated ones too. A null text stays null, texts
    without spans stay as they are, very long ones are searched whole. An empty table gives an
    empty result. Other columns are kept, whatever their names.
    """
    spark, key = docs.sparkSession, free_name(docs.columns)
    docs = staged(spark, docs.withColumn(key, F.monotonically_increasing_id()), "pii-documents")
    spans = spans_of(docs.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), disclosure, least_docs)
    own = spans.filter(F.col("kind").isNotNull()).select("row", "kind", "start", "end").distinct()
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("fresh", (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start")).cast("int")).withColumn("cluster", F.sum("fresh").over(upto))
    merged = own.groupBy("row", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    lists = merged.groupBy(F.col("row").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias(f"{key}spans"))
    text, marks = F.col(text_col), F.col(f"{key}spans")
    names = F.create_map(*[F.lit(x) for pair in _PLACEHOLDERS.items() for x in pair])

    def piece(x: Column, i: Column) -> Column:
        done = F.when(i > 0, F.get(marks, i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, (done + 1).cast("int"), (x["start"] - done).cast("int")), F.element_at(names, x["kind"]))

    tail = F.substring(text, (F.element_at(marks, -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.concat(F.concat_ws("", F.transform(marks, piece)), tail)
    out = docs.join(staged(spark, lists, "pii-lists"), key, "left")
    return out.select(*[F.when(marks.isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns if c != key])
