"""The text operators as registered queries, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, minhash, mixture, packing, periodic, pii, spelling, token_counts, topk, toxicity, urlfilter
from .common import read_table

QUERIES = {}
ORACLE_SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE_SQL["op9_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Rules that op1 is to judge by.
URL_RULES = (
    urlfilter.HostRule("net", "/", "block"), urlfilter.HostRule("example.net", "/en/", "allow"),
    urlfilter.HostRule("example.com", "/de/", "block"), urlfilter.HostRule("org", "/fr/", "allow"),
)


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


ORACLE_SQL["op1_url_filter"] = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
g AS (SELECT *, CASE
        WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
      CASE WHEN contains(host || path, 'spam') THEN '*spam*'
        WHEN contains(host || path, 'cheap-pills') THEN '*cheap-pills*'
        WHEN contains(host || path, 'casino') THEN '*casino*'
        WHEN contains(host || path, '/login') THEN '*/login*'
        WHEN contains(host || path, '/cart/') THEN '*/cart/*' END AS fit FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN fit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN fit END AS glob
FROM g
"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(read_table(spark, sf_dir, "documents"), ranks, pattern)
    return bpe.decode_documents(encoded, ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


ORACLE_SQL["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5
"""


def crc32_mod(id_col: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 4) == 2
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learns labels only from ids outside the held-out fold."""
    return toxicity.train(documents.select("doc_id", "text"), labels, lambda c: crc32_mod(c, 5) != 0)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(pii.find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.periodic_runs(periodic.with_planted_repeats(read_table(spark, sf_dir, "documents"))))


@query
def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.pack_mixture(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def misspelt(doc_id: int | None, word: bytes) -> bytes:
    """One of 199 words of a document, told by the checksum of id and word, loses the letter that the checksum names."""
    letters = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(letters, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.count_words(read_table(spark, sf_dir, "documents"), edit=misspelt))
