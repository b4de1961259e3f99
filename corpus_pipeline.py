"""Corpus pipeline: reject toxic documents, drop exact and near copies, sanitise, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
frame that is written as Parquet and read back as the next stage's documents. All but the last
return the columns of ``documents``.

Rows are told apart by keys of their own (``_keyed``), not by their ids. Defined cases: a row with
a null id is a document of its own. Of rows that repeat an id and a text one stays; rows that
repeat an id with different texts are different documents. Columns beyond those of ``documents``
are carried along, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import exact_dedup, minhash, packing, pii, toxicity
from tracemill.llm.common import free_name, quoted, read_table, staged
from tracemill.llm.queries import toxicity_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic; each row is judged by its whole text, a null one as empty.

    An empty table gives an empty result; columns beyond those of ``documents`` stay, whatever their names.
    """
    return toxicity.reject_toxic(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: the one with the most code points, then the smallest id; null ids come last.

    Null, empty and blank texts are equal. Whole texts count, however long.
    """
    rows, key = _keyed(spark, docs)
    kept = exact_dedup.exact_dedup(rows, id_col=key).filter("kept").select(F.col("doc_id").alias(key))
    return _only(rows, staged(spark, kept, "pipeline-exact"), key).select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, the one with the smallest id (null ids come last).

    Documents without words, null texts among them, all stay. Whole texts count, however long.
    """
    rows, key = _keyed(spark, docs)
    kept = minhash.near_duplicates(rows.select(key, "text"), id_col=key).filter("kept").select(F.col("doc_id").alias(key))
    return _only(rows, staged(spark, kept, "pipeline-near"), key).select(*map(quoted, docs.columns))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it become placeholders in each row; ``n_chars`` follows the text, null ones have none."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their places in sequences; repeated rows are packed each on its own, null texts are empty.

    An empty table gives no pieces; columns beyond id and text are ignored, whatever their names.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row that orders rows by id, null ids last, and the name of its column.

    Where every row has an id of its own, that is the key. Else rows are numbered in the order of their ids.
    """
    key = free_name(docs.columns)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shared = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1")
    if not shared.limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    # the place in the input splits the rows of one id, so that no task sorts all null ids
    place = key + "place"
    placed = docs.withColumn(place, F.monotonically_increasing_id()).orderBy(F.col("doc_id").cast("long").asc_nulls_last(), place)
    return staged(spark, placed.drop(place).withColumn(key, F.monotonically_increasing_id()), "pipeline-keyed"), key


def _only(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed. A merge join at every size: the list grows with the corpus, and Spark can split its skew."""
    return docs.join(rows.hint("merge"), key, "left_semi")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
