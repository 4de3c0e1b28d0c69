"""Corpus pipeline: reject junk, keep one of each near-duplicate group, cut repeated passages, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  Verdicts belong to
rows, not to doc_ids: ids may be null or repeated.  For that ``docs`` must be a table that is read in the
same order each time, as Parquet files are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfield.llm.common import read, stash, unused
from tallyfield.llm.mixing import mixed_documents
from tallyfield.llm.ngram_join import jaccard_components
from tallyfield.llm.packing import pack_documents
from tallyfield.llm.quality_classifier import classify_quality
from tallyfield.llm.substring_dedup import dedup_substrings

#: No SQL text can state the classifier, the rolling hash or the packing; the tests use brute force.
ORACLE_SQL = None


def tokenizer() -> str:
    """Path of the public vocabulary that op9 and the last stage use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, and that column's name, which none of ``docs`` has."""
    row = unused("__row", docs)
    return docs.withColumn(row, F.monotonically_increasing_id()), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts have a score like any other; repeated rows are judged each; no documents, no rows.
    """
    rows, row = numbered(docs)
    good = classify_quality(rows, read(spark, sf_dir, "labels"), row=row).where("predicted = 1").select(row)
    return rows.join(good, row, "left_semi").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at 80 % of their five-word shingles.

    It is the row of the smallest doc_id, nulls last, and the first in the table of those that share it.
    Texts without words are linked with nothing, so all of them stay.
    """
    rows, row = numbered(docs)
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("of"))
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min("of").alias("of")).select(F.col("of.row").alias(row))
    return rows.join(first, row, "left_semi").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated passages cut out of their texts; n_chars follows.

    Null texts stay null, empty ones empty; a text that is all repetition becomes empty and stays.  Rows of
    a null doc_id take no part.
    """
    return dedup_substrings(docs, cut=unused("cut", docs)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; one without words isn't taken.

    A null source is a source of its own; rows are told apart by number, whatever their doc_id.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences; a null or empty text is its end token alone."""
    pieces = pack_documents(docs, tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
