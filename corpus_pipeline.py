"""The corpus pipeline: five stages of the operators in quern.llm, one after the other over all documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet
and reads it back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from quern.llm.queries import table, vocabulary_file
from quern.llm.shared import likely, rows_by_bits, staged


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id`` (a null doc_id first of all) and ``_row``, a key of id and text: rows that share an id but not their text differ in it."""
    return line_dedup.keyed(docs).withColumn("_row", F.xxhash64("_id", "_sub")).drop("_sub")


def by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row key in the place of doc_id, for operators that carry it through."""
    return with_row(docs).select(F.col("_row").alias("doc_id"), "text")


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` but those whose row key is in ``rows``' doc_id; texts that a bitmap rules out stay out of the join."""
    rows = staged(rows.select(F.col("doc_id").alias("_row")).distinct(), "gone")
    marked = likely(with_row(docs), "_row", rows_by_bits(rows))
    return marked.where("not _likely").select(*docs.columns).unionByName(marked.where("_likely").join(rows, "_row", "left_anti").select(*docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores 0.3 or more go, each by its own text, in the scan that reads them; the lexicon is learned from all documents and labels."""
    lexicon = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(lexicon)(F.col("text")) < 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut from the texts; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (null is smallest); of rows repeated whole, one. Candidates are SimHashes within 2 bits, by generalised pigeonhole, and min-wise samples; links are exact."""
    rows = with_row(docs).groupBy("_row").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("n"))
    again = staged(rows.where("n > 1").select(F.col("_row").alias("doc_id")), "again")
    if not again.isEmpty():
        once = with_row(docs).join(again.select(F.col("doc_id").alias("_row")), "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
        docs = staged(without(docs, again).unionByName(once), "once")
    groups = staged(near_dedup.similar_groups(by_row(docs)).join(rows.select(F.col("_row").alias("doc_id"), "_id"), "doc_id"), "groups")
    first = groups.groupBy("group_id").agg(F.min(F.struct("_id", "doc_id")).alias("first")).select("first.doc_id")
    return without(docs, groups.join(first, "doc_id", "left_anti"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, decontaminate.find_leaks(by_row(docs), table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary_file(), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned scores, fingerprints and a tokenizer are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
