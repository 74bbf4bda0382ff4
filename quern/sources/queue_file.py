"""The queue file: one work item a line, query and target, extra columns ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import ordinal


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): text lines numbered from 1 in file order, blank ones included.

    The place of a line is its file and its byte order there, so the file is read as whole
    text per file (a queue is small) and opened by position.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    body = F.regexp_replace(F.regexp_replace("body", "\r\n", "\n"), "\n$", "")
    lines = whole.select("file", F.posexplode(F.split(body, "\n")).alias("pos", "value"))
    return lines.select((F.col("pos") + 1).cast("long").alias("line"), "file", "value")


def scan_queue(lines: DataFrame, sep: str = "|") -> DataFrame:
    """(roworder, query, targettbl) of numbered lines; blank lines take a number and go.

    Fields may be quoted with ``"``, doubled inside; spaces are kept; columns past the second
    are ignored. A line with one column only fails the query with a clear error.
    """
    fields = F.from_csv("value", "query string, targettbl string", {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    rows = lines.where(F.length("value") > 0).select(F.col("line").alias("roworder"), "value", fields.alias("f")).select("roworder", "value", "f.*")
    checked = F.when(F.col("targettbl").isNotNull(), F.col("targettbl")).otherwise(F.raise_error(F.concat(F.lit("queue line without a target: "), F.col("value"))))
    return rows.select("roworder", "query", checked.alias("targettbl"))


def items_of(queue: DataFrame, run: int, first_id: int = 1) -> DataFrame:
    """Ledger rows, new and current, for the queue's lines; ids go on from ``first_id``."""
    rows = ordinal(queue, ["roworder"], "id", first_id)
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "id", "roworder", F.lit(run).cast("long").alias("uniquerunid"), "query", none("string").alias("appname"), "targettbl", F.lit("NEW").alias("status"),
        none("string").alias("namespace"), none("timestamp").alias("started_datetime"), none("timestamp").alias("finished_datetime"), none("string").alias("notes"), F.lit(True).alias("iscurrentrow"))
