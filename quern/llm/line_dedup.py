"""Line dedup: ranks of line runs by distributed prefix doubling, LCP intervals of them, later copies cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import dropped, likely, rows_by_bits, staged

_KEY = ("_id", "_sub")

def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a row key: the id, and a hash of the text that parts rows sharing an id."""
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_sub"))


def line_rows(docs: DataFrame) -> DataFrame:
    """(_id, _sub, line_no, h1, h2, words): every line of every text; words are counted by spaces, 0 in a blank line."""
    lines = keyed(docs.select("doc_id", "text")).select(*_KEY, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    words = F.when(F.trim("line") == "", 0).otherwise(F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return lines.select(*_KEY, "line_no", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), words.cast("int").alias("words"))


def ranked(rows: DataFrame, by: list[str], kept: str = "words") -> DataFrame:
    """Rows whose ``by`` occurs more than once, with the first position of that class as its rank.

    Equal ranks are one LCP interval of the suffix array at this depth. Counts and firsts are
    combined before the shuffle. The classes are staged, so that the join back is a join of its
    own, which Spark splits where one class has many rows. It is a merge join at any size: the
    classes grow with the input, so they are not broadcast while they happen to be few.
    """
    pos = F.struct(*_KEY, "line_no")
    classes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("rank")).where("n > 1").drop("n")
    return rows.join(staged(classes, "classes").hint("merge"), by).select(*_KEY, "line_no", kept, "rank")


def least_windows(level: DataFrame, min_words: int) -> DataFrame:
    """(_id, _sub, line_no, lines, rank): the shortest windows of ``min_words`` words from and up to every line, within stretches of repeated lines.

    A window holds only lines that occur elsewhere too. ``rank`` is that of its first line.
    """
    in_text = W.partitionBy(*_KEY).orderBy("line_no")
    if min_words <= 0:
        return level.select(*_KEY, "line_no", F.lit(1).alias("lines"), "rank")
    rows = level.repartition(*_KEY).withColumn("stretch", F.col("line_no") - F.row_number().over(in_text))
    in_stretch = W.partitionBy(*_KEY, "stretch")
    rows = rows.withColumn("after", F.sum("words").over(in_stretch.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    rows = rows.withColumn("before", F.col("after") - F.col("words"))
    by_words, whole = in_stretch.orderBy("before"), in_stretch.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    start = F.struct("line_no", "rank")
    rows = rows.select(
        *_KEY, "line_no", "rank", "before", "stretch",
        F.min("line_no").over(by_words.rangeBetween(min_words, W.unboundedFollowing)).alias("end"),
        F.max(start).over(by_words.rangeBetween(W.unboundedPreceding, -min_words)).alias("since"),
        F.max("after").over(whole).alias("total"), (F.max("line_no").over(whole) + 1).alias("stop"))
    last = F.max(F.when(F.col("total") - F.col("before") >= min_words, start)).over(whole)
    rows = rows.withColumn("last", F.when(F.col("line_no") + 1 == F.col("stop"), last))
    end = F.coalesce("end", F.when(F.col("total") - F.col("before") >= min_words, F.col("stop")))
    window = lambda s, e: F.struct(F.col(f"{s}line_no").alias("line_no"), (e - F.col(f"{s}line_no")).cast("int").alias("lines"), F.col(f"{s}rank").alias("rank"))
    some = F.array(
        F.when(end.isNotNull(), window("", end)), F.when(F.col("since").isNotNull(), window("since.", F.col("line_no"))), F.when(F.col("last").isNotNull(), window("last.", F.col("stop"))))
    return rows.select(*_KEY, F.explode(F.array_compact(some)).alias("w")).select(*_KEY, "w.*").distinct()


def repeated_runs(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(_id, _sub, first, last), staged: maximal runs of lines to delete.

    A line goes if it lies in a run of ``min_words`` words or more, of however many lines, that
    starts at an earlier position too. Prefix doubling gives each line a rank by the 2^k lines
    from it on: the first position of its class, where a class at depth 2d is a pair of classes
    at depth d, one d lines on. Suffixes that differ from all others leave the search, so each
    round reads only what still repeats.

    An LCP interval at depth m is then a pair of ranks at 2^k <= m: of the 2^k lines from the
    start on, and of those before the end. Not every depth need be looked at: of a run [a, b), a
    line t lies in the shortest window of enough words that starts at a or in the shortest one
    that ends with t, and both are within the run. Which these are depends on their lines
    alone, so all copies of one are windows too. The later copies of these windows are merged
    into the maximal runs. Rounds: log2 of the lines of the longest window.
    """
    found = staged(ranked(line_rows(docs), ["h1", "h2"]), "lines0")
    levels = [found]
    level = staged(found.repartition(*_KEY).dropDuplicates([*_KEY, "line_no"]), "lines")  # rows repeated whole are one place
    windows = staged(least_windows(level, min_words), "windows")
    longest, depth, spans = windows.agg(F.max("lines")).first()[0] or 0, 1, []
    place = F.struct(*_KEY, "line_no")
    while True:
        here = windows.where((F.col("lines") >= depth) & (F.col("lines") < 2 * depth))
        if depth > 1:
            at = lambda line, name: level.select(*_KEY, line.alias("line_no"), F.col("rank").alias(name)).hint("merge")
            ends = here.drop("rank").withColumn("tail", F.col("line_no") + F.col("lines") - depth)
            ends = ends.join(at(F.col("line_no"), "r1"), [*_KEY, "line_no"]).join(at(F.col("line_no"), "r2").withColumnRenamed("line_no", "tail"), [*_KEY, "tail"])
            here = ranked(ends, ["lines", "r1", "r2"], "lines")
        spans.append(staged(here.where(F.col("rank") < place).select(*_KEY, "line_no", (F.col("line_no") + F.col("lines")).alias("reach")), "spans"))
        if 2 * depth > longest:
            break
        ahead = W.partitionBy(*_KEY).orderBy("line_no").rangeBetween(depth, depth)
        pairs = level.select(*_KEY, "line_no", F.col("rank").alias("r1"), F.first("rank").over(ahead).alias("r2"), (F.col("words") + F.first("words").over(ahead)).alias("words")).where("r2 is not null")
        levels.append(level)
        level = staged(ranked(pairs, ["r1", "r2"]), "lines")
        depth *= 2
    in_row = W.partitionBy(*_KEY).orderBy("line_no")
    parts = reduce(DataFrame.unionByName, spans).withColumn("far", F.max("reach").over(in_row.rowsBetween(W.unboundedPreceding, -1)))
    parts = parts.withColumn("run", F.sum(F.when(F.col("line_no") <= F.col("far"), 0).otherwise(1)).over(in_row.rowsBetween(W.unboundedPreceding, 0)))
    out = staged(parts.groupBy(*_KEY, "run").agg(F.min("line_no").alias("first"), (F.max("reach") - 1).alias("last")).drop("run"), "runs")
    dropped(*levels, level, windows, *spans)
    return out


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, and n_lines, n_removed added.

    Positions are ordered by (doc_id, text hash, line number); the first occurrence stays, also
    within one document. All other columns are kept. A null text stays null (0 lines); rows
    repeated whole, id included, are one place and keep their lines; a null doc_id sorts first;
    an empty table gives no rows. If ``docs`` has a column n_lines or n_removed, it is replaced.

    Texts that lose nothing stay out of the join, by a bitmap of those that do.
    """
    spans = staged(repeated_runs(docs, min_words).groupBy(*_KEY).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_gone"), F.sum(F.col("last") - F.col("first") + 1).alias("_n")), "gone")
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda s: s["last"] + 1))
    stops = F.concat(F.col("_gone.first"), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice("_lines", a + 1, b - a)))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = likely(keyed(docs), "_sub", rows_by_bits(spans.select("_sub")))
    whole = rows.where("not _likely").withColumns({"_gone": F.lit(None).cast(spans.schema["_gone"].dataType), "_n": F.lit(None).cast("long")})
    cut = rows.where("_likely").join(spans.hint("merge"), list(_KEY), "left")
    out = whole.unionByName(cut).withColumn("_lines", F.split("text", "\n"))
    return out.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in own],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))
