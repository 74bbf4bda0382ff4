"""Cut a table into disjoint ranges: by key, by date, or into chunks of equal weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined
from .prefix import running_sum


@dataclass(frozen=True)
class KeyRange:
    """A range of a key; None is open. ``closed`` says whether low and high belong to it."""

    label: str
    low: object = None
    high: object = None
    closed: tuple[bool, bool] = (True, True)

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (key >= F.lit(self.low) if self.closed[0] else key > F.lit(self.low))
        if self.high is not None:
            out = out & (key <= F.lit(self.high) if self.closed[1] else key < F.lit(self.high))
        return out

    def sql(self, column: str) -> str:
        """The predicate as text, for a source that takes one query or predicate a partition."""
        if self.low is not None and self.high is not None and all(self.closed):
            return f"{column} BETWEEN {self.low} AND {self.high}"
        parts = []
        if self.low is not None:
            parts.append(f"{column} {'>=' if self.closed[0] else '>'} {self.low}")
        if self.high is not None:
            parts.append(f"{column} {'<=' if self.closed[1] else '<'} {self.high}")
        return " AND ".join(parts) or "1 = 1"


def integer_ranges(bounds: list[int]) -> list[KeyRange]:
    """``< b0``, ``between b0 and b1``, ``between b1 + 1 and b2``, ..., ``> bn``: disjoint over whole numbers; nulls and fractions between are left out."""
    out = [KeyRange("r0", high=bounds[0], closed=(False, False))]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        out.append(KeyRange(f"r{i + 1}", a if i == 0 else a + 1, b))
    return [*out, KeyRange(f"r{len(bounds)}", low=bounds[-1], closed=(False, False))]


def half_open_ranges(bounds: list) -> list[KeyRange]:
    """Ranges [a, b) that hold every value that isn't null."""
    edges = [None, *bounds, None]
    return [KeyRange(f"r{i}", a, b, (True, False)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def labelled(df: DataFrame, key: str, ranges: list[KeyRange], name: str = "range", missing: str | None = None) -> DataFrame:
    """``df`` with the label of the first range that holds ``key``, in one scan; rows that none holds go unless ``missing`` labels them."""
    label = F.lit(missing)
    for r in reversed(ranges):
        label = F.when(r.holds(F.col(key)), r.label).otherwise(label)
    out = df.withColumn(name, label)
    return out if missing else out.where(F.col(name).isNotNull())


def ranged_scans(df: DataFrame, key: str, ranges: list[KeyRange]) -> list[DataFrame]:
    """One filtered scan a range; the filters reach the source."""
    return [df.where(r.holds(F.col(key))) for r in ranges]


def chunk_by_weight(extents: DataFrame, chunks: int) -> DataFrame:
    """``extents`` (relative_fno, block_id, blocks) with cum, total and grp: chunks of nearly equal weight in storage order.

    grp = ((100 cum - 1) chunks) div (100 total): right-closed, in whole numbers, truncated
    toward zero. An extent goes where its end falls, so one that spans several quantiles
    leaves numbers out; leading empty extents are in 0. Without any weight all is in chunk 0.
    """
    out = running_sum(extents, ["relative_fno", "block_id"], "blocks", "cum", "total")
    grp = F.expr(f"CASE WHEN total = 0 THEN 0L ELSE ((100 * cum - 1) * {int(chunks)}) div (100 * total) END")
    return out.withColumn("grp", grp)


def chunk_table(chunked: DataFrame) -> DataFrame:
    """One row per chunk: first and last (file, block) and its weight; two extremes a group, no window."""
    first = F.min(F.struct("relative_fno", "block_id"))
    last = F.max(F.struct(F.col("relative_fno"), F.col("block_id"), (F.col("block_id") + F.col("blocks") - 1).alias("end")))
    g = chunked.groupBy("grp").agg(first.alias("a"), last.alias("b"), F.sum("blocks").alias("sum_blocks"))
    return g.select("grp", F.col("a.relative_fno").alias("first_fno"), F.col("a.block_id").alias("first_block"), F.col("b.relative_fno").alias("last_fno"), F.col("b.end").alias("last_block"), "sum_blocks")


# The first and last row of a block.
FIRST_ROW, LAST_ROW = 0, 10000


def chunk_predicate(object_id: Column) -> Column:
    """A chunk's range as text over (obj, fno, blk, row): from the first row of its first block to the last one of its last."""
    place = lambda f, b, row: joined(F.lit("("), object_id, F.lit(", "), F.col(f), F.lit(", "), F.col(b), F.lit(f", {row})"))
    return joined(F.lit("(obj, fno, blk, row) BETWEEN "), place("first_fno", "first_block", FIRST_ROW), F.lit(" AND "), place("last_fno", "last_block", LAST_ROW))


def queue_lines(chunks: DataFrame, source: str, target: str, object_id: Column) -> DataFrame:
    """The chunks as lines of a queue file: quoted query and target, six empty columns."""
    query = joined(F.lit(f'"SELECT * FROM {source} WHERE '), chunk_predicate(object_id), F.lit(f'"|"{target}"||||||'))
    return chunks.select("grp", query.alias("value"))


def with_ends(chunked: DataFrame) -> DataFrame:
    """Every extent with its chunk's first and last place and weight: a join with the chunk table, which has a row a chunk, instead of windows over whole chunks."""
    return chunked.join(F.broadcast(chunk_table(chunked)), "grp")


def in_chunks(extents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Extents with the chunk whose range holds them, without those that none does.

    The chunk table, a row a chunk, is one sorted array on every executor. Ranges are disjoint,
    so an extent's chunk is the last one that begins at or before it, if that one ends there or
    after: a count of beginnings, no pair of an extent and a chunk is made.
    """
    place = lambda f, b: F.struct(F.col(f).alias("f"), F.col(b).alias("b"))
    entry = F.struct(place("first_fno", "first_block").alias("low"), place("last_fno", "last_block").alias("high"), F.struct(*chunks.columns).alias("c"))
    table = chunks.agg(F.array_sort(F.collect_list(entry)).alias("_chunks"))
    out = extents.join(F.broadcast(table)).withColumn("_at", place("relative_fno", "block_id"))
    out = out.withColumn("_c", F.get("_chunks", F.size(F.filter(F.col("_chunks.low"), lambda low: low <= F.col("_at"))) - 1))
    return out.where(F.col("_at") <= F.col("_c.high")).select(*extents.columns, "_c.c.*")
