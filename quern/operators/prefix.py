"""Global ordinals and running sums without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def splitters(df: DataFrame, order: Sequence[str], buckets: int) -> list[tuple]:
    """Keys that cut ``df`` into about ``buckets`` parts of equal size in the order of ``order``: quantiles of a random sample of bounded size."""
    total = min(4096, 32 * buckets)
    rows = [tuple(r) for r in df.select(*order).orderBy(F.rand(17)).limit(total).orderBy(*order).collect()]
    return list(dict.fromkeys(rows[i * len(rows) // buckets] for i in range(1, buckets))) if rows else []


def bucketed(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``: rows dealt by sampled splitters of the whole key ``order``, nulls first.

    Equal keys share a bucket, and buckets are in the order of the keys, so what is summed per
    bucket can be carried over; one frequent first column is split by the others. The number
    follows the shuffle partitions, from 64 to 512. A row's bucket is found by bisection, in as
    many steps as the number has bits, all of them compiled.
    """
    buckets = buckets or max(64, min(512, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = [df.schema[c].dataType for c in order]
    bounds = splitters(df, order, buckets)
    if not bounds:
        return df.withColumn("_bucket", F.lit(0))
    literal = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, order)]) for r in bounds])
    out = df.withColumn("_key", F.struct(*order)).withColumn("_bucket", F.lit(0))
    for i in reversed(range(len(bounds).bit_length())):  # beyond the last bound there is null, which counts as greater
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(F.get(literal, F.col("_bucket") + F.lit((1 << i) - 1)) <= F.col("_key"), 1 << i).otherwise(0))
    return out.drop("_key")


def carried(df: DataFrame, value: Column) -> DataFrame:
    """(_bucket, _before, _total): the sum of ``value`` over the buckets before, and over all; one row a bucket.

    The hash, which is never null, has all columns read, so that the shuffle is the one that the
    windows read and ``df`` isn't computed again for the sums.
    """
    sums = df.groupBy("_bucket").agg(F.sum(value).alias("_s"), F.max(F.xxhash64(*df.columns)).alias("_all")).where("_all IS NOT NULL")
    return sums.select("_bucket", (F.sum("_s").over(W.orderBy("_bucket")) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy()).alias("_total"))


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str = "cum", total: str | None = None, buckets: int | None = None) -> DataFrame:
    """Running sum in the order of ``order``; rows that tie share a value, as with a RANGE frame.

    Two levels: sums per bucket, of which there are at most ``buckets``, then a window in each.
    """
    dealt = bucketed(df, order, buckets).repartition("_bucket")
    own = F.sum(value).over(W.partitionBy("_bucket").orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow))
    out = dealt.withColumn("_own", own).join(F.broadcast(carried(dealt, F.col(value))), "_bucket")
    out = out.withColumn(name, F.col("_own") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_own", "_before", "_total")


def ordinal(df: DataFrame, order: Sequence[str], name: str = "n", start: int | Column = 1, buckets: int | None = None) -> DataFrame:
    """Numbers from ``start`` on in the order of ``order``, two-level like :func:`running_sum`."""
    dealt = bucketed(df, order, buckets).repartition("_bucket")
    own = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    first = F.lit(start) if isinstance(start, int) else start
    out = dealt.withColumn("_own", own).join(F.broadcast(carried(dealt, F.lit(1))), "_bucket")
    return out.withColumn(name, (F.col("_own") + F.col("_before") - 1 + first).cast("long")).drop("_bucket", "_own", "_before", "_total")
