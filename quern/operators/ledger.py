"""The work ledger: its schema, reads and versioned writes. One meaning for all stores: upsert by id, nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix import ordinal

LEDGER = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("roworder", T.LongType()), T.StructField("uniquerunid", T.LongType()), T.StructField("query", T.StringType()),
    T.StructField("appname", T.StringType()), T.StructField("targettbl", T.StringType()), T.StructField("status", T.StringType()), T.StructField("namespace", T.StringType()),
    T.StructField("started_datetime", T.TimestampType()), T.StructField("finished_datetime", T.TimestampType()), T.StructField("notes", T.StringType()), T.StructField("iscurrentrow", T.BooleanType())])

# The states of a work item, and of a job.
NEW, RUNNING, COMPLETED, FAILED, FAILED_DROP = "NEW", "RUNNING", "COMPLETED", "FAILED", "COMPLETED-FAILEDDROP"
DONE = (COMPLETED, FAILED, FAILED_DROP)
NOT_STARTABLE = (RUNNING, COMPLETED, FAILED, FAILED_DROP)
JOB_ALIVE = ("RUNNING", "QUIESCING", "COMPLETED")


def next_id(ledger: DataFrame) -> DataFrame:
    """(next_id): one more than the largest id, 1 for an empty ledger."""
    return ledger.agg(F.coalesce(F.max("id") + 1, F.lit(1).cast("long")).alias("next_id"))


def assign_ids(items: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """``items`` with ids that go on from the ledger's, in the order of ``order``."""
    first = next_id(ledger).first()[0]
    return ordinal(items, [order], "id", int(first))


def rows_where(ledger: DataFrame, where: str | None = None) -> DataFrame:
    """The rows that a SQL predicate holds for; all if it is blank."""
    return ledger.where(where) if where and where.strip() else ledger


def current_run(ledger: DataFrame, run: int) -> DataFrame:
    return ledger.where(F.col("iscurrentrow") & (F.col("uniquerunid") == run))


def lookup(ledger: DataFrame, item: int) -> DataFrame:
    """The row of one id, or none; the first by roworder if a store holds several."""
    return ledger.where(F.col("id") == item).orderBy("roworder").limit(1)


def append(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    return ledger.unionByName(rows.select(*ledger.columns))


def one_per_id(rows: DataFrame) -> DataFrame:
    """``rows`` with one row an id: of several, the greatest by its columns from left to right (null is least)."""
    own = [c for c in rows.columns if c != "id"]
    if not own:
        return rows.distinct()
    return rows.groupBy("id").agg(F.max(F.struct(*own)).alias("_r")).select(*["id" if c == "id" else F.col(f"_r.`{c}`").alias(c) for c in rows.columns])


def update_by_id(ledger: DataFrame, changes: DataFrame, write_nulls: bool = False) -> DataFrame:
    """``ledger`` with the columns of ``changes`` put in by id; ids that it hasn't are ignored.

    Nulls in ``changes`` leave the old value, or with ``write_nulls`` replace it. Of several
    changes of an id one counts (:func:`one_per_id`), so no row is multiplied.
    """
    changes = one_per_id(changes)
    own = [c for c in changes.columns if c != "id"]
    new = changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in own])
    out = ledger.join(new, "id", "left")

    def value(c: str) -> Column:
        if c not in own:
            return F.col(c)
        return F.when(F.col("_hit") & F.lit(True) if write_nulls else F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return out.select(*[value(c) for c in ledger.columns])


def merge_upsert(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace those of their id and join otherwise: an anti join and a union, no window over the ledger. Of several rows of an id one counts."""
    rows = one_per_id(rows.select(*ledger.columns))
    return ledger.join(rows.select("id"), "id", "left_anti").select(*ledger.columns).unionByName(rows.select(*ledger.columns))


def clear_run(ledger: DataFrame, run: int) -> DataFrame:
    """No row of ``run`` is current any more."""
    own = (F.col("uniquerunid") == run) & F.col("iscurrentrow")
    return ledger.withColumn("iscurrentrow", F.when(own, F.lit(False)).otherwise(F.col("iscurrentrow")))


def new_version(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Slowly changing rows: the old versions of the changed ids stay, no longer current, and the new ones are current."""
    changed = rows.select("id", F.lit(True).alias("_hit")).distinct()
    old = ledger.join(changed, "id", "left").withColumn("iscurrentrow", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("iscurrentrow"))).select(*ledger.columns)
    return old.unionByName(rows.withColumn("iscurrentrow", F.lit(True)).select(*ledger.columns))


def status_in(status: Column, among: tuple[str, ...]) -> Column:
    """False, not null, for a null status."""
    return F.coalesce(status, F.lit("")).isin(*among)


def pending(ledger: DataFrame) -> DataFrame:
    """Items that may start, by roworder, then id."""
    return ledger.where(~status_in(F.col("status"), NOT_STARTABLE)).orderBy("roworder", "id")


def next_pending(ledger: DataFrame) -> DataFrame:
    return pending(ledger).limit(1)


def any_not_done(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.bool_or(~status_in(F.col("status"), DONE)), F.lit(False)).alias("any_not_done"))


def first_free(used: DataFrame, column: str, running: int) -> DataFrame:
    """(slot): ``running`` + 1 if it isn't used, or else the smallest number from 2 on that isn't.

    A free one is among the first count + 2, so the probe is as long as the used list at most.
    """
    taken = used.select(F.col(column).cast("long").alias("n")).where("n >= 1").distinct()
    size = used.sparkSession.range(0, 1).join(taken.agg(F.count(F.lit(1)).alias("c")))
    numbers = size.select(F.explode(F.sequence(F.lit(2).cast("long"), F.col("c") + 2)).alias("n"))
    free = numbers.join(taken, "n", "left_anti").agg(F.min("n").alias("least"))
    wanted = taken.where(F.col("n") == running + 1).agg((F.count(F.lit(1)) > 0).alias("is_used"))
    return free.crossJoin(wanted).select(F.when(F.col("is_used"), F.col("least")).otherwise(F.lit(running + 1)).cast("long").alias("slot"))
