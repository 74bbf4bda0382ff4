"""Stores for the ledger. Parquet has no MERGE or UPDATE: every change writes a new version beside the old one."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ledger import LEDGER
from .jdbc import retried


class ParquetLedger:
    """Versions ``v=N`` under one folder; the newest with a _SUCCESS mark counts, so a broken write is never seen."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, tries: int = 600, wait: float = 0.5):
        self.spark, self.path, self.keep, self.tries, self.wait = spark, path.rstrip("/"), keep, tries, wait

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/v={found[-1]}")

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    @contextlib.contextmanager
    def _alone(self):
        """One writer at a time: the lock file is created by whoever finds none, which file systems do atomically."""
        jvm, root, fs = self._fs()
        lock = jvm.org.apache.hadoop.fs.Path(root, "_lock")
        fs.mkdirs(root)

        def take():
            if not fs.createNewFile(lock):
                raise TimeoutError(f"{lock.toString()} is held by another writer; delete it if that one is dead")

        retried(take, self.tries, self.wait)
        try:
            yield jvm, fs
        finally:
            fs.delete(lock, False)

    def change(self, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Write ``make(current)`` as the next version under the lock, drop the oldest ones, and return what was written."""
        with self._alone() as (jvm, fs):
            found = self.versions()
            new = (found[-1] if found else 0) + 1
            self._write(make(self.read()).select(*LEDGER.fieldNames()), f"{self.path}/v={new}")
            for old in found[: -self.keep + 1]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={old}"), True)
        return self.read()

    def truncate(self) -> None:
        self.change(lambda df: df.limit(0))


class JsonLedger(ParquetLedger):
    """The same over JSON documents; a missing current flag reads as false."""

    def read(self) -> DataFrame:
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).json(f"{self.path}/v={found[-1]}").fillna({"iscurrentrow": False})

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("ignoreNullFields", "false").json(path)


STORES = {"parquet": ParquetLedger, "json": JsonLedger}


def open_ledger(spark: SparkSession, kind: str, path: str) -> ParquetLedger:
    """The store named by ``kind``, in any case."""
    return STORES[kind.strip().lower()](spark, path)


def create_table(spark: SparkSession, name: str) -> None:
    """The ledger as a catalog table."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
