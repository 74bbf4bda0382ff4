"""Monitor snapshots as a Python data source: one row of JSON text for each address."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.monitor import Snapshot


class SnapshotSource(DataSource):
    """``spark.read.format("snapshot").option("url", "http://a,http://b").load()``: (url, snapshot)."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return "url string, snapshot string"

    def reader(self, schema):
        return SnapshotReader(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("url", "").split(",") if u.strip()]
        self.timeout = float(options.get("timeout", "180"))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        from urllib.request import urlopen

        with urlopen(partition.value, timeout=self.timeout) as reply:
            yield partition.value, reply.read().decode()


def valid_snapshots(read: Callable[[], DataFrame], snapshot: Snapshot, window: float = 900, wait: float = 30, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """What ``read()`` gives once each of its snapshots is valid: read again every ``wait`` seconds, for ``window`` seconds at most."""
    until = clock() + window
    while True:
        try:
            rows = read()
            if rows.where(~snapshot.valid()).isEmpty():
                return rows
            why = "snapshots are not valid"
        except OSError as e:
            why = str(e)
        if clock() + wait > until:
            raise TimeoutError(f"{why} for {window:g} seconds")
        sleep(wait)
