"""Run a ledger's items on Spark under a concurrency cap and a launch gap; restartable from the ledger."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..sources.jdbc import retried
from ..sources.ledger_store import ParquetLedger

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """cap: items at once; gap: seconds between launches while any runs; poll: seconds between looks at the running ones."""

    # Cap, gap and poll.
    run: int = 100
    cap: int = 5
    gap: float = 20.0
    poll: float = 15.0
    prefix: str = "job"
    clock: Callable[[], float] = time.monotonic


PROD = Settings(gap=120.0, poll=60.0)


@dataclass
class Runner:
    """``load(item)`` does one item, idempotently: a target path or key of its own, so that a second try changes nothing.

    Before it, jobs that an earlier try of the item left under its slot are cancelled and
    ``reset(item)`` clears what it left (views, partitions, staged files); ``cleanup(item)``
    follows the load, whether it did well or not.
    """

    spark: SparkSession
    store: ParquetLedger
    load: Callable[[object], None]
    settings: Settings = field(default_factory=Settings)
    cleanup: Callable[[object], None] = lambda item: None
    reset: Callable[[object], None] = lambda item: None

    def start(self, items: DataFrame) -> None:
        """Take up the run in the ledger, or begin it with ``items``. Items left running by a dead driver are new again."""
        s = self.settings
        if L.current_run(self.store.read(), s.run).isEmpty():
            self.store.change(lambda df: L.append(df, items))
        lost = (F.col("uniquerunid") == s.run) & F.col("iscurrentrow") & (F.col("status") == L.RUNNING)
        self.store.change(lambda df: df.withColumn("status", F.when(lost, L.NEW).otherwise(F.col("status"))))

    def record(self, item, **values) -> None:
        kinds = {f.name: f.dataType for f in L.LEDGER}
        schema = "id long, " + ", ".join(f"{k} {kinds[k].simpleString()}" for k in values)
        row = self.spark.createDataFrame([(item.id, *values.values())], schema)
        self.store.change(lambda df: L.update_by_id(df, row))

    def _one(self, item, slot: str) -> None:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", slot)
        self.spark.sparkContext.setJobGroup(slot, f"item {item.id}")
        self.spark.interruptTag(slot)
        self.spark.addTag(slot)
        try:
            self.reset(item)
            self.load(item)
        finally:
            self.spark.removeTag(slot)

    def go(self) -> list:
        """Run until no item is left to start or to wait for, then mark the run as past; returns its rows.

        A failed item is FAILED with its error in the notes, and the others go on. If only its
        cleanup fails, the data is there: that item is done too and isn't started again.
        """
        from datetime import datetime, timezone

        s, running, last = self.settings, {}, None
        now = lambda: datetime.now(timezone.utc)
        with ThreadPoolExecutor(s.cap) as pool:
            while True:
                mine = L.current_run(self.store.read(), s.run)
                ids = [r.id for r in running.values()]
                item = next(iter(L.next_pending(mine.where(~F.col("id").isin(ids)) if ids else mine).collect()), None)
                if item is None and not running:
                    break
                free = item is not None and len(running) < s.cap
                due = last is None or not running or s.clock() - last >= s.gap
                if free and due:
                    slot = f"{s.prefix}_{s.run}_{item.id}"
                    self.record(item, status=L.RUNNING, namespace=slot, started_datetime=now())
                    running[pool.submit(self._one, item, slot)] = item
                    last = s.clock()
                    log.info("started %s", slot)
                    continue
                pause = min(s.poll, max(0.0, s.gap - (s.clock() - last))) if free else s.poll
                log.debug("review: %d running, %s next", len(running), "one" if item is not None else "none")
                done, _ = wait(running, timeout=pause, return_when=FIRST_COMPLETED)
                for f in done:
                    self._ended(f, running.pop(f), now())
        self.store.change(lambda df: L.clear_run(df, s.run))
        return self.store.read().where(F.col("uniquerunid") == s.run).orderBy("id").collect()

    def _ended(self, f: Future, item, at) -> None:
        status, notes = L.COMPLETED, None
        if f.exception() is not None:
            status, notes = L.FAILED, str(f.exception())[:2000]
        try:
            retried(lambda: self.cleanup(item), 2, 0)
        except Exception as e:
            if status == L.COMPLETED:
                status, notes = L.FAILED_DROP, str(e)[:2000]
        if status == L.COMPLETED:
            log.info("ended item %s: %s", item.id, status)
        else:
            log.warning("ended item %s: %s: %s", item.id, status, notes)
        self.record(item, status=status, finished_datetime=at, **({"notes": notes} if notes else {}))

    def stop(self) -> None:
        """Interrupt all jobs of the run and clean up after each."""
        for r in L.current_run(self.store.read(), self.settings.run).where(F.col("status") == L.RUNNING).collect():
            self.spark.interruptTag(r.namespace)
            try:
                retried(lambda: self.cleanup(r), 2, 0)
            except Exception as e:
                log.warning("cleanup of item %s: %s", r.id, e)
