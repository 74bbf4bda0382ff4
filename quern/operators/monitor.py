"""Monitoring snapshots: nested JSON, validated and opened up with column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import namespace_of
from .ledger import JOB_ALIVE, RUNNING

APP = "struct<entityType:string,fullName:string,statusChange:string,rate:string,sourceRate:string,cpuRate:string,numServers:string,latestActivity:string,applicationComponents:array<string>>"
NODE = "struct<entityType:string,name:string,fullName:string,version:string,freeMemory:string,cpuRate:string,uptime:string>"
STORE = "struct<rx:string,tx:string,storageFree:string,storageTotal:string>"


class Snapshot:
    """Paths into a snapshot ``[{"output": {apps: [...], nodes: [...], store: {...}}}]``; the three names may differ."""

    def __init__(self, text: str | Column, apps: str = "applications", nodes: str = "clusterNodes", store: str = "search"):
        self.text = F.col(text) if isinstance(text, str) else text
        self.names = apps, nodes, store

    def raw(self, i: int) -> Column:
        """A section as text; null where the path isn't there. The root must be a list."""
        return F.when(F.ltrim(self.text).startswith("["), F.get_json_object(self.text, f"$[0].output.{self.names[i]}"))

    def items(self, i: int) -> Column:
        """The section's elements as texts; null unless it is a list."""
        raw = self.raw(i)
        return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))

    def apps(self) -> Column:
        return F.from_json(self.raw(0), f"array<{APP}>")

    def nodes(self) -> Column:
        return F.from_json(self.raw(1), f"array<{NODE}>")

    def valid(self) -> Column:
        """A list of applications is there and each of them is an object with a fullName; an empty list is valid, anything else not."""
        each = F.forall(self.items(0), lambda x: F.ltrim(x).startswith("{") & F.get_json_object(x, "$.fullName").isNotNull())
        return F.coalesce(each, F.lit(False))

    def open_apps(self, df: DataFrame, *keep: str) -> DataFrame:
        """One row per application that has an entityType, of valid snapshots; with its namespace."""
        rows = df.where(self.valid()).select(*keep, F.explode(self.apps()).alias("a"))
        return rows.where("a.entityType is not null").select(*keep, "a.*").withColumn("namespace", namespace_of(F.col("fullName")))

    def open_nodes(self, df: DataFrame, *keep: str) -> DataFrame:
        """One row per node with entityType and version, of valid snapshots; the name falls back to fullName."""
        rows = df.where(self.valid()).select(*keep, F.explode(self.nodes()).alias("n"))
        rows = rows.where("n.entityType is not null and n.version is not null").select(*keep, "n.*")
        return rows.withColumn("name", F.coalesce("name", "fullName")).drop("fullName")

    def open_store(self, df: DataFrame, *keep: str) -> DataFrame:
        """No row or one, of valid snapshots."""
        raw = self.raw(2)
        return df.where(self.valid() & F.ltrim(raw).startswith("{")).select(*keep, F.from_json(raw, STORE).alias("s")).select(*keep, "s.*")


def finished_items(ledger: DataFrame, apps: DataFrame, states: tuple[str, ...] = ("QUIESCED", "COMPLETED")) -> DataFrame:
    """Running ledger rows whose application has come to an end, each once."""
    ended = apps.where(F.col("statusChange").isin(*states)).select("namespace")
    return ledger.where(F.col("status") == RUNNING).join(ended, "namespace", "left_semi")


def alive(apps: DataFrame) -> DataFrame:
    return apps.where(F.col("statusChange").isin(*JOB_ALIVE))


def folded_results(results: Column) -> Column:
    """struct(ok, message) of command results in order: once one fails, messages from there on are joined, each with ';'; null ones are skipped."""
    start = F.struct(F.lit(True).alias("ok"), F.lit("").alias("message"))

    def step(acc: Column, r: Column) -> Column:
        ok = acc["ok"] & ~F.coalesce(r["executionStatus"] == "Failure", F.lit(False))
        own = F.when(ok | r["failureMessage"].isNull(), "").otherwise(F.concat(r["failureMessage"], F.lit(";")))
        return F.struct(ok.alias("ok"), F.concat(acc["message"], own).alias("message"))

    return F.aggregate(results, start, step)
