"""Helpers that the operators of this subpackage share: staged tables, Arrow maps, hashing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir.

    Only where that setting is missing and all runs in one process (tests) a folder of our own
    is made; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_quern_scratch", None)
        if not found:
            local = tempfile.mkdtemp(prefix="quern-")
            atexit.register(shutil.rmtree, local, True)
            found = spark._quern_scratch = f"file://{local}"
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive a lost executor, so nothing before this point is computed twice.
    """
    path = f"{scratch_dir(df.sparkSession)}/quern/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        root = f"{scratch_dir(spark)}/quern/"
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            if at.getParent().equals(spark._jvm.org.apache.hadoop.fs.Path(root)) or at.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath():
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents_of(docs: DataFrame) -> DataFrame:
    """Just (doc_id, text), null texts empty; columns of other names are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict | None]]) -> DataFrame:
    """``mapInArrow`` with state for each task: ``make()`` runs once in a task, its result once per batch.

    The function may return a dict of columns; those are cast to ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = dict(worker_store())
        worker_store().clear()
        with kept_from(old):
            each = make()
        old.clear()
        for batch in batches:
            for part in slices(batch):
                out = each(part)
                if out is None:
                    continue
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in want], schema=want)
                yield out
        del each
        give_back()

    return df.mapInArrow(run, schema)


BATCH_BYTES = 8 << 20  # of an Arrow batch between the JVM and Python; also the JVM's buffers are as large


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session doesn't do so itself: rows can be long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:  # else it is set in other units, the session's own choice
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about ``limit`` bytes, so that a worker's memory stays small."""
    rows = max(1, int(batch.num_rows * min(1, limit / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@contextlib.contextmanager
def kept_from(old: dict) -> Iterator[None]:
    """Within, :func:`per_worker` finds what earlier tasks kept; what isn't asked for is forgotten, so that operators don't add up in a worker."""
    store = worker_store()
    store["old"] = old
    try:
        yield
    finally:
        del store["old"]


def worker_store() -> dict:
    """What this Python worker keeps from task to task."""
    import sys
    import types

    kept = sys.modules.setdefault("_quern_worker", types.ModuleType("_quern_worker"))
    return kept.__dict__.setdefault("store", {})


def per_worker(name: str, make: Callable):
    """What ``make()`` gives, once in a Python worker: later tasks find it again, until one comes that doesn't ask for it."""
    store = worker_store()
    if name not in store:
        old = store.get("old", {})
        store[name] = old[name] if name in old else make()
    return store[name]


def rows_by_bits(ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """(word, mask): a bitmap of the hashes of ``ids``' only column; at most bits / 64 rows, so it may be broadcast."""
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits))
    return (ids.select(place.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("mask")))


def likely(df: DataFrame, column: str, bitmap: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``df`` with ``_likely``: false only where ``column`` is surely not among the bitmap's ids. A broadcast of bounded size, no shuffle."""
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    out = df.withColumn("_word", F.shiftright(place, 6)).join(F.broadcast(bitmap.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))), "_word", "left")
    held = F.getbit(F.coalesce("_mask", F.lit(0).cast("long")), F.pmod(place, F.lit(64)).cast("int")) == 1
    return out.withColumn("_likely", held).drop("_word", "_mask")
