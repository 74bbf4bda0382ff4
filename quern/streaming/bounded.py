"""A load as a stream that stops when its source is drained, restartable from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.loader import insert_ignore


def drained_load(source: DataFrame, target: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Append ``source`` to the Parquet ``target`` and stop once all there is has been read.

    Each micro-batch writes a folder of its own by overwriting, so a batch that is run again
    after a crash replaces itself. With ``keys``, rows whose key is in an earlier batch are left out.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        if keys:
            from pyspark.errors import AnalysisException

            try:
                before = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", target).parquet(target).where(f"batch < {number}")
            except AnalysisException:  # nothing is there yet
                before = batch.limit(0)
            batch = insert_ignore(before, batch, keys)
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
