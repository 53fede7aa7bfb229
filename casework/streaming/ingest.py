"""Streaming forms of the idempotent append and of the newest reading per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_reading_ingest(readings: DataFrame, *, key: Sequence[str], time: str, sink: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Append each natural key once: duplicates within the watermark are dropped by state, and each micro-batch leaves out
    what the sink already has, so a replayed or very late batch adds nothing."""
    fresh = readings.withColumn("ts_event", F.col(time).cast("timestamp")).withWatermark("ts_event", late).dropDuplicatesWithinWatermark(list(key))

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        rows = batch.drop("ts_event").dropDuplicates(list(key))
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = rows.join(spark.read.parquet(sink).select(*key), list(key), "left_anti")
        rows.write.mode("append").parquet(sink)

    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


def stream_latest_per_key(readings: DataFrame, *, key: Sequence[str], time: str, tie: str, values: Sequence[str], sink: str, checkpoint: str) -> StreamingQuery:
    """The newest values of each key; state is one row per key. Each micro-batch adds the keys that it changed to the sink,
    so a replayed batch only repeats rows; ``latest_per_key`` reads what holds."""
    order = F.struct(time, tie)
    newest = readings.groupBy(*key).agg(F.max(order).alias("at"), F.max_by(F.struct(*values), order).alias("newest"))
    readings.sparkSession.createDataFrame([], newest.schema).write.mode("append").parquet(sink)

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(sink)

    return newest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


def latest_per_key(spark: SparkSession, sink: str, *, key: Sequence[str]) -> DataFrame:
    """Of the rows that ``stream_latest_per_key`` wrote the newest of each key: the key and ``newest``."""
    return spark.read.parquet(sink).groupBy(*key).agg(F.max_by("newest", "at").alias("newest"))
