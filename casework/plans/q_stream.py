"""Queries that run a stream over the whole events table to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.plans.registry import query
from casework.sources.tables import Tables
from casework.streaming import ingest


def _shared_folder(t: Tables) -> str:
    """A new folder below the checkpoint folder of the session; only where none is set, a local one."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="casework-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def _stream(t: Tables) -> DataFrame:
    whole = t.events
    return t.spark.readStream.schema(whole.schema).option("pathGlobFilter", "*.parquet").parquet(_source(t))


def _source(t: Tables) -> str:
    """The events as a folder of files, which a file stream needs."""
    path = f"{_shared_folder(t)}/in"
    t.events.repartition(4, "event_id").write.parquet(path)
    return path


@query("SELECT min(event_id) AS event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY 2, 3, 4")
def stream_reading_ingest(t: Tables) -> DataFrame:
    """One row per user, type and day; which event stands for it is the first one, taken after the stream."""
    sink = _shared_folder(t)
    rows = _stream(t).select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "ts")
    ingest.stream_reading_ingest(rows, key=["event_id"], time="ts", sink=f"{sink}/out", checkpoint=f"{sink}/state", late="60 days").awaitTermination()
    kept = t.spark.read.parquet(f"{sink}/out")
    return kept.groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_latest_per_key(t: Tables) -> DataFrame:
    folder, key = _shared_folder(t), ["user_id", "event_type"]
    ingest.stream_latest_per_key(
        _stream(t), key=key, time="ts", tie="event_id", values=["event_id", "value"], sink=f"{folder}/out", checkpoint=f"{folder}/state"
    ).awaitTermination()
    return ingest.latest_per_key(t.spark, f"{folder}/out", key=key).select("user_id", "event_type", "newest.event_id", "newest.value")
