"""Streaming operators over several runs on one sink and checkpoint."""

from __future__ import annotations

from datetime import datetime

from casework.streaming import ingest


def test_latest_per_key_goes_on_where_it_stopped(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "k string, event_id long, ts timestamp, value double"

    def arrive(*rows):
        spark.createDataFrame([(k, i, datetime(2024, 1, day), v) for k, i, day, v in rows], schema).write.mode("append").parquet(source)

    def newest():
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.stream_latest_per_key(stream, key=["k"], time="ts", tie="event_id", values=["event_id", "value"], sink=sink, checkpoint=state).awaitTermination()
        return {r.k: tuple(r.newest) for r in ingest.latest_per_key(spark, sink, key=["k"]).collect()}

    arrive()
    assert newest() == {}
    arrive(("a", 1, 5, 1.0), ("a", 2, 5, 2.0), ("b", 3, 1, 3.0))
    assert newest() == {"a": (2, 2.0), "b": (3, 3.0)}
    arrive(("a", 9, 4, 9.0), ("b", 4, 2, None), ("c", 5, 1, 5.0))
    assert newest() == {"a": (2, 2.0), "b": (4, None), "c": (5, 5.0)}
    assert newest() == {"a": (2, 2.0), "b": (4, None), "c": (5, 5.0)}
