"""Streams: re-indexing of changed files, event-time windows, and stateful limits."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodeseek.operators.service import RATE_LIMIT, RATE_SECONDS, Limiter


def with_time(events: DataFrame, at: str = "ts") -> DataFrame:
    """events with a time that watermarks accept; the session's time zone should be UTC."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, keys: list[str], width: str, late: str = "1 hour", at: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums per window and key; works on a batch and on a stream."""
    ev = with_time(events, at).withWatermark(at, late)
    return ev.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, keys: list[str], width: str, step: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    ev = with_time(events, at).withWatermark(at, late)
    return ev.groupBy(F.window(at, width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    ev = with_time(events, at).withWatermark(at, late)
    return ev.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def admit_stream(events: DataFrame, key: str, at: str, tie: str, most: int = RATE_LIMIT, seconds: float = RATE_SECONDS) -> DataFrame:
    """Rate limit on a stream: the state of a key is its admitted times within the window. Events of a key must come in order of time."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, {tie} {events.schema[tie].dataType.simpleString()}, admitted boolean"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        limiter = Limiter(state.get[0] if state.exists else (), most, seconds)
        for part in parts:
            part = part.sort_values([at, tie])
            yield pd.DataFrame({key: part[key], tie: part[tie], "admitted": [limiter.admit(float(t)) for t in part[at]]})
        state.update((list(limiter.stamps),))

    return events.select(key, tie, at).groupBy(key).applyInPandasWithState(run, schema, "stamps array<double>", "append", "NoTimeout")


def reindex(files: DataFrame, extract, index_path: str, checkpoint: str) -> StreamingQuery:
    """Stream of changed files (file_path, content, ...) into an index partitioned by batch: rows of touched files are replaced.

    extract turns files into capsules. Each batch writes a new version of the index and then points to it by name, so a
    reader never sees half of one and a repeated batch gives the same version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = extract(batch)
        if number:
            old = spark.read.parquet(f"{index_path}/version={number - 1}")
            new = old.join(batch.select("file_path").distinct(), "file_path", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{index_path}/version={number}")

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
