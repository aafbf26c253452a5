"""Streams: present state from a stream of deliveries, and activations of a session once each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.common import shared_dir
from quarryline.operators import changefeed


def folded(stream: DataFrame, key: str, revision: str, seq: str, op: str, fields: list[str], into: str, checkpoint: str) -> None:
    """Reduce every batch of a stream of deliveries to one patch per record and append it below ``into``.

    Patches compose in any order and a repeated one changes nothing, so a batch that is run again after a failure
    does no harm. Runs until the stream's available rows are through.
    """

    def batch(df: DataFrame, number: int) -> None:
        got = changefeed.compose(changefeed.patches(df, key, revision, seq, op, fields))
        got.write.mode("overwrite").parquet(f"{into}/batch={number}")

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def state_of(spark: SparkSession, into: str, key: str, fields: list[str]) -> DataFrame:
    """Present state from the patches below ``into``: (key, revision, *fields), without deleted records."""
    return changefeed.applied(changefeed.composed(spark.read.parquet(into), "_key"), key, "revision", fields)


def streamed_state(spark: SparkSession, path: str, key: str, revision: str, seq: str, op: str, fields: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Present state of a table read as a stream; the same rows as from the table at once."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark).rstrip('/')}/quarryline-{uuid.uuid4().hex}"
    # a pattern, since a stream takes a plain path for a folder
    stream = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[{path[-1]}]"))
    folded(stream, key, revision, seq, op, fields, f"{base}/patches", f"{base}/checkpoint")
    return state_of(spark, f"{base}/patches", key, fields)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """The stream with its time in UTC (a watermark takes no time without a zone)."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_activations(stream: DataFrame, session: str, target: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each (session, target) once, as a stream; the state of a pair is dropped once it can't come again in time."""
    return _timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark([session, target])


def activity_windows(stream: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): rows per window and type; a window is final when the watermark has passed it."""
    w = _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")
