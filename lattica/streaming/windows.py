"""Windows and queues, for tables and for streams alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, width: str, *by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """(start, by..., n) for windows of one width."""
    g = _marked(events, ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """(by..., start, n) for runs of events less than ``gap`` apart."""
    g = _marked(events, ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*by, F.col("w.start").alias("start"), "n")


def latest(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row's columns for each key."""
    return events.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def watch(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """A query over JSON lines that arrive under ``path``: each micro-batch is coalesced to
    the newest line of each ``path`` value, by ``seq``, and handed on."""

    def batch(df: DataFrame, number: int) -> None:
        rest = [c for c in df.columns if c not in ("path", "seq")]
        handle(latest(df, "path", "seq", *rest), number)

    stream = spark.readStream.schema(schema).json(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
