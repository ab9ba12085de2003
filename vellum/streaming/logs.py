"""Log analytics: look-back counts in batch, minute windows as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def look_back(df: DataFrame, minutes: tuple[int, ...] = (1, 5, 60, 1440)) -> DataFrame:
    """Rows of the last minutes before the latest one, errors of the last day, all rows."""
    last = df.agg(F.max("ts").alias("m"))
    since = lambda k: F.col("ts") > F.col("m") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(k), F.lit(0.0))
    return df.join(F.broadcast(last), F.lit(True)).agg(
        *[F.count_if(since(k)).alias(f"last_{k}") for k in minutes], F.count_if(since(minutes[-1]) & (F.col("event_type") == "error")).alias("errors"), F.count("*").alias("total")
    )


def by_conversation(df: DataFrame, since: str | None = None) -> DataFrame:
    """conversation_id, n of the rows from ``since`` on, that moment included."""
    rows = df if since is None else df.where(F.col("timestamp") >= since)
    return rows.groupBy("conversation_id").agg(F.count("*").alias("n"))


def page(df: DataFrame, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of the log, the newest rows first."""
    return df.orderBy(F.desc("id")).offset(size * number).limit(size)


def minute_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Rows and mean value by window and type; rows later than ``late`` are left to the batch."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
