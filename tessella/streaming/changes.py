"""File changes and usage as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesced(events: DataFrame) -> DataFrame:
    """The last event of each path in a batch (path, change, at)."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at"), "change"))
    return events.withColumn("__n", last).where("__n = 1").drop("__n")


def follow(events: DataFrame, upsert: Callable[[DataFrame], None], remove: Callable[[DataFrame], None], checkpoint: str, **trigger):
    """Starts a query that hands each batch's changes on. Both functions must bear being run again for a batch."""

    def batch(df: DataFrame, _: int) -> None:
        # Each function reads the batch once; it isn't kept in between.
        changes = coalesced(df)
        upsert(changes.where("change = 'upsert'"))
        remove(changes.where("change = 'remove'"))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def timed(events: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """With a watermark; a time without zone is taken as of the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def usage_windows(events: DataFrame, length: str = "7 days", slide: str | None = "1 day", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events and their values by window and keys: sliding, or tumbling without a slide."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first of repeated events within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)
