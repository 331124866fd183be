"""The watch loop as Structured Streaming: bursts of changes settle, late ones overlap, repeats are absorbed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET, OVERLAP, POLL = "2 seconds", "5 seconds", "60 seconds"


def debounce(changes: DataFrame, source: str = "source", at: str = "ts", quiet: str = QUIET) -> DataFrame:
    """source, settled_at, changes: one row per burst, due once a source has been quiet; each change pushes the deadline. Batch or stream."""
    timed = changes.withWatermark(at, OVERLAP) if changes.isStreaming else changes
    burst = F.session_window(F.col(at), quiet)
    return timed.groupBy(burst.alias("burst"), source).agg(F.count(F.lit(1)).alias("changes")).select(source, F.col("burst.end").alias("settled_at"), "changes")


def without_repeats(rows: DataFrame, keys: list[str], at: str = "ts", overlap: str = OVERLAP) -> DataFrame:
    """Rows read again in the overlap of two scans are dropped by key and content; state lives no longer than the watermark."""
    if rows.isStreaming:
        return rows.withWatermark(at, overlap).dropDuplicatesWithinWatermark(keys)
    return rows.dropDuplicates(keys)


def route(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """path, source of each change: the source whose root is the longest prefix of the path, null if none is.

    An equi-join on every ancestor folder of the path, so no pair of path and root is compared that cannot match.
    """
    parts = F.split(F.col("path"), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = changes.select("path", F.explode(ups).alias("root"))
    best = each.join(roots.select("root", "source"), "root").groupBy("path").agg(F.max_by("source", F.length("root")).alias("source"))
    return changes.select("path").distinct().join(best, "path", "left")


def windowed_counts(events: DataFrame, at: str, size: str, slide: str | None, *by: str) -> DataFrame:
    """Counts per tumbling or sliding window; late events are taken up to the overlap. An extension, there is no such query in the store itself."""
    timed = events.withWatermark(at, OVERLAP) if events.isStreaming else events
    return timed.groupBy(F.window(at, size, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def follow(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, catch_up: bool = False) -> StreamingQuery:
    """Run apply on each batch: what is there and then stop (catch_up), or every POLL. apply must be idempotent, as a batch may come twice."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if catch_up else writer.trigger(processingTime=POLL)).start()


def remember(batch: DataFrame, number: int, path: str) -> None:
    """One step of the state of each source: what this batch adds, under the batch's number, so that a batch that comes twice counts once."""
    batch.groupBy("source").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("seen")).write.mode("overwrite").parquet(f"{path}/step={number}")


def remembered(spark: SparkSession, path: str) -> DataFrame:
    """source, last, seen over all batches so far."""
    return spark.read.parquet(path).groupBy("source").agg(F.max("last").alias("last"), F.sum("seen").alias("seen"))


def heartbeat(query: StreamingQuery, now: float, stale_after: float = 45.0) -> str:
    """alive, stale or stopped, from the last progress of a query."""
    if not query.isActive:
        return "stopped"
    progress = query.lastProgress
    if not progress:
        return "alive"
    from datetime import datetime

    last = datetime.fromisoformat(str(progress["timestamp"]).replace("Z", "+00:00")).timestamp()
    return "stale" if now - last > stale_after else "alive"


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last version of each key within a batch."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
