"""Counts, inventories and percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollate.functions.text import freshness

SOURCE = ["adapter", "instance"]


def source_inventory(records: DataFrame, tags: DataFrame, chunks: DataFrame) -> DataFrame:
    """Records, chunks and tagged records of each source; each side is counted before it is joined."""
    total = records.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("records"))
    pieces = chunks.join(records.select("doc_id", *SOURCE), "doc_id").groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("chunks"))
    tagged = records.join(tags.select("doc_id").distinct(), "doc_id", "left_semi").groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("tagged"))
    out = total.join(pieces, SOURCE, "left").join(tagged, SOURCE, "left")
    return out.select(*SOURCE, "records", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tagged", F.lit(0)).alias("tagged"))


def last_seen(records: DataFrame) -> DataFrame:
    return records.groupBy(*SOURCE).agg(F.max("created_at").alias("last_seen"))


def status(records: DataFrame, now: int, fresh_seconds: int = 86400) -> DataFrame:
    """How many sources are fresh, stale or have never been read."""
    return last_seen(records).groupBy(freshness(F.col("last_seen"), now, fresh_seconds).alias("status")).agg(F.count(F.lit(1)).alias("sources"))


def doctor(records: DataFrame, sources: DataFrame, errors: DataFrame, now: int, stale_after: int) -> DataFrame:
    """One row: registered sources, those ok, stale (or never imported) and unhealthy (with import errors), and sources of records that aren't registered."""
    seen = last_seen(records)
    failed = errors.select(*SOURCE).distinct().withColumn("failed", F.lit(True))
    joined = sources.select(*SOURCE, F.lit(True).alias("registered")).join(seen, SOURCE, "full_outer").join(failed, SOURCE, "left")
    known, bad = F.coalesce("registered", F.lit(False)), F.coalesce("failed", F.lit(False))
    stale = F.col("last_seen").isNull() | (F.lit(now) - F.col("last_seen") > stale_after)
    return joined.agg(F.count_if(known).alias("registered"), F.count_if(known & ~stale & ~bad).alias("ok"), F.count_if(known & stale).alias("stale"), F.count_if(known & bad).alias("unhealthy"), F.count_if(~known).alias("unregistered"))


def source_show(records: DataFrame, chunks: DataFrame, errors: DataFrame, adapter: str, instance: str, now: int, error_limit: int = 5) -> DataFrame:
    """One row of a source: records, chunks, last_seen, freshness, and its newest errors (at most 10) as phases."""
    own = lambda df: df.filter((F.col("adapter") == adapter) & (F.col("instance") == instance))
    total = own(records).agg(F.count(F.lit(1)).alias("records"), F.max("created_at").alias("last_seen"))
    pieces = chunks.join(own(records).select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    newest = own(errors).orderBy(F.col("occurred_at").desc(), F.col("error_id").desc()).limit(min(max(error_limit, 1), 10))
    listed = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("occurred_at"), -F.col("error_id"), F.col("phase").alias("phase")))), lambda x: x["phase"]), ",").alias("errors"))
    return total.crossJoin(pieces).crossJoin(listed).select("records", "chunks", "last_seen", freshness(F.col("last_seen"), now).alias("freshness"), "errors")


def global_counts(**tables: DataFrame) -> DataFrame:
    """name, n of each table in one result."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()))


def record_summary(records: DataFrame, chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """doc_id, chunks, embedded: how many chunks each record has, and how many of them a vector of the model for their present content."""
    done = embeddings.filter(F.col("model_id") == model).select("chunk_id", "content_hash", F.lit(1).alias("one")).distinct()
    counted = chunks.join(done, ["chunk_id", "content_hash"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("one").alias("embedded"))
    return records.select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"))


def latency(metrics: DataFrame) -> DataFrame:
    """Calls, errors, nearest-rank percentiles and the last duration of each tool."""
    return metrics.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        *[F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY duration_ms) AS BIGINT)").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
        F.max_by("duration_ms", F.struct("started_at", "event_id")).alias("last_ms"),
    )


def counts_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def keep_last(metrics: DataFrame, most: int = 5000) -> DataFrame:
    """The newest rows of a log that is capped by number; the cap is the feature."""
    newest = metrics.agg(F.max("event_id").alias("__newest"))
    return metrics.crossJoin(F.broadcast(newest)).filter(F.col("event_id") > F.col("__newest") - most).drop("__newest")  # one row


def tail(log: DataFrame, limit: int, actions: list[str] | None = None, since: int | None = None) -> DataFrame:
    """The last entries after filtering, in order of time."""
    if actions:
        log = log.filter(F.col("tool").isin(actions))
    if since is not None:
        log = log.filter(F.col("started_at") >= since)
    return log.orderBy(F.col("event_id").desc()).limit(min(max(limit, 1), 1000)).orderBy("event_id")


def mixed_dimensions(vectors: DataFrame) -> DataFrame:
    """Models whose vectors differ in length."""
    return vectors.groupBy("model").agg(F.countDistinct(F.size("embedding")).alias("dims")).filter("dims > 1")
