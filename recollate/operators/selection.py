"""Projections, filters and pages over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = ["id", "adapter", "instance", "kind", "scope", "created_at", "updated_at", "native_id", "native_path", "raw_hash"]


def csv_values(text: str | None) -> list[str]:
    """The values of a comma list: trimmed, empty ones dropped, order and case kept."""
    return [v for v in (p.strip() for p in (text or "").split(",")) if v]


def csv_filter(df: DataFrame, adapter: str | None = None, instance: str | None = None) -> DataFrame:
    """Rows whose adapter and instance are each among the listed ones; an empty list admits all."""
    for column, text in (("adapter", adapter), ("instance", instance)):
        if values := csv_values(text):
            df = df.filter(F.col(column).isin(values))
    return df


def retrieval_filter(
    df: DataFrame,
    adapter: str | None = None,
    instance: str | None = None,
    kind: str | None = None,
    scope: str | None = None,
    time_from: int | None = None,
    time_to: int | None = None,
    tags: DataFrame | None = None,
    tag: str | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Conjunction of equalities, an inclusive time range on created_at and a user tag; to be applied before any limit."""
    for column, value in (("adapter", adapter), ("instance", instance), ("kind", kind), ("scope", scope)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if time_from is not None:
        df = df.filter(F.col("created_at") >= time_from)
    if time_to is not None:
        df = df.filter(F.col("created_at") <= time_to)
    if tag is not None and tags is not None:
        df = df.join(tags.filter(F.col("tag") == tag).select(key), key, "left_semi")
    return df


def headers(df: DataFrame, tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records without content, with their user tags as a sorted list."""
    own = tags.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("user_tags"))
    return df.select(key, *HEADER).join(own, key, "left").withColumn("user_tags", F.coalesce("user_tags", F.lit("")))


def group_preserving(df: DataFrame, group: list[str], condition: Column) -> DataFrame:
    """All members of every group of which any member meets the condition."""
    return df.join(df.filter(condition).select(*group).distinct(), group, "left_semi")


def day(df: DataFrame, start: int) -> DataFrame:
    """Records created within 24 hours of start (Unix seconds), the end excluded."""
    return df.filter((F.col("created_at") >= start) & (F.col("created_at") < start + 86400))


def since(df: DataFrame, at: int | None, column: str, full: bool = False) -> DataFrame:
    """Incremental scan: strictly later rows; rows without time pass; full wins over since."""
    return df if full or at is None else df.filter(F.col(column).isNull() | (F.col(column) > at))


def page(df: DataFrame, cursor: str | None, limit: int, key: str = "id") -> DataFrame:
    """Keyset page: the next rows after the cursor; limit is clamped to 1..1000."""
    if cursor is not None:
        df = df.filter(F.col(key) > cursor)
    return df.orderBy(key).limit(min(max(limit, 1), 1000))


def page_with_cursor(df: DataFrame, cursor: str | None, limit: int, key: str = "id") -> DataFrame:
    """The page, and on every row the cursor of the next one: the last key if the page is full, else null."""
    size = min(max(limit, 1), 1000)
    rows = page(df, cursor, limit, key)
    end = rows.agg(F.count(F.lit(1)).alias("__n"), F.max(key).alias("__last"))
    return rows.crossJoin(F.broadcast(end)).withColumn("next_cursor", F.when(F.col("__n") == size, F.col("__last"))).drop("__n", "__last")  # one row


def redacted(df: DataFrame, hidden: list[str], show: bool = False) -> DataFrame:
    """Without the hidden columns, which leave only whether they were there."""
    if show:
        return df
    return df.select(*[c for c in df.columns if c not in hidden], *[F.col(c).isNotNull().alias(f"has_{c}") for c in hidden])


def top(df: DataFrame, limit: int, *order: Column, most: int = 100) -> DataFrame:
    """The first rows in a total order; limit is clamped to 1..most."""
    return df.orderBy(*order).limit(min(max(limit, 1), most))
