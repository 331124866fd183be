"""Exact duplicates, conflicts between sources, and what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollate.functions.text import truncate
from recollate.operators.rollups import SOURCE


def exact_groups(records: DataFrame, limit: int | None = None) -> DataFrame:
    """raw_hash, n, newest of every content that occurs more than once; largest, then newest first if limited."""
    groups = records.groupBy("raw_hash").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest")).filter("n > 1")
    if limit is None:
        return groups
    return groups.orderBy(F.col("n").desc(), F.col("newest").desc(), "raw_hash").limit(min(max(limit, 1), 100))


def exact_members(records: DataFrame) -> DataFrame:
    """Every member of a duplicate group. A group may hold a third of all rows, so it is neither gathered nor sorted as one."""
    groups = exact_groups(records).select("raw_hash")
    return records.join(groups, "raw_hash", "left_semi").select("raw_hash", "id", *SOURCE, "created_at")


def exact_counts(records: DataFrame) -> DataFrame:
    """Duplicate groups and records over the whole store."""
    return exact_groups(records).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def exact_counts_by_source(records: DataFrame) -> DataFrame:
    return records.join(exact_groups(records).select("raw_hash"), "raw_hash", "left_semi").groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("records"))


def conflict_groups(records: DataFrame) -> DataFrame:
    """Native ids that two adapters hold with different contents."""
    return (
        records.groupBy("native_id")
        .agg(F.count(F.lit(1)).alias("records"), F.countDistinct("adapter").alias("adapters"), F.countDistinct("raw_hash").alias("variants"))
        .filter("records > 1 AND adapters > 1 AND variants > 1")
    )


def conflict_variants(records: DataFrame, preview: int = 240) -> DataFrame:
    """Members of the conflicts; equal contents share a variant number, counted by first appearance in (adapter, id)."""
    members = records.join(conflict_groups(records).select("native_id"), "native_id", "left_semi")
    firsts = members.groupBy("native_id", "raw_hash").agg(F.min(F.struct("adapter", "id")).alias("first"))
    numbered = firsts.select("native_id", "raw_hash", F.row_number().over(Window.partitionBy("native_id").orderBy("first")).alias("variant"))
    return members.join(numbered, ["native_id", "raw_hash"]).select("native_id", "variant", "id", *SOURCE, truncate(F.col("content"), preview).alias("preview"))


def accept_variant(records: DataFrame, native_id: str, variant: int | None = None, record_id: str | None = None) -> DataFrame:
    """The plan of accepting a variant, given by its number or by one of its records: every member of the conflict with keep or forget; no row if there is no such variant."""
    members = conflict_variants(records.filter(F.col("native_id") == native_id))
    wanted = F.col("variant") == variant if variant is not None else F.col("id") == record_id
    chosen = members.filter(wanted).select("native_id", F.col("variant").alias("__chosen")).distinct()
    return members.join(chosen, "native_id").select("native_id", "id", "variant", F.when(F.col("variant") == F.col("__chosen"), "keep").otherwise("forget").alias("decision"))


def merge_preview(members: DataFrame, tags: DataFrame, group: str = "raw_hash") -> DataFrame:
    """Which member of each group to keep: most tags, then latest, with a path, least adapter, least id. The others are to be forgotten.

    The choice is one aggregate per group, so a group of any size is never sorted in one task.
    """
    count = tags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tag_count"))
    full = members.join(count, "doc_id", "left").select(
        group, "id", "adapter", F.coalesce("tag_count", F.lit(0)).alias("tag_count"), F.coalesce("updated_at", "created_at").alias("effective_at"), F.col("native_path").isNotNull().alias("has_path")
    )
    rank = F.struct(-F.col("tag_count"), -F.col("effective_at"), ~F.col("has_path"), F.col("adapter"), F.col("id"))
    kept = full.groupBy(group).agg(F.min(rank).getField("id").alias("kept"))
    return full.join(kept, group).withColumn("decision", F.when(F.col("id") == F.col("kept"), "keep").otherwise("forget")).drop("kept")


def identity_key() -> Column:
    """What makes two records of different sources the same item: the native id, else the content."""
    return F.coalesce(F.when(F.col("native_id") != "", F.concat(F.lit("n:"), "native_id")), F.concat(F.lit("h:"), "raw_hash"))


def reconcile(records: DataFrame, left: tuple[str, str | None], right: tuple[str, str | None]) -> DataFrame:
    """bucket, identity, left_id, right_id: only_left, only_right, same or conflict, between two sources (adapter, instance or None for all instances).

    Every left row counts; right rows of one identity collapse to the least id.
    """
    of = lambda s: records.filter((F.col("adapter") == s[0]) & (F.lit(s[1] is None) | (F.col("instance") == (s[1] or "")))).withColumn("identity", identity_key())
    a, b = of(left).select("identity", F.col("id").alias("left_id"), F.col("raw_hash").alias("left_hash")), of(right)
    first = b.groupBy("identity").agg(F.min(F.struct("id", "raw_hash")).alias("f")).select("identity", F.col("f.id").alias("right_id"), F.col("f.raw_hash").alias("right_hash"))
    matched = a.join(first, "identity", "left").select(
        F.when(F.col("right_id").isNull(), "only_left").when(F.col("left_hash") == F.col("right_hash"), "same").otherwise("conflict").alias("bucket"), "identity", "left_id", "right_id"
    )
    only_right = b.join(a.select("identity").distinct(), "identity", "left_anti").select(F.lit("only_right").alias("bucket"), "identity", F.lit(None).cast("string").alias("left_id"), F.col("id").alias("right_id"))
    return matched.unionByName(only_right)


def samples(buckets: DataFrame, limit: int = 10, include_identity: bool = False) -> DataFrame:
    """The first rows of each bucket (limit clamped to 1..100) in order of identity, which only comes out if asked for."""
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("identity", F.coalesce("left_id", "right_id")))
    kept = buckets.withColumn("n", n).filter(F.col("n") <= min(max(limit, 1), 100))
    return kept if include_identity else kept.drop("identity")


def bucket_records(buckets: DataFrame, records: DataFrame, bucket: str) -> DataFrame:
    """The records of a bucket, ready for an export: the right ones of only_right, else the left ones."""
    side = "right_id" if bucket == "only_right" else "left_id"
    return records.join(buckets.filter(F.col("bucket") == bucket).select(F.col(side).alias("id")).distinct(), "id", "left_semi")
