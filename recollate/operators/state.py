"""The write side as pure functions: each takes the current snapshot and returns the next one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollate.operators.graph import opaque
from recollate.session import cut

#: Columns that an update never changes.
KEPT = ("created_at", "captured_at", "native_id", "schema_version")


def latest_version(incoming: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: the latest updated_at, then created_at, then the least raw_hash."""
    order = Window.partitionBy(key).orderBy(F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("raw_hash"))
    return incoming.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def upsert(current: DataFrame, incoming: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """The next snapshot: tombstoned rows are refused, unchanged ones (same raw_hash) stay, others replace all but KEPT. Of several incoming rows of a key the latest version counts."""
    fresh = latest_version(incoming.join(tombstones.select(key).distinct(), key, "left_anti"), key)
    old = current.select(F.col(key), *[F.col(c).alias(f"__old_{c}") for c in current.columns if c != key], F.lit(True).alias("__known"))
    merged = old.join(fresh.withColumn("__new", F.lit(True)), key, "full_outer")
    change = F.col("__new") & (F.col("__known").isNull() | ~F.col("__old_raw_hash").eqNullSafe(F.col("raw_hash")))
    pick = [
        F.coalesce(F.col(f"__old_{c}"), F.col(c)).alias(c) if c in KEPT else F.when(F.coalesce(change, F.lit(False)), F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c)
        for c in current.columns
        if c != key
    ]
    return merged.select(key, *pick).select(*current.columns)


def upsert_outcome(current: DataFrame, incoming: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """key, outcome of every incoming key: refused, unchanged, updated or inserted, judged by the version that upsert takes."""
    new = latest_version(incoming, key).select(key, F.col("raw_hash").alias("new_hash"))
    dead = tombstones.select(F.col(key), F.lit(True).alias("dead")).distinct()
    seen = current.select(key, F.col("raw_hash").alias("old_hash"), F.lit(True).alias("known"))
    joined = new.join(dead, key, "left").join(seen, key, "left")
    outcome = F.when(F.col("dead"), "refused").when(F.col("known").isNull(), "inserted").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("updated")
    return joined.select(key, outcome.alias("outcome"))


def replace_chunks(chunks: DataFrame, outcomes: DataFrame, new_chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunk table after an upsert: chunks of updated records go, those of updated and inserted ones come. Others are not touched."""
    changed = outcomes.filter("outcome IN ('updated', 'inserted')").select(key)
    return chunks.join(changed, key, "left_anti").unionByName(new_chunks.join(changed, key, "left_semi"))


def import_summary(outcomes: DataFrame, new_chunks: DataFrame, errors: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: raw_seen, upserted, unchanged, refused, chunks written, errors."""
    changed = outcomes.filter("outcome IN ('updated', 'inserted')").select(key)
    counts = outcomes.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("outcome").isin("updated", "inserted")).alias("upserted"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged"), F.count_if(F.col("outcome") == "refused").alias("refused"))
    written = new_chunks.join(changed, key, "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    failed = errors.agg(F.count(F.lit(1)).alias("errors"))
    return counts.crossJoin(written).crossJoin(failed).select((F.col("seen") + F.col("errors")).alias("raw_seen"), "upserted", "unchanged", "refused", "chunks", "errors")


def register(sources: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """adapter, instance, added_at, last_import_at: the registry with the new sources; one that is known keeps when it was added."""
    keys = ["adapter", "instance"]
    return sources.unionByName(new.select(*keys, F.lit(now).cast("long").alias("added_at"), F.lit(None).cast("long").alias("last_import_at"))).groupBy(*keys).agg(F.min("added_at").alias("added_at"), F.max("last_import_at").alias("last_import_at"))


def deregister(sources: DataFrame, gone: DataFrame) -> DataFrame:
    return sources.join(gone.select("adapter", "instance").distinct(), ["adapter", "instance"], "left_anti")


def stamp(sources: DataFrame, imported: DataFrame, now: int) -> DataFrame:
    """The registry after an import of some sources at now."""
    done = imported.select("adapter", "instance", F.lit(now).cast("long").alias("__at")).distinct()
    return sources.join(done, ["adapter", "instance"], "left").select("adapter", "instance", "added_at", F.coalesce("__at", "last_import_at").alias("last_import_at"))


def with_descendants(ids: DataFrame, records: DataFrame, key: str = "doc_id", up: str = "derived_from") -> DataFrame:
    """The keys and all that is derived from any of them, at any depth, each once; level by level, cut in the shared folder, cycles end."""
    edges = opaque(records, **{key: key, "__up": up})
    found = cut(edges.join(ids.select(key).distinct(), key, "left_semi").select(key))
    frontier = found
    while not frontier.isEmpty():
        below = edges.join(frontier.select(F.col(key).alias("__up")), "__up").select(key).distinct()
        frontier = cut(below.join(found, key, "left_anti"))
        found = cut(found.unionByName(frontier))
    return found


def forget_outcome(ids: DataFrame, records: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    """key, outcome: forgotten, already_forgotten or not_found, of every key asked for."""
    dead, known = tombstones.select(F.col(key), F.lit(True).alias("dead")).distinct(), records.select(F.col(key), F.lit(True).alias("known")).distinct()
    joined = ids.select(key).distinct().join(dead, key, "left").join(known, key, "left")
    return joined.select(key, F.when(F.col("dead"), "already_forgotten").when(F.col("known"), "forgotten").otherwise("not_found").alias("outcome"))


def forget_preview(gone: DataFrame, key: str = "doc_id", **tables: DataFrame) -> DataFrame:
    """table, rows: how many rows of each dependent table go with the records, without changing anything."""
    parts = [df.join(gone.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def forget(records: DataFrame, tombstones: DataFrame, ids: DataFrame, now: int, reason: str | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(records, tombstones) after forgetting the ids; unknown ids change nothing, forgotten ones keep their first tombstone."""
    gone = records.join(ids.select(key).distinct(), key, "left_semi").join(tombstones.select(key), key, "left_anti")
    stones = gone.select(key, *[c for c in ("adapter", "instance", "raw_hash", "derived_from") if c in gone.columns], F.lit(reason).cast("string").alias("reason"), F.lit(now).cast("long").alias("forgotten_at"))
    return records.join(ids.select(key).distinct(), key, "left_anti"), tombstones.unionByName(stones, allowMissingColumns=True)


def unforget(tombstones: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Tombstones without those of the ids; content doesn't come back until the next import."""
    return tombstones.join(ids.select(key).distinct(), key, "left_anti")


def live(records: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    return records.join(tombstones.select(key).distinct(), key, "left_anti")


def tag(tags: DataFrame, keys: DataFrame, names: list[str], operation: str, key: str = "doc_id") -> DataFrame:
    """The tag table after adding, removing or replacing tags (at most 32) of the keys; a set."""
    if operation not in ("add", "remove", "replace"):
        raise ValueError(f"unknown operation {operation!r}")
    if len(names) > 32:
        raise ValueError("more than 32 tags")
    wanted = keys.select(key).distinct().select(key, F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("tag"))
    if operation == "add":
        return tags.select(key, "tag").unionByName(wanted).distinct()
    if operation == "remove":
        return tags.select(key, "tag").distinct().join(wanted, [key, "tag"], "left_anti")
    return tags.select(key, "tag").distinct().join(keys.select(key).distinct(), key, "left_anti").unionByName(wanted)


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model for their present content: the queue of work, derived instead of kept."""
    done = embeddings.filter(F.col("model_id") == model).select("chunk_id", "content_hash")
    return chunks.join(done, ["chunk_id", "content_hash"], "left_anti")


def hashed_vector(content: Column, dim: int = 4) -> Column:
    """A vector for tests and offline use, from the MD5 of the content: equal texts have equal vectors, others don't."""
    return F.array(*[F.conv(F.substring(F.md5(content), 1 + 4 * i, 4), 16, 10).cast("double") / 65535.0 for i in range(dim)])


# The models a store may choose, by key: dimensions, prefix of queries, prefix of documents, whether it runs locally.
MODELS = {
    "default": (384, "query: ", "passage: ", True), "tiny": (384, None, None, True), "en": (384, "Represent this sentence for searching relevant passages: ", None, True),
    "multi-strong": (768, "query: ", "passage: ", True), "cloud-voyage": (1024, None, None, False),
}


def model_list(spark: SparkSession, active: str = "default") -> DataFrame:
    rows = [(k, dim, q, p, local, k == active) for k, (dim, q, p, local) in MODELS.items()]
    return spark.createDataFrame(rows, "key string, dim int, query_prefix string, doc_prefix string, is_local boolean, is_active boolean")


def drain(queue: DataFrame, model: str, provider: Callable[[Column], Column] = hashed_vector, dim: int = 4) -> tuple[DataFrame, DataFrame]:
    """(embeddings, failures) of the queued chunks: a provider's vector of another length, or none, is a failure, and stays in the queue as it is missing."""
    done = queue.select("chunk_id", "content_hash", F.lit(model).alias("model_id"), provider(F.col("content")).alias("embedding"))
    fits = F.coalesce(F.size("embedding") == dim, F.lit(False))
    return done.filter(fits), done.filter(~fits).select("chunk_id", "model_id", F.concat(F.lit("length "), F.coalesce(F.size("embedding"), F.lit(0)).cast("string")).alias("error"))


def repair(chunks: DataFrame, embeddings: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, embeddings) without what belongs to no record, or to no chunk of that content; what is missing is queued by missing_embeddings."""
    kept = chunks.join(records.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept, embeddings.join(kept.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")


def verify(records: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per check with the number of offenders."""
    checks = {
        "records_without_chunks": records.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti"),
        "chunks_without_record": chunks.join(records.select("doc_id"), "doc_id", "left_anti"),
        "chunks_without_embedding": chunks.join(embeddings.select("chunk_id").distinct(), "chunk_id", "left_anti"),
        "embeddings_without_chunk": embeddings.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti"),
    }
    out = None
    for name, offenders in checks.items():
        row = offenders.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out
