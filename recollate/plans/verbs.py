"""Lookups, reports and changes of the store as queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollate.operators import chunking, duplicates, extraction, graph, rollups, selection, state
from recollate.plans import catalog, model
from recollate.plans.catalog import NOW, RECONCILE, VECTORS, embedded, query
from recollate.tables import table

# --- lookups


@query("SELECT doc_id, id, adapter, instance, content FROM records WHERE id = (SELECT id FROM records WHERE doc_id = 7)")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    records = model.records(s, d)
    wanted = records.filter("doc_id = 7").select("id")
    return records.join(wanted, "id", "left_semi").select("doc_id", "id", "adapter", "instance", "content")


@query("SELECT doc_id, id, kind FROM records WHERE doc_id IN (1, 5, 8, 99999999)")
def in_list_lookup(s: SparkSession, d: str) -> DataFrame:
    return model.records(s, d).filter(F.col("doc_id").isin(1, 5, 8, 99999999)).select("doc_id", "id", "kind")


@query("SELECT chunk_id, doc_id, content FROM chunks WHERE chunk_id = '7:0'")
def chunk_lookup(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(model.records(s, d).filter("doc_id = 7")).filter("chunk_id = '7:0'").select("chunk_id", "doc_id", "content")


@query(f"WITH {VECTORS} SELECT doc_id, count(c.chunk_id) AS chunks, count(v.chunk_id) AS embedded FROM records LEFT JOIN chunks c USING (doc_id) LEFT JOIN (SELECT DISTINCT chunk_id, content_hash FROM vectors WHERE model_id = 'small') v ON v.chunk_id = c.chunk_id AND v.content_hash = c.content_hash GROUP BY doc_id")
def record_summary(s: SparkSession, d: str) -> DataFrame:
    return rollups.record_summary(model.records(s, d), *embedded(s, d), "small")


_ONE = f"""WITH {VECTORS}, kids AS (SELECT derived_from AS doc_id, count(*) AS children FROM records WHERE derived_from IS NOT NULL GROUP BY 1), own AS (SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS user_tags FROM tags GROUP BY 1),
 counts AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1) SELECT r.doc_id, r.id, r.kind, coalesce(chunks, 0) AS chunks, coalesce(user_tags, '') AS user_tags, p.id AS parent, coalesce(children, 0) AS children
 FROM records r LEFT JOIN counts USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN records p ON p.doc_id = r.derived_from LEFT JOIN kids ON kids.doc_id = r.doc_id"""


@query(_ONE)
def get_record(s: SparkSession, d: str) -> DataFrame:
    """Every record as get_record shows one: its summary, user tags, parent and number of children."""
    records = model.records(s, d)
    counts = chunking.chunks(records).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    kids = records.filter("derived_from IS NOT NULL").groupBy(F.col("derived_from").alias("doc_id")).agg(F.count(F.lit(1)).alias("children"))
    parents = records.select(F.col("doc_id").alias("derived_from"), F.col("id").alias("parent"))
    own = selection.headers(records, model.tags(s, d)).select("doc_id", "user_tags")
    full = records.select("doc_id", "id", "kind", "derived_from").join(counts, "doc_id", "left").join(own, "doc_id", "left").join(parents, "derived_from", "left").join(kids, "doc_id", "left")
    return full.select("doc_id", "id", "kind", F.coalesce("chunks", F.lit(0)).alias("chunks"), "user_tags", "parent", F.coalesce("children", F.lit(0)).alias("children"))


@query("SELECT chunk_id, id AS record_id, adapter, instance, native_id, native_path, raw_hash, created_at FROM chunks JOIN records USING (doc_id)")
def trace_provenance(s: SparkSession, d: str) -> DataFrame:
    """Where each chunk comes from."""
    records = model.records(s, d)
    return chunking.chunks(records).select("doc_id", "chunk_id").join(records.withColumnRenamed("id", "record_id"), "doc_id").select("chunk_id", "record_id", "adapter", "instance", "native_id", "native_path", "raw_hash", "created_at")


@query("SELECT id FROM records ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_ids(s: SparkSession, d: str) -> DataFrame:
    return selection.top(model.records(s, d).select("id", "created_at"), 50, F.col("created_at").desc(), F.col("id").desc()).select("id")


@query("WITH p AS (SELECT id FROM records WHERE id > '8' ORDER BY id LIMIT 100) SELECT id, CASE WHEN (SELECT count(*) FROM p) = 100 THEN (SELECT max(id) FROM p) END AS next_cursor FROM p")
def resource_page(s: SparkSession, d: str) -> DataFrame:
    return selection.page_with_cursor(model.records(s, d).select("id"), "8", 100)


# --- reports


@query(f"WITH {VECTORS} SELECT 'records' AS name, count(*) AS n FROM records UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'embeddings', count(*) FROM vectors UNION ALL SELECT 'tombstones', count(*) FROM tombstones UNION ALL SELECT 'import_errors', count(*) FROM import_errors UNION ALL SELECT 'sources', count(*) FROM (SELECT DISTINCT adapter, instance FROM records)")
def global_counts(s: SparkSession, d: str) -> DataFrame:
    chunks, vectors = embedded(s, d)
    records = model.records(s, d)
    return rollups.global_counts(records=records, chunks=chunks, embeddings=vectors, tombstones=model.tombstones(s, d), import_errors=model.import_errors(s, d), sources=records.select("adapter", "instance").distinct())


@query(
    f"""WITH one AS (SELECT adapter, instance FROM import_errors WHERE instance <> '' ORDER BY error_id LIMIT 1), r AS (SELECT doc_id, created_at FROM records JOIN one USING (adapter, instance)), e AS (SELECT phase, occurred_at, error_id FROM import_errors JOIN one USING (adapter, instance) ORDER BY occurred_at DESC, error_id DESC LIMIT 5)
 SELECT (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM r)) AS chunks, (SELECT max(created_at) FROM r) AS last_seen, CASE WHEN {NOW} - (SELECT max(created_at) FROM r) < 86400 THEN 'fresh' ELSE 'stale' END AS freshness, (SELECT string_agg(phase, ',' ORDER BY occurred_at DESC, error_id DESC) FROM e) AS errors"""
)
def source_show(s: SparkSession, d: str) -> DataFrame:
    """The source of the first import error."""
    errors = model.import_errors(s, d)
    one = errors.filter("instance <> ''").orderBy("error_id").select("adapter", "instance").first()
    return rollups.source_show(model.records(s, d), chunking.chunks(model.records(s, d)), errors, *(one or ("", "")), NOW)


@query("SELECT string_agg('- ' || left(content, 240), chr(10) ORDER BY created_at DESC, id) AS prompt FROM (SELECT content, created_at, id FROM records WHERE scope = 'user' AND kind = 'preference' ORDER BY created_at DESC, id LIMIT 20)")
def prompt_preferences(s: SparkSession, d: str) -> DataFrame:
    newest = model.records(s, d).filter("scope = 'user' AND kind = 'preference'").orderBy(F.col("created_at").desc(), "id").limit(20)
    return catalog._bullets(newest.select(F.lit(1).alias("one"), (-F.col("created_at")).alias("age"), "id", "content"), "one", ["age", "id"], "prompt").select("prompt")


@query("SELECT * FROM (VALUES ('default', 384, TRUE, TRUE), ('tiny', 384, TRUE, FALSE), ('en', 384, TRUE, FALSE), ('multi-strong', 768, TRUE, FALSE), ('cloud-voyage', 1024, FALSE, FALSE)) AS t(key, dim, is_local, is_active)")
def model_list(s: SparkSession, d: str) -> DataFrame:
    return state.model_list(s).select("key", "dim", "is_local", "is_active")


@query(RECONCILE + " SELECT bucket, CAST(n AS INTEGER) AS n, left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY identity, coalesce(left_id, right_id)) AS n FROM buckets) WHERE n <= 10")
def reconcile_samples(s: SparkSession, d: str) -> DataFrame:
    return duplicates.samples(duplicates.reconcile(model.records(s, d), ("mem0", None), ("letta", None)))


@query(RECONCILE + " SELECT id, adapter, content FROM records WHERE id IN (SELECT right_id FROM buckets WHERE bucket = 'only_right')")
def reconcile_export_bucket(s: SparkSession, d: str) -> DataFrame:
    records = model.records(s, d)
    return duplicates.bucket_records(duplicates.reconcile(records, ("mem0", None), ("letta", None)), records, "only_right").select("id", "adapter", "content")


_CONFLICT = "one AS (SELECT native_id FROM records GROUP BY 1 HAVING count(DISTINCT adapter) > 1 AND count(DISTINCT raw_hash) > 1 ORDER BY 1 LIMIT 1), firsts AS (SELECT native_id, raw_hash, min(concat(adapter, chr(1), id)) AS f FROM records JOIN one USING (native_id) GROUP BY 1, 2), numbered AS (SELECT native_id, raw_hash, row_number() OVER (PARTITION BY native_id ORDER BY f) AS variant FROM firsts)"


@query(f"WITH {_CONFLICT} SELECT native_id, id, CAST(variant AS INTEGER) AS variant, CASE WHEN variant = 2 THEN 'keep' ELSE 'forget' END AS decision FROM records JOIN numbered USING (native_id, raw_hash)")
def accept_variant(s: SparkSession, d: str) -> DataFrame:
    """Variant 2 of the first conflict is accepted."""
    records = model.records(s, d)
    one = duplicates.conflict_groups(records).orderBy("native_id").select("native_id").first()
    return duplicates.accept_variant(records, one[0] if one else "", 2)


# --- changes

_ASKED = "asked AS (SELECT doc_id, id FROM records WHERE kind = 'reference' AND doc_id % 10 = 0 UNION ALL SELECT 99999999, 'nowhere')"
_DOWN = "down AS (SELECT doc_id FROM asked JOIN records USING (doc_id) UNION SELECT r.doc_id FROM records r JOIN down ON r.derived_from = down.doc_id)"


def _asked(s: SparkSession, d: str) -> DataFrame:
    return model.records(s, d).filter("kind = 'reference' AND doc_id % 10 = 0").select("doc_id", "id").unionByName(s.createDataFrame([(99999999, "nowhere")], "doc_id long, id string"))


@query(f"WITH {_ASKED} SELECT a.id, CASE WHEN t.record_id IS NOT NULL THEN 'already_forgotten' WHEN r.id IS NOT NULL THEN 'forgotten' ELSE 'not_found' END AS outcome FROM asked a LEFT JOIN tombstones t ON t.record_id = a.id LEFT JOIN records r ON r.id = a.id")
def forget_outcomes(s: SparkSession, d: str) -> DataFrame:
    return state.forget_outcome(_asked(s, d), model.records(s, d), model.tombstones(s, d).select(F.col("record_id").alias("id")))


@query(f"WITH RECURSIVE {_ASKED}, {VECTORS}, {_DOWN} SELECT 'records' AS \"table\", count(*) AS rows FROM down UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM down) UNION ALL SELECT 'tags', count(*) FROM tags WHERE doc_id IN (SELECT doc_id FROM down) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM down)")
def forget_preview(s: SparkSession, d: str) -> DataFrame:
    """What a cascading forget would take with it."""
    records = model.records(s, d)
    gone = state.with_descendants(_asked(s, d), records)
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return state.forget_preview(gone, records=records, chunks=chunking.chunks(records), tags=model.tags(s, d), embeddings=vectors)


@query(f"WITH RECURSIVE {_ASKED}, {_DOWN} SELECT id, 'why' AS reason FROM records WHERE doc_id IN (SELECT doc_id FROM down) AND id NOT IN (SELECT record_id FROM tombstones) UNION ALL SELECT record_id, reason FROM tombstones")
def forget_cascade(s: SparkSession, d: str) -> DataFrame:
    """The tombstones after a cascading forget."""
    records = model.records(s, d)
    gone = state.with_descendants(_asked(s, d), records).join(records.select("doc_id", "id"), "doc_id")
    stones = model.tombstones(s, d).select(F.col("record_id").alias("id"), "reason", "forgotten_at")
    return state.forget(records, stones, gone, NOW, "why")[1].select("id", "reason")


@query("WITH RECURSIVE down AS (SELECT doc_id FROM tombstones WHERE doc_id % 10 = 0 UNION SELECT t.doc_id FROM tombstones t JOIN down ON t.derived_from = down.doc_id) SELECT record_id AS id FROM tombstones WHERE doc_id NOT IN (SELECT doc_id FROM down)")
def unforget_cascade(s: SparkSession, d: str) -> DataFrame:
    """The tombstones that are left after those of every tenth document, and of what derives from them among the tombstones, were taken away."""
    stones = model.tombstones(s, d)
    back = state.with_descendants(stones.filter("doc_id % 10 = 0"), stones)
    return state.unforget(stones, back, "doc_id").select(F.col("record_id").alias("id"))


@query("WITH RECURSIVE losers AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY raw_hash ORDER BY coalesce(own, 0) DESC, coalesce(updated_at, created_at) DESC, native_path IS NOT NULL DESC, adapter, id) AS n FROM records LEFT JOIN (SELECT doc_id, count(*) AS own FROM tags GROUP BY 1) t USING (doc_id)) WHERE n > 1), down AS (SELECT r.doc_id FROM records r JOIN losers l ON r.derived_from = l.doc_id UNION SELECT r.doc_id FROM records r JOIN down ON r.derived_from = down.doc_id) SELECT DISTINCT doc_id FROM down WHERE doc_id NOT IN (SELECT doc_id FROM losers)")
def losers_descendants(s: SparkSession, d: str) -> DataFrame:
    """What derives from the records that a merge would forget, each once."""
    records = model.records(s, d)
    members = records.join(duplicates.exact_groups(records).select("raw_hash"), "raw_hash", "left_semi")
    losers = duplicates.merge_preview(members, model.tags(s, d)).filter("decision = 'forget'").select("id").join(records.select("doc_id", "id"), "id").select("doc_id")
    return state.with_descendants(losers, records).join(losers, "doc_id", "left_anti")


_IMPORT = """cur AS (SELECT doc_id, raw_hash FROM records WHERE kind <> 'skill'), inc AS (SELECT doc_id, id, CASE WHEN kind = 'fact' THEN concat(content, '!') ELSE content END AS content FROM records WHERE scope <> 'project'),
 outcomes AS (SELECT inc.doc_id, CASE WHEN inc.id IN (SELECT record_id FROM tombstones) THEN 'refused' WHEN cur.doc_id IS NULL THEN 'inserted' WHEN cur.raw_hash = sha256(inc.content) THEN 'unchanged' ELSE 'updated' END AS outcome FROM inc LEFT JOIN cur USING (doc_id))"""


def _import(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes by doc_id, chunks of the incoming versions, chunks of the store) of a second import with edited facts."""
    records = model.records(s, d)
    content = F.when(F.col("kind") == "fact", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    incoming = records.filter("scope <> 'project'").withColumn("content", content).withColumn("raw_hash", F.sha2("content", 256))
    current = records.filter("kind <> 'skill'")
    outcomes = state.upsert_outcome(current, incoming, model.tombstones(s, d).select("doc_id"), "doc_id")
    return outcomes, chunking.chunks(incoming), chunking.chunks(current)


@query(f"WITH {_IMPORT} SELECT (SELECT count(*) FROM outcomes) + (SELECT count(*) FROM import_errors) AS raw_seen, count(*) FILTER (outcome IN ('inserted', 'updated')) AS upserted, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'refused') AS refused, (SELECT count(*) FROM import_errors) AS errors FROM outcomes")
def import_summary(s: SparkSession, d: str) -> DataFrame:
    outcomes, new, _ = _import(s, d)
    return state.import_summary(outcomes, new, model.import_errors(s, d)).drop("chunks")


@query(f"WITH {_IMPORT} SELECT doc_id, chunk_id, content_hash FROM chunks WHERE doc_id IN (SELECT doc_id FROM cur) AND doc_id NOT IN (SELECT doc_id FROM outcomes WHERE outcome = 'updated') UNION ALL SELECT doc_id, chunk_id, content_hash FROM chunks WHERE doc_id IN (SELECT doc_id FROM outcomes WHERE outcome = 'inserted')")
def replaced_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunk table after the import, but for the edited records, whose new chunks have no SQL."""
    outcomes, new, old = _import(s, d)
    updated = outcomes.filter("outcome = 'updated'").select("doc_id")
    return state.replace_chunks(old, outcomes, new).join(updated, "doc_id", "left_anti").select("doc_id", "chunk_id", "content_hash")


@query("SELECT adapter, instance, CAST(100 AS BIGINT) AS added_at, CASE WHEN adapter = 'mem0' THEN CAST(300 AS BIGINT) END AS last_import_at FROM (SELECT DISTINCT adapter, instance FROM records) WHERE adapter NOT IN ('letta', 'codex') UNION ALL SELECT DISTINCT adapter, instance, 200, NULL FROM records WHERE adapter = 'codex'")
def source_registry(s: SparkSession, d: str) -> DataFrame:
    """All sources but one adapter's are registered, then all, then one adapter's are stamped and another's leave."""
    every = model.records(s, d).select("adapter", "instance").distinct()
    empty = s.createDataFrame([], "adapter string, instance string, added_at long, last_import_at long")
    known = state.register(state.register(empty, every.filter("adapter <> 'codex'"), 100), every, 200)
    return state.deregister(state.stamp(known, every.filter("adapter = 'mem0'"), 300), every.filter("adapter = 'letta'"))


@query(f"WITH {VECTORS} SELECT chunk_id, round(CAST(('0x' || substr(md5(content), 1, 4)) AS BIGINT) / 65535.0, 6) AS x0, round(CAST(('0x' || substr(md5(content), 13, 4)) AS BIGINT) / 65535.0, 6) AS x3 FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.chunk_id = c.chunk_id AND v.content_hash = c.content_hash AND model_id = 'small')")
def embedding_drain(s: SparkSession, d: str) -> DataFrame:
    done, _ = state.drain(state.missing_embeddings(*embedded(s, d), "small"), "small")
    return done.select("chunk_id", F.round(F.get("embedding", 0), 6).alias("x0"), F.round(F.get("embedding", 3), 6).alias("x3"))


@query(f"WITH {VECTORS}, live AS (SELECT doc_id FROM records WHERE id NOT IN (SELECT record_id FROM tombstones)), kept AS (SELECT chunk_id, content_hash FROM chunks WHERE doc_id IN (SELECT doc_id FROM live)) SELECT (SELECT count(*) FROM kept) AS chunks, (SELECT count(*) FROM vectors v WHERE EXISTS (SELECT 1 FROM kept k WHERE k.chunk_id = v.chunk_id AND k.content_hash = v.content_hash)) AS embeddings")
def verify_repair(s: SparkSession, d: str) -> DataFrame:
    chunks, vectors = state.repair(*embedded(s, d), catalog._live(s, d))
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("embeddings")))


@query(
    f"""WITH scored AS (SELECT id, n, round(0.45 * least(greatest((n - 40) / 560.0, 0.0), 1.0) + 0.20 * CASE WHEN age <= 0 THEN 1.0 ELSE pow(2.0, -age / 30.0) END + 0.35 * least(greatest((letters * 1.0 / greatest(n, 1) - 0.40) / 0.25, 0.0), 1.0), 6) AS score
 FROM (SELECT id, length(content) AS n, ({NOW} - created_at) / 86400.0 AS age, length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) AS letters FROM records WHERE kind = 'episode')), candidates AS (SELECT * FROM scored WHERE score >= 0.4 ORDER BY score DESC, id LIMIT 25)
 SELECT id, CAST(call AS INTEGER) AS call FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS call FROM candidates WHERE n <= 2000) WHERE call <= 5"""
)
def extraction_calls(s: SparkSession, d: str) -> DataFrame:
    return extraction.planned(extraction.candidates(model.records(s, d), NOW), 5, 2000).select("id", "call")


@query("SELECT doc_id, id, created_at FROM records WHERE derived_from = 3 ORDER BY created_at, doc_id LIMIT 1")
def first_child(s: SparkSession, d: str) -> DataFrame:
    return graph.children(model.records(s, d), 3, 1).select("doc_id", "id", "created_at")
