"""The relational catalogue over the record store, each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollate.functions.text import STOP_PAIRS, STOP_WORDS, estimate_tokens, freshness, normalize_tag, project_root, truncate
from recollate.operators import chunking, duplicates, extraction, graph, retrieval, rollups, selection, similar, state
from recollate.plans import model
from recollate.plans.model import oracle
from recollate.session import cut
from recollate.tables import spread, table

NOW = 1704067200 + 400 * 3600
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_DENSE = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_TOKENS = f"(length({{0}}) - length(regexp_replace({{0}}, '[{_DENSE}]', '', 'g')))"
_OTHERS = f"length(regexp_replace({{0}}, '[{_DENSE}]', '', 'g'))"


def estimate_sql(column: str) -> str:
    return f"CAST({_TOKENS.format(column)} + ceil({_OTHERS.format(column)} / 4.0) AS BIGINT)"


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = oracle(sql)
        return f

    return add


# --- projections and filters


@query("SELECT id, adapter, instance, kind, scope, created_at, updated_at, native_id, native_path, raw_hash, content FROM records")
def record_projection(s: SparkSession, d: str) -> DataFrame:
    return model.records(s, d).select(*selection.HEADER, "content")


@query(
    "SELECT r.doc_id, id, adapter, instance, kind, scope, created_at, updated_at, native_id, native_path, raw_hash, coalesce(t.user_tags, '') AS user_tags FROM records r "
    "LEFT JOIN (SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS user_tags FROM (SELECT DISTINCT doc_id, tag FROM tags) GROUP BY doc_id) t ON t.doc_id = r.doc_id"
)
def record_headers(s: SparkSession, d: str) -> DataFrame:
    return selection.headers(model.records(s, d), model.tags(s, d))


@query(
    f"SELECT doc_id, id, created_at FROM records r WHERE adapter = 'claude-code' AND kind = 'fact' AND scope = 'user' AND created_at >= 1704067200 AND created_at <= {1704067200 + 3600 * 1000000} "
    "AND EXISTS (SELECT 1 FROM tags t WHERE t.doc_id = r.doc_id AND t.tag = 'long')"
)
def filtered_records(s: SparkSession, d: str) -> DataFrame:
    found = selection.retrieval_filter(model.records(s, d), "claude-code", None, "fact", "user", 1704067200, 1704067200 + 3600 * 1000000, model.tags(s, d), "long")
    return found.select("doc_id", "id", "created_at")


@query("SELECT id, adapter FROM records WHERE adapter IN ('mem0', 'letta') AND instance IN ('main-1', 'main-2', '')")
def csv_or_filter(s: SparkSession, d: str) -> DataFrame:
    return selection.csv_filter(model.records(s, d), "mem0, letta,", "main-1,main-2").select("id", "adapter").unionByName(
        selection.csv_filter(model.records(s, d), "mem0, letta,").filter("instance = ''").select("id", "adapter")
    )


@query("SELECT id, raw_hash, adapter FROM records WHERE raw_hash IN (SELECT raw_hash FROM records WHERE adapter = 'claude-code')")
def group_preserving_filter(s: SparkSession, d: str) -> DataFrame:
    return selection.group_preserving(model.records(s, d), ["raw_hash"], F.col("adapter") == "claude-code").select("id", "raw_hash", "adapter")


@query(f"SELECT id, created_at FROM records WHERE created_at >= {1704067200 + 86400} AND created_at < {1704067200 + 2 * 86400}")
def timeline_day(s: SparkSession, d: str) -> DataFrame:
    return selection.day(model.records(s, d), 1704067200 + 86400).select("id", "created_at")


@query("SELECT id FROM records WHERE updated_at IS NULL OR updated_at > 1705000000")
def incremental_scan(s: SparkSession, d: str) -> DataFrame:
    return selection.since(model.records(s, d), 1705000000, "updated_at").select("id")


@query("SELECT id FROM records WHERE id > '8' ORDER BY id LIMIT 100")
def keyset_page(s: SparkSession, d: str) -> DataFrame:
    return selection.page(model.records(s, d).select("id"), "8", 100)


@query("SELECT record_id, adapter, instance, forgotten_at, reason IS NOT NULL AS has_reason, derived_from IS NOT NULL AS has_derived_from FROM tombstones ORDER BY forgotten_at DESC, record_id DESC LIMIT 20")
def list_forgotten(s: SparkSession, d: str) -> DataFrame:
    stones = model.tombstones(s, d).select("record_id", "adapter", "instance", "forgotten_at", "reason", "derived_from")
    return selection.top(selection.redacted(stones, ["reason", "derived_from"]), 20, F.col("forgotten_at").desc(), F.col("record_id").desc())


@query("SELECT id, adapter, created_at FROM (SELECT *, row_number() OVER (PARTITION BY adapter, instance ORDER BY created_at DESC, id) AS n FROM records) WHERE n <= 5")
def newest_per_source(s: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("adapter", "instance").orderBy(F.col("created_at").desc(), "id"))
    return model.records(s, d).select("id", "adapter", "created_at", place.alias("n")).filter("n <= 5").drop("n")


# --- scalar functions


@query(
    f"SELECT doc_id, {estimate_sql('content')} AS tokens, CASE WHEN length(content) > 100 THEN concat(left(content, 100), '…') ELSE content END AS short, "
    "coalesce(CASE WHEN regexp_extract(native_path, '/\\.(?:claude/projects|codex)/([^/]+)', 1) <> '' THEN regexp_extract(native_path, '/\\.(?:claude/projects|codex)/([^/]+)', 1) "
    "WHEN regexp_extract(native_path, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(native_path, '^(.*)/[^/]*$', 1) ELSE native_path END, '') AS project, "
    f"CASE WHEN updated_at IS NULL THEN 'never' WHEN {NOW} - updated_at < 86400 THEN 'fresh' ELSE 'stale' END AS freshness FROM records"
)
def scalar_functions(s: SparkSession, d: str) -> DataFrame:
    return model.records(s, d).select(
        "doc_id",
        estimate_tokens(F.col("content")).alias("tokens"),
        truncate(F.col("content"), 100).alias("short"),
        project_root(F.col("native_path")).alias("project"),
        freshness(F.col("updated_at"), NOW).alias("freshness"),
    )


@query(
    "SELECT DISTINCT CASE WHEN length(t) > 0 AND strlen(t) <= 64 THEN t END AS tag FROM (SELECT lower(trim(doc_kind)) AS t FROM documents UNION ALL SELECT lower(trim(source)) FROM documents)"
)
def normalized_tags(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(normalize_tag(F.col("doc_kind")).alias("tag")).unionByName(docs.select(normalize_tag(F.col("source")).alias("tag"))).distinct()


@query(
    f"""SELECT doc_id, round(0.45 * least(greatest((n - 40) / 560.0, 0.0), 1.0) + 0.20 * CASE WHEN age <= 0 THEN 1.0 ELSE pow(2.0, -age / 30.0) END
 + 0.35 * least(greatest((letters * 1.0 / greatest(n, 1) - 0.40) / 0.25, 0.0), 1.0), 5) AS score
 FROM (SELECT doc_id, length(content) AS n, ({NOW} - created_at) / 86400.0 AS age, length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) AS letters FROM records)"""
)
def gate_scores(s: SparkSession, d: str) -> DataFrame:
    return model.records(s, d).select("doc_id", F.round(extraction.gate_score(F.col("content"), F.col("created_at"), NOW), 5).alias("score"))


# --- counts


@query(
    "SELECT r.adapter, r.instance, r.records, coalesce(c.chunks, 0) AS chunks, coalesce(t.tagged, 0) AS tagged FROM (SELECT adapter, instance, count(*) AS records FROM records GROUP BY 1, 2) r "
    "LEFT JOIN (SELECT adapter, instance, count(*) AS chunks FROM records JOIN chunks USING (doc_id) GROUP BY 1, 2) c USING (adapter, instance) "
    "LEFT JOIN (SELECT adapter, instance, count(DISTINCT r2.doc_id) AS tagged FROM records r2 JOIN tags USING (doc_id) GROUP BY 1, 2) t USING (adapter, instance)"
)
def source_inventory(s: SparkSession, d: str) -> DataFrame:
    records = model.records(s, d)
    return rollups.source_inventory(records, model.tags(s, d), chunking.chunks(records))


@query(
    f"SELECT CASE WHEN m IS NULL THEN 'never' WHEN {NOW} - m < 86400 THEN 'fresh' ELSE 'stale' END AS status, count(*) AS sources FROM (SELECT max(created_at) AS m FROM records GROUP BY adapter, instance) GROUP BY 1"
)
def status_rollup(s: SparkSession, d: str) -> DataFrame:
    return rollups.status(model.records(s, d), NOW)


@query(
    f"""WITH seen AS (SELECT adapter, instance, max(created_at) AS m FROM records GROUP BY 1, 2), reg AS (SELECT DISTINCT adapter, instance FROM records WHERE adapter <> 'mem0' UNION SELECT 'mem0', 'new'), bad AS (SELECT DISTINCT adapter, instance FROM import_errors),
 j AS (SELECT r.adapter IS NOT NULL AS known, m, b.adapter IS NOT NULL AS failed FROM reg r FULL OUTER JOIN seen s ON r.adapter = s.adapter AND r.instance = s.instance LEFT JOIN bad b ON b.adapter = coalesce(r.adapter, s.adapter) AND b.instance = coalesce(r.instance, s.instance))
 SELECT count(*) FILTER (known) AS registered, count(*) FILTER (known AND {NOW} - m <= 172800 AND NOT failed) AS ok, count(*) FILTER (known AND (m IS NULL OR {NOW} - m > 172800)) AS stale, count(*) FILTER (known AND failed) AS unhealthy, count(*) FILTER (NOT known) AS unregistered FROM j"""
)
def doctor_rollup(s: SparkSession, d: str) -> DataFrame:
    """The registry knows all sources but those of one adapter, and one that was never read."""
    known = model.records(s, d).select("adapter", "instance").distinct().filter("adapter <> 'mem0'").unionByName(s.createDataFrame([("mem0", "new")], "adapter string, instance string"))
    return rollups.doctor(model.records(s, d), known, model.import_errors(s, d), NOW, 172800)


@query(
    "SELECT tool, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, CAST(quantile_disc(duration_ms, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(duration_ms, 0.95) AS BIGINT) AS p95, "
    "CAST(quantile_disc(duration_ms, 0.99) AS BIGINT) AS p99, arg_max(duration_ms, event_id) AS last_ms FROM metrics GROUP BY tool"
)
def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return rollups.latency(model.metrics(s, d))


@query("SELECT adapter, instance, count(*) AS n FROM tombstones GROUP BY 1, 2")
def forgotten_by_source(s: SparkSession, d: str) -> DataFrame:
    return rollups.counts_by(model.tombstones(s, d), "adapter", "instance")


@query("SELECT adapter, count(*) AS n FROM import_errors GROUP BY 1")
def errors_by_adapter(s: SparkSession, d: str) -> DataFrame:
    return rollups.counts_by(model.import_errors(s, d), "adapter")


@query("SELECT error_id, adapter, phase, occurred_at FROM import_errors ORDER BY occurred_at DESC, error_id DESC LIMIT 10")
def recent_errors(s: SparkSession, d: str) -> DataFrame:
    return selection.top(model.import_errors(s, d).select("error_id", "adapter", "phase", "occurred_at"), 10, F.col("occurred_at").desc(), F.col("error_id").desc())


@query("SELECT event_id, tool FROM metrics WHERE event_id > (SELECT max(event_id) FROM metrics) - 5000")
def capped_metrics(s: SparkSession, d: str) -> DataFrame:
    return rollups.keep_last(model.metrics(s, d)).select("event_id", "tool")


@query("SELECT event_id, tool, started_at FROM (SELECT * FROM metrics WHERE tool IN ('purchase', 'signup') AND started_at >= 100 ORDER BY event_id DESC LIMIT 20)")
def audit_tail(s: SparkSession, d: str) -> DataFrame:
    return rollups.tail(model.metrics(s, d), 20, ["purchase", "signup"], 100).select("event_id", "tool", "started_at")


@query("SELECT tool, CAST(date_trunc('day', e.ts) AS DATE) AS day, count(*) AS n FROM metrics m JOIN events e USING (event_id) GROUP BY 1, 2")
def calls_per_day(s: SparkSession, d: str) -> DataFrame:
    events = table(s, d, "events").select("event_id", F.to_date("ts").alias("day"))
    return rollups.counts_by(model.metrics(s, d).join(events, "event_id"), "tool", "day")


@query("SELECT CAST(len(embedding) AS BIGINT) AS dim, count(*) AS vectors FROM embeddings GROUP BY 1")
def vector_dimensions(s: SparkSession, d: str) -> DataFrame:
    return rollups.counts_by(table(s, d, "embeddings").select(F.size("embedding").cast("long").alias("dim")), "dim", name="vectors")


# --- duplicates, conflicts, reconciliation


@query("SELECT raw_hash, count(*) AS n, max(created_at) AS newest FROM records GROUP BY raw_hash HAVING count(*) > 1")
def exact_duplicates(s: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(model.records(s, d))


@query("SELECT raw_hash, count(*) AS n, max(created_at) AS newest FROM records GROUP BY raw_hash HAVING count(*) > 1 ORDER BY n DESC, newest DESC, raw_hash LIMIT 20")
def largest_duplicates(s: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(model.records(s, d), 20)


@query("SELECT raw_hash, id, adapter, instance, created_at FROM records WHERE raw_hash IN (SELECT raw_hash FROM records GROUP BY 1 HAVING count(*) > 1)")
def duplicate_members(s: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_members(model.records(s, d))


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS records FROM (SELECT count(*) AS n FROM records GROUP BY raw_hash HAVING count(*) > 1)")
def duplicate_counts(s: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_counts(model.records(s, d))


@query("SELECT adapter, instance, count(*) AS records FROM records WHERE raw_hash IN (SELECT raw_hash FROM records GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2")
def duplicates_by_source(s: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_counts_by_source(model.records(s, d))


@query(
    """SELECT raw_hash, id, adapter, tag_count, effective_at, has_path, CASE WHEN n = 1 THEN 'keep' ELSE 'forget' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY tag_count DESC, effective_at DESC, has_path DESC, adapter, id) AS n
 FROM (SELECT raw_hash, id, adapter, coalesce(c, 0) AS tag_count, coalesce(updated_at, created_at) AS effective_at, native_path IS NOT NULL AS has_path FROM records r LEFT JOIN (SELECT doc_id, count(*) AS c FROM tags GROUP BY 1) t USING (doc_id)
 WHERE raw_hash IN (SELECT raw_hash FROM records GROUP BY 1 HAVING count(*) > 1)))"""
)
def merge_preview(s: SparkSession, d: str) -> DataFrame:
    records = model.records(s, d)
    members = records.join(duplicates.exact_groups(records).select("raw_hash"), "raw_hash", "left_semi")
    return duplicates.merge_preview(members, model.tags(s, d))


@query(
    "SELECT native_id, count(*) AS records, count(DISTINCT adapter) AS adapters, count(DISTINCT raw_hash) AS variants FROM records GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT adapter) > 1 AND count(DISTINCT raw_hash) > 1"
)
def conflicts(s: SparkSession, d: str) -> DataFrame:
    return duplicates.conflict_groups(model.records(s, d))


@query(
    """WITH grouped AS (SELECT native_id FROM records GROUP BY 1 HAVING count(DISTINCT adapter) > 1 AND count(DISTINCT raw_hash) > 1), firsts AS (SELECT native_id, raw_hash, min(concat(adapter, chr(1), id)) AS f FROM records WHERE native_id IN (SELECT native_id FROM grouped) GROUP BY 1, 2),
 numbered AS (SELECT native_id, raw_hash, row_number() OVER (PARTITION BY native_id ORDER BY f) AS variant FROM firsts)
 SELECT r.native_id, CAST(n.variant AS INTEGER) AS variant, id, adapter, instance, CASE WHEN length(content) > 240 THEN concat(left(content, 240), '…') ELSE content END AS preview FROM records r JOIN numbered n ON n.native_id = r.native_id AND n.raw_hash = r.raw_hash"""
)
def conflict_variants(s: SparkSession, d: str) -> DataFrame:
    return duplicates.conflict_variants(model.records(s, d))


RECONCILE = """WITH b AS (SELECT 'n:' || native_id AS identity, min(concat(id, chr(1), raw_hash)) AS f FROM records WHERE adapter = 'letta' GROUP BY 1), a AS (SELECT *, 'n:' || native_id AS identity FROM records WHERE adapter = 'mem0'),
 buckets AS (SELECT CASE WHEN b.f IS NULL THEN 'only_left' WHEN split_part(b.f, chr(1), 2) = a.raw_hash THEN 'same' ELSE 'conflict' END AS bucket, a.identity, a.id AS left_id, split_part(b.f, chr(1), 1) AS right_id FROM a LEFT JOIN b ON a.identity = b.identity
 UNION ALL SELECT 'only_right', 'n:' || native_id, NULL, id FROM records WHERE adapter = 'letta' AND native_id NOT IN (SELECT native_id FROM a))"""


@query(RECONCILE + " SELECT bucket, identity, left_id, right_id FROM buckets")
def reconcile_buckets(s: SparkSession, d: str) -> DataFrame:
    return duplicates.reconcile(model.records(s, d), ("mem0", None), ("letta", None))


@query(RECONCILE + " SELECT bucket, count(*) AS n FROM buckets GROUP BY 1")
def reconcile_counts(s: SparkSession, d: str) -> DataFrame:
    return rollups.counts_by(duplicates.reconcile(model.records(s, d), ("mem0", None), ("letta", None)), "bucket")


_SIMHASH = """WITH terms AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))) AS t FROM (SELECT id AS doc_id, content FROM memori_entity_fact)), classes AS (SELECT sha256(array_to_string(t, ' ')) AS class, any_value(t) AS t FROM terms WHERE len(t) >= 4 GROUP BY 1),
 hashes AS (SELECT class, len(t) AS n, CAST(('0x' || substr(md5(u.w), 1, 16)) AS UBIGINT) AS h FROM classes, unnest(t) AS u(w)), bits AS (SELECT class, i, sum(CAST((h >> i) & 1 AS BIGINT)) AS v, any_value(n) AS n FROM hashes, range(0, 64) AS r(i) GROUP BY 1, 2),
 sims AS (SELECT class, bit_or(CASE WHEN v * 2 > n THEN CAST(1 AS UBIGINT) << i ELSE CAST(0 AS UBIGINT) END) AS sim FROM bits GROUP BY 1)
 SELECT class_a, class_b, distance, round(similarity, 6) AS similarity FROM (SELECT a.class AS class_a, b.class AS class_b, CAST(bit_count(xor(a.sim, b.sim)) AS BIGINT) AS distance, len(list_intersect(x.t, y.t)) * 1.0 / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS similarity
 FROM sims a JOIN sims b ON a.class < b.class AND bit_count(xor(a.sim, b.sim)) <= 8 JOIN classes x ON x.class = a.class JOIN classes y ON y.class = b.class) WHERE similarity >= 0.6"""


def _facts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "memori_entity_fact").select(F.col("id").alias("doc_id"), "content", F.col("instance").alias("adapter"))


@query(_SIMHASH)
def near_duplicate_pairs(s: SparkSession, d: str) -> DataFrame:
    return similar.near_pairs(_facts(s, d)).withColumn("similarity", F.round("similarity", 6))


_RECORD_PAIRS = _SIMHASH.replace("(SELECT id AS doc_id, content FROM memori_entity_fact)", "records")


@query(_RECORD_PAIRS)
def near_duplicate_record_pairs(s: SparkSession, d: str) -> DataFrame:
    return similar.near_pairs(model.records(s, d)).withColumn("similarity", F.round("similarity", 6))


_GROUPS = _RECORD_PAIRS.replace("WITH terms", "WITH RECURSIVE terms", 1).replace(" SELECT class_a, class_b, distance, round(similarity, 6) AS similarity FROM (", ", pairs AS (SELECT class_a, class_b, distance, similarity FROM (", 1) + """),
 edges AS (SELECT class_a AS a, class_b AS b FROM pairs UNION SELECT class_b, class_a FROM pairs), reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
 least AS (SELECT a AS class, least(a, min(b)) AS component FROM reach GROUP BY a), of AS (SELECT doc_id, class, coalesce(component, class) AS component FROM (SELECT doc_id, sha256(array_to_string(t, ' ')) AS class FROM terms WHERE len(t) >= 4) LEFT JOIN least USING (class)),
 members AS (SELECT component, doc_id, adapter, class FROM of JOIN records USING (doc_id)), big AS (SELECT component, count(*) AS members, count(DISTINCT adapter) AS adapters FROM members GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT adapter) > 1)"""
GROUPS = _GROUPS


@query(_GROUPS + " SELECT component, doc_id, adapter FROM members WHERE component IN (SELECT component FROM big)")
def near_duplicate_groups(s: SparkSession, d: str) -> DataFrame:
    return similar.near_groups(model.records(s, d))


@query(
    _GROUPS
    + ", links AS (SELECT component, min(similarity) AS s, max(distance) AS d FROM pairs JOIN (SELECT DISTINCT class, component FROM members) m ON m.class = class_a GROUP BY 1) SELECT component, members, adapters, round(coalesce(s, 1.0), 6) AS min_similarity, coalesce(d, 0) AS max_distance FROM big LEFT JOIN links USING (component) ORDER BY members DESC, min_similarity, component LIMIT 20"
)
def near_duplicate_report(s: SparkSession, d: str) -> DataFrame:
    return similar.group_report(model.records(s, d))


@query(
    _GROUPS
    + """ SELECT component, id, adapter, tag_count, effective_at, has_path, CASE WHEN n = 1 THEN 'keep' ELSE 'forget' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY tag_count DESC, effective_at DESC, has_path DESC, adapter, id) AS n
 FROM (SELECT component, id, r.adapter, coalesce(c, 0) AS tag_count, coalesce(updated_at, created_at) AS effective_at, native_path IS NOT NULL AS has_path FROM members JOIN big USING (component) JOIN records r USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM tags GROUP BY 1) t USING (doc_id)))"""
)
def near_merge_preview(s: SparkSession, d: str) -> DataFrame:
    records = model.records(s, d)
    members = similar.near_groups(records).select("component", "doc_id").join(records, "doc_id")
    return duplicates.merge_preview(members, model.tags(s, d), "component")


@query(_SIMHASH.replace("(SELECT id AS doc_id, content FROM memori_entity_fact)", "(SELECT * FROM records WHERE adapter IN ('mem0', 'letta'))"))
def near_duplicates_of_sources(s: SparkSession, d: str) -> DataFrame:
    """The filter narrows what is scanned, so copies outside it play no part."""
    return similar.near_pairs(selection.csv_filter(model.records(s, d), "mem0,letta")).withColumn("similarity", F.round("similarity", 6))


# --- lineage


@query(
    "WITH RECURSIVE up AS (SELECT doc_id AS key, doc_id AS top, derived_from AS parent, CAST(0 AS BIGINT) AS depth FROM records UNION ALL SELECT up.key, r.doc_id, r.derived_from, up.depth + 1 FROM up JOIN records r ON r.doc_id = up.parent) "
    "SELECT key, top AS root, depth, parent IS NOT NULL AS broken, FALSE AS cycle FROM up u WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.doc_id = u.parent)"
)
def lineage_roots(s: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(model.records(s, d))


@query(
    "WITH RECURSIVE down AS (SELECT doc_id AS key, 1 AS depth FROM records WHERE derived_from = 3 UNION ALL SELECT r.doc_id, down.depth + 1 FROM records r JOIN down ON r.derived_from = down.key) SELECT key, CAST(depth AS INTEGER) AS depth FROM down"
)
def descendants(s: SparkSession, d: str) -> DataFrame:
    return graph.descendants(model.records(s, d), 3)


@query("SELECT doc_id, id, created_at FROM records WHERE derived_from = 3")
def children(s: SparkSession, d: str) -> DataFrame:
    return graph.children(model.records(s, d), 3).select("doc_id", "id", "created_at")


# --- state


@query("SELECT id, adapter FROM records WHERE id NOT IN (SELECT record_id FROM tombstones)")
def live_records(s: SparkSession, d: str) -> DataFrame:
    return state.live(model.records(s, d), model.tombstones(s, d).select(F.col("record_id").alias("id"))).select("id", "adapter")


_UPSERT = """WITH cur AS (SELECT id, raw_hash FROM records WHERE kind <> 'skill'), inc AS (SELECT id, CASE WHEN kind = 'fact' THEN sha256(concat(content, '!')) ELSE raw_hash END AS raw_hash FROM records WHERE scope <> 'project'), ts AS (SELECT record_id AS id FROM tombstones)"""


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records = model.records(s, d).select("id", "adapter", "content", "raw_hash", "created_at", "updated_at", "kind", "scope")
    edited = F.when(F.col("kind") == "fact", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    incoming = records.filter("scope <> 'project'").withColumn("content", edited).withColumn("raw_hash", F.sha2("content", 256)).withColumn("created_at", F.col("created_at") + 5)
    return records.filter("kind <> 'skill'"), incoming, model.tombstones(s, d).select(F.col("record_id").alias("id"))


@query(
    _UPSERT + " SELECT inc.id, CASE WHEN ts.id IS NOT NULL THEN 'refused' WHEN cur.id IS NULL THEN 'inserted' WHEN cur.raw_hash = inc.raw_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM inc LEFT JOIN cur ON cur.id = inc.id LEFT JOIN ts ON ts.id = inc.id"
)
def upsert_outcomes(s: SparkSession, d: str) -> DataFrame:
    return state.upsert_outcome(*_versions(s, d))


@query(
    """WITH cur AS (SELECT id, content, raw_hash, created_at FROM records WHERE kind <> 'skill'), inc AS (SELECT id, CASE WHEN kind = 'fact' THEN concat(content, '!') ELSE content END AS content, created_at + 5 AS created_at FROM records WHERE scope <> 'project' AND id NOT IN (SELECT record_id FROM tombstones))
 SELECT coalesce(cur.id, inc.id) AS id, sha256(CASE WHEN inc.id IS NULL THEN cur.content ELSE inc.content END) AS raw_hash, coalesce(cur.created_at, inc.created_at) AS created_at FROM cur FULL OUTER JOIN inc ON cur.id = inc.id"""
)
def upsert_snapshot(s: SparkSession, d: str) -> DataFrame:
    return state.upsert(*_versions(s, d)).select("id", "raw_hash", "created_at")


@query("SELECT doc_id, tag FROM tags UNION SELECT doc_id, 'reviewed' FROM records WHERE kind = 'skill'")
def tag_add(s: SparkSession, d: str) -> DataFrame:
    return state.tag(model.tags(s, d), model.records(s, d).filter("kind = 'skill'"), ["reviewed"], "add")


@query("SELECT DISTINCT doc_id, tag FROM tags WHERE NOT (tag = 'long' AND doc_id IN (SELECT doc_id FROM records WHERE kind = 'skill'))")
def tag_remove(s: SparkSession, d: str) -> DataFrame:
    return state.tag(model.tags(s, d), model.records(s, d).filter("kind = 'skill'"), ["long"], "remove")


@query("SELECT DISTINCT doc_id, tag FROM tags WHERE doc_id NOT IN (SELECT doc_id FROM records WHERE kind = 'skill') UNION SELECT doc_id, 'kept' FROM records WHERE kind = 'skill'")
def tag_replace(s: SparkSession, d: str) -> DataFrame:
    return state.tag(model.tags(s, d), model.records(s, d).filter("kind = 'skill'"), ["kept"], "replace")


def embedded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors): the vectors are those of first chunks; of every tenth the content has changed since."""
    chunks = chunking.chunks(model.records(s, d))
    vectors = table(s, d, "embeddings").select("vec_id", F.concat(F.col("vec_id"), F.lit(":0")).alias("chunk_id"), F.when(F.col("label") < 5, "small").otherwise("large").alias("model_id"))
    known = vectors.join(chunks.select("chunk_id", "content_hash"), "chunk_id", "left")
    return chunks, known.select("chunk_id", "model_id", F.when(F.col("vec_id") % 10 == 3, "stale").otherwise(F.col("content_hash")).alias("content_hash"))


VECTORS = "vectors AS (SELECT vec_id || ':0' AS chunk_id, CASE WHEN label < 5 THEN 'small' ELSE 'large' END AS model_id, CASE WHEN vec_id % 10 = 3 THEN 'stale' ELSE content_hash END AS content_hash FROM embeddings LEFT JOIN chunks ON chunk_id = vec_id || ':0')"


@query(f"WITH {VECTORS} SELECT doc_id, chunk_id, content_hash FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.chunk_id = c.chunk_id AND v.content_hash = c.content_hash AND model_id = 'small')")
def missing_embeddings(s: SparkSession, d: str) -> DataFrame:
    chunks, vectors = embedded(s, d)
    return state.missing_embeddings(chunks, vectors, "small").select("doc_id", "chunk_id", "content_hash")


@query(
    f"""WITH {VECTORS}, live AS (SELECT doc_id FROM records WHERE id NOT IN (SELECT record_id FROM tombstones)), kept AS (SELECT * FROM chunks WHERE doc_id % 17 <> 0)
 SELECT 'records_without_chunks' AS "check", (SELECT count(*) FROM live WHERE doc_id NOT IN (SELECT doc_id FROM kept)) AS n UNION ALL SELECT 'chunks_without_record', (SELECT count(*) FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM live))
 UNION ALL SELECT 'chunks_without_embedding', (SELECT count(*) FROM kept WHERE chunk_id NOT IN (SELECT chunk_id FROM vectors)) UNION ALL SELECT 'embeddings_without_chunk', (SELECT count(*) FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM kept))"""
)
def verify_store(s: SparkSession, d: str) -> DataFrame:
    """A store that lost the chunks of every seventeenth record and the records that were forgotten."""
    chunks, vectors = embedded(s, d)
    return state.verify(_live(s, d), chunks.filter("doc_id % 17 <> 0"), vectors)


def _live(s: SparkSession, d: str) -> DataFrame:
    return state.live(model.records(s, d), model.tombstones(s, d).select(F.col("record_id").alias("id")))


# --- retrieval: the queries are the documents and vectors whose id is divisible by 50, against all rows; the judged ones are the subjects

_TERMS = f"""list_distinct(flatten(list_transform(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), lambda w: CASE WHEN regexp_full_match(w, '[{_DENSE}]+')
 THEN list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr(w, i, 2)) ELSE [w] END)))"""
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS | STOP_PAIRS))
_EVERY_50 = "SELECT doc_id AS query_id, content FROM records WHERE doc_id % 50 = 0"
_SUBJECTS = "SELECT row_number() OVER (ORDER BY subject) - 1 AS query_id, description AS content FROM (SELECT DISTINCT subject, description FROM subject_area)"


def _bm25(queries: str = _EVERY_50, index: str = "records", key: str = "doc_id", allowed: str = "TRUE") -> str:
    return f"""WITH docs AS (SELECT {key}, {_TERMS} AS terms FROM {index}), n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM docs), post AS (SELECT {key}, len(terms) AS length, unnest(terms) AS term FROM docs),
 q AS (SELECT query_id, {_TERMS} AS terms FROM ({queries})), qt AS (SELECT query_id, len(terms) AS strict, unnest(terms) AS term, len(list_filter(terms, lambda t: t NOT IN ({_STOP}))) AS meant FROM q),
 df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY 1),
 w AS (SELECT query_id, {key}, term, strict, meant, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean)) AS weight FROM post JOIN qt USING (term) JOIN df USING (term), n),
 scored AS (SELECT query_id, {key}, CASE WHEN count(*) = max(strict) THEN 0 ELSE 1 END AS tier, CASE WHEN count(*) = max(strict) THEN sum(weight) ELSE coalesce(sum(weight) FILTER (meant = 0 OR term NOT IN ({_STOP})), 0) END AS score FROM w GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, round(score, 9) DESC, {key}) AS rank FROM scored WHERE (tier = 0 OR score > 0) AND {allowed})"""


_RANKED = " SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, tier, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"


def _texts(s: SparkSession, d: str) -> DataFrame:
    return model.records(s, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("content").alias("text"))


def _subjects(s: SparkSession, d: str) -> DataFrame:
    """The eight subjects in order of name, as query_id, subject, text."""
    number = F.row_number().over(Window.orderBy("subject")) - 1  # a fixed table of eight rows
    return table(s, d, "subject_area").select("subject", F.col("description").alias("text")).distinct().select(number.cast("long").alias("query_id"), "subject", "text")


@query(_bm25() + _RANKED)
def full_text_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.full_text(spread(model.records(s, d)), _texts(s, d), 10).withColumn("score", F.round("score", 6))


_FILTER = "adapter = 'claude-code' AND kind = 'fact' AND scope = 'user' AND created_at >= 1704067200 AND EXISTS (SELECT 1 FROM tags t WHERE t.doc_id = f.doc_id AND t.tag = 'en')"


@query(_bm25(allowed=f"doc_id IN (SELECT doc_id FROM records f WHERE {_FILTER})") + _RANKED)
def filtered_search(s: SparkSession, d: str) -> DataFrame:
    """The filter holds before the limit, so the best admitted records come out however many others score higher."""
    records = model.records(s, d)
    admitted = selection.retrieval_filter(records, "claude-code", None, "fact", "user", 1704067200, None, model.tags(s, d), "en")
    return retrieval.full_text(spread(records), _texts(s, d), 10, allowed=admitted).withColumn("score", F.round("score", 6))


_NEAREST = """SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS score
 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"""


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(s, d, "embeddings")
    return vectors, vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))


@query(
    f"WITH pairs AS ({_NEAREST}), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs) SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"
)
def vector_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest(*_vectors(s, d), 10).withColumn("score", F.round("score", 5))


def _hybrid(s: SparkSession, d: str, limit: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    pool = retrieval.pool_size(limit)
    text = cut(retrieval.full_text(spread(model.records(s, d)), _texts(s, d), pool))  # search_trace reads it twice
    near = retrieval.nearest(*_vectors(s, d), pool).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")
    return text, near, retrieval.fuse(text, near, limit)


_HYBRID = (
    _bm25()
    + f", pairs AS ({_NEAREST}), near AS (SELECT query_id, vec_id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs), "
    "fused AS (SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.doc_id, v.doc_id) AS doc_id, t.rank AS text_rank, v.rank AS vector_rank, coalesce(1.0 / (60 + t.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score "
    "FROM (SELECT * FROM ranked WHERE rank <= POOL) t FULL OUTER JOIN (SELECT * FROM near WHERE rank <= POOL) v ON t.query_id = v.query_id AND t.doc_id = v.doc_id), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM fused)"
).replace("POOL", str(retrieval.pool_size(10)))


@query(
    _HYBRID + " SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(text_rank AS INTEGER) AS text_rank, CAST(vector_rank AS INTEGER) AS vector_rank, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM placed WHERE rank <= 10"
)
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    return _hybrid(s, d)[2].select("query_id", "doc_id", "text_rank", "vector_rank", F.round("score", 9).alias("score"), "rank")


@query(
    _HYBRID + " SELECT 'fulltext' AS stage, (SELECT count(*) FROM ranked WHERE rank <= 80) AS rows UNION ALL SELECT 'vector', (SELECT count(*) FROM near WHERE rank <= 80) UNION ALL SELECT 'fused', (SELECT count(*) FROM placed WHERE rank <= 10)"
)
def search_trace(s: SparkSession, d: str) -> DataFrame:
    text, near, fused = _hybrid(s, d)
    return retrieval.trace(fulltext=text, vector=near, fused=fused)


_MATCHED = (
    _bm25(_SUBJECTS, "chunks", "chunk_id")
    + ", matched AS (SELECT query_id, doc_id, chunk_id, score, token_estimate AS tokens, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 320)"
)


def _matched(s: SparkSession, d: str) -> DataFrame:
    chunks = chunking.chunks(model.records(s, d))
    hits = retrieval.full_text(spread(chunks), _subjects(s, d).select("query_id", "text"), retrieval.pool_size(40), key="chunk_id")
    return retrieval.best_chunks(hits, chunks)


@query(
    _MATCHED
    + " SELECT CAST(query_id AS BIGINT) AS query_id, m.doc_id, round(score + CASE WHEN kind IN ('preference', 'feedback', 'fact', 'skill', 'reference') THEN 0.05 ELSE 0 END, 6) AS record_score, chunk_id AS best_chunk, round(score, 6) AS best_score, CAST(CASE WHEN kind IN ('preference', 'feedback', 'fact', 'skill', 'reference') THEN 0.05 ELSE 0 END AS DOUBLE) AS boost FROM matched m JOIN records USING (doc_id) WHERE place = 1"
)
def explained_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.explain(_matched(s, d), model.records(s, d)).withColumn("record_score", F.round("record_score", 6)).withColumn("best_score", F.round("best_score", 6))


_PACK = (
    _MATCHED.replace("WITH docs", "WITH RECURSIVE docs", 1)
    + """, full_hits AS (SELECT p.query_id, p.doc_id, r.id, adapter, instance, coalesce(CASE WHEN regexp_extract(native_path, '/\\.codex/([^/]+)', 1) <> '' THEN regexp_extract(native_path, '/\\.codex/([^/]+)', 1) END, '') AS project,
 p.score + CASE WHEN kind IN ('preference', 'feedback', 'fact', 'skill', 'reference') THEN 0.05 ELSE 0 END AS score, greatest(coalesce(updated_at, created_at), created_at) AS newest FROM matched p JOIN records r USING (doc_id) WHERE p.place = 1),
 s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, adapter, instance ORDER BY round(score * 100) DESC, newest DESC, id) AS a FROM full_hits), s2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, adapter, instance, project ORDER BY round(score * 100) DESC, newest DESC, id) AS b FROM s1 WHERE a <= 5),
 s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * 100) DESC, newest DESC, id) AS pos FROM s2 WHERE b <= 3),
 listed AS (SELECT m.query_id, m.doc_id, m.chunk_id, m.tokens, m.place AS c, s3.pos, s3.score, row_number() OVER (PARTITION BY m.query_id ORDER BY s3.pos, m.place) AS i FROM matched m JOIN s3 ON s3.query_id = m.query_id AND s3.doc_id = m.doc_id WHERE s3.pos <= 20),
 walk AS (SELECT query_id, i, pos, doc_id, score, chunk_id, tokens, tokens AS used, TRUE AS open, TRUE AS kept FROM listed WHERE i = 1 UNION ALL
  SELECT l.query_id, l.i, l.pos, l.doc_id, l.score, l.chunk_id, l.tokens, CASE WHEN (l.c = 1 AND w.used < 4000) OR (l.c > 1 AND w.open AND w.used + l.tokens <= 4000) THEN w.used + l.tokens ELSE w.used END,
  (l.c = 1 AND w.used < 4000) OR (l.c > 1 AND w.open AND w.used + l.tokens <= 4000), (l.c = 1 AND w.used < 4000) OR (l.c > 1 AND w.open AND w.used + l.tokens <= 4000) FROM walk w JOIN listed l ON l.query_id = w.query_id AND l.i = w.i + 1)"""
)


@query(_PACK + " SELECT CAST(query_id AS BIGINT) AS query_id, CAST(pos AS INTEGER) AS place, doc_id, round(score, 6) AS score, chunk_id, tokens FROM walk WHERE kept")
def packed_context(s: SparkSession, d: str) -> DataFrame:
    return retrieval.pack(_matched(s, d), model.records(s, d)).withColumn("score", F.round("score", 6))


@query(_PACK + " SELECT CAST(query_id AS BIGINT) AS query_id, string_agg('- ' || left(content, 240), chr(10) ORDER BY pos, i) AS prompt FROM walk JOIN chunks USING (chunk_id) WHERE kept AND pos <= 5 GROUP BY 1")
def prompt_find_related(s: SparkSession, d: str) -> DataFrame:
    """The first five records of a packed context as one text per query."""
    matched = cut(_matched(s, d))
    packed = retrieval.pack(matched, model.records(s, d)).filter("place <= 5").select("query_id", "place", "chunk_id")
    lines = packed.join(chunking.chunks(model.records(s, d)).select("chunk_id", "content"), "chunk_id")
    return _bullets(lines.join(matched.select("query_id", "chunk_id", F.col("place").alias("at")), ["query_id", "chunk_id"]), "query_id", ["place", "at"], "prompt")


def _bullets(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """One text of bullet lines per group of a bounded number of rows."""
    item = F.struct(*order, F.concat(F.lit("- "), F.substring("content", 1, 240)).alias("line"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias(name))


_JUDGED = """, subjects AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS query_id FROM subject_area), judged AS (SELECT DISTINCT query_id, doc_id FROM subjects JOIN subject_label USING (subject)),
 hits AS (SELECT query_id, max(1.0 / rank) AS rr, sum(1.0 / log2(rank + 1.0)) AS dcg, count(*) AS found FROM (SELECT * FROM ranked WHERE rank <= 10) JOIN judged USING (query_id, doc_id) GROUP BY 1),
 ideal AS (SELECT query_id, count(*) AS judged_relevant, sum(CASE WHEN place <= 10 THEN 1.0 / log2(place + 1.0) END) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM judged) GROUP BY 1)"""


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    subjects = _subjects(s, d)
    judged = table(s, d, "subject_label").join(subjects.select("query_id", "subject"), "subject").select("query_id", "doc_id", F.lit(1).alias("grade")).distinct()
    return retrieval.evaluate(retrieval.full_text(spread(model.records(s, d)), subjects.select("query_id", "text"), 10), judged, 10)


_EVALUATED = (
    _bm25(_SUBJECTS)
    + _JUDGED
    + ", evaluated AS (SELECT CAST(i.query_id AS BIGINT) AS query_id, coalesce(rr, 0) AS reciprocal_rank, coalesce(dcg / idcg, 0) AS ndcg, coalesce(found, 0) AS relevant_in_topk, judged_relevant FROM ideal i LEFT JOIN hits h ON h.query_id = i.query_id)"
)


@query(_EVALUATED + " SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, relevant_in_topk, judged_relevant FROM evaluated")
def retrieval_quality(s: SparkSession, d: str) -> DataFrame:
    return _evaluated(s, d).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6)).withColumn("ndcg", F.round("ndcg", 6))


@query(_EVALUATED + " SELECT count(*) AS queries, round(avg(reciprocal_rank), 6) AS mrr, round(coalesce(avg(ndcg) FILTER (judged_relevant > 0), 0), 6) AS ndcg, avg(reciprocal_rank) >= 0.05 AND avg(ndcg) >= 0.01 AS passed FROM evaluated")
def retrieval_means(s: SparkSession, d: str) -> DataFrame:
    means = retrieval.quality(_evaluated(s, d))
    gates = (F.col("mrr") >= 0.05) & (F.col("ndcg") >= 0.01)
    return means.select("queries", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), gates.alias("passed"))


@query("SELECT doc_id, chunk_id, seq, content, content_hash, token_estimate FROM chunks")
def chunked_records(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(model.records(s, d))


@query(
    f"""SELECT id, score FROM (SELECT id, round(0.45 * least(greatest((n - 40) / 560.0, 0.0), 1.0) + 0.20 * CASE WHEN age <= 0 THEN 1.0 ELSE pow(2.0, -age / 30.0) END
 + 0.35 * least(greatest((letters * 1.0 / greatest(n, 1) - 0.40) / 0.25, 0.0), 1.0), 6) AS score
 FROM (SELECT id, length(content) AS n, ({NOW} - created_at) / 86400.0 AS age, length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) AS letters FROM records WHERE kind = 'episode')) WHERE score >= 0.4 ORDER BY score DESC, id LIMIT 25"""
)
def extraction_candidates(s: SparkSession, d: str) -> DataFrame:
    return extraction.candidates(model.records(s, d), NOW).select("id", "score")


@query()
def derived_records(s: SparkSession, d: str) -> DataFrame:
    return extraction.derive(extraction.candidates(model.records(s, d), NOW))
