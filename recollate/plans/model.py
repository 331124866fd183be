"""The logical tables of the record store, derived from the input tables in SQL that both engines run.

``records`` comes from documents, ``metrics`` from events, ``vectors`` from embeddings; tombstones are the readmes, import errors
the documents without language or kind, user tags come from language and length, and a record derives from the one with half its number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from recollate.tables import table

_RECORDS = """SELECT doc_id, {sha}(concat(coalesce(adapter, ''), ':', coalesce(instance, ''), ':', CAST(doc_id AS {text}))) AS id,
 coalesce(adapter, '') AS adapter, coalesce(instance, '') AS instance, coalesce(text, '') AS content,
 CASE doc_kind WHEN 'note' THEN 'fact' WHEN 'persona' THEN 'preference' WHEN 'skill' THEN 'skill' WHEN 'session' THEN 'episode'
  WHEN 'readme' THEN 'reference' WHEN 'scenario' THEN 'reference' ELSE 'unknown' END AS kind,
 CASE lang WHEN 'en' THEN 'user' WHEN 'de' THEN 'project' WHEN 'es' THEN 'session' ELSE 'ephemeral' END AS scope,
 1704067200 + doc_id * 3600 AS created_at, CASE WHEN doc_kind = 'note' THEN 1704153600 + doc_id * 3600 END AS updated_at,
 concat(coalesce(doc_kind, 'x'), '-', coalesce(lang, 'x'), '-', CAST(n_chars AS {text})) AS native_id,
 CASE WHEN doc_kind <> 'persona' THEN concat('/home/u/.codex/', coalesce(source, ''), '/', CAST(doc_id AS {text}), '.md') END AS native_path,
 {sha}(coalesce(text, '')) AS raw_hash, CASE WHEN doc_id > 0 THEN CAST(floor(doc_id / 2) AS BIGINT) END AS derived_from
 FROM {documents}"""
_TAGS = """SELECT doc_id, CASE WHEN lang IS NULL THEN 'unsorted' ELSE lang END AS tag FROM {documents}
 UNION ALL SELECT doc_id, 'long' AS tag FROM {documents} WHERE n_chars > 1000"""
_TOMBSTONES = """SELECT doc_id, {sha}(concat(coalesce(adapter, ''), ':', coalesce(instance, ''), ':', CAST(doc_id AS {text}))) AS record_id,
 coalesce(adapter, '') AS adapter, coalesce(instance, '') AS instance, CASE WHEN n_chars > 1000 THEN 'too long' END AS reason, 1704067200 + doc_id * 60 AS forgotten_at,
 CASE WHEN doc_id > 0 THEN CAST(floor(doc_id / 2) AS BIGINT) END AS derived_from FROM {documents} WHERE doc_kind = 'readme'"""
_ERRORS = """SELECT doc_id AS error_id, coalesce(adapter, '') AS adapter, coalesce(instance, '') AS instance, CAST(doc_id AS {text}) AS native_id, CASE WHEN lang IS NULL THEN 'read' ELSE 'normalize' END AS phase, 1704067200 + n_chars AS occurred_at FROM {documents} WHERE lang IS NULL OR doc_kind IS NULL"""
_METRICS = """SELECT event_id, event_type AS tool, CAST(floor(value * 100) AS BIGINT) AS duration_ms, value < 150 AS ok, user_id, CAST(floor(value) AS BIGINT) AS result_count, event_id AS started_at FROM {events}"""


def _spark(text: str, **frames: DataFrame) -> DataFrame:
    spark = next(iter(frames.values())).sparkSession
    names = {n: f"{{{n}}}" for n in frames}
    sql = text.format(sha="sha2_256", text="STRING", **names)
    # sha2 takes the bit length in Spark.
    out, depth, i = [], [], 0
    while i < len(sql):
        if sql.startswith("sha2_256(", i):
            out.append("sha2(")
            depth.append(1)
            i += len("sha2_256(")
            continue
        if depth:
            depth[-1] += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth[-1] == 0:
                out.append(", 256")
                depth.pop()
        out.append(sql[i])
        i += 1
    return spark.sql("".join(out), **frames)


def records(spark: SparkSession, folder: str) -> DataFrame:
    return _spark(_RECORDS, documents=table(spark, folder, "documents"))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    return _spark(_TAGS, documents=table(spark, folder, "documents"))


def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    return _spark(_TOMBSTONES, documents=table(spark, folder, "documents"))


def import_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _spark(_ERRORS, documents=table(spark, folder, "documents"))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _spark(_METRICS, events=table(spark, folder, "events"))


_DENSE = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"


def tokens_sql(text: str) -> str:
    others = f"length(regexp_replace({text}, '[{_DENSE}]', '', 'g'))"
    return f"CAST(length({text}) - {others} + ceil({others} / 4.0) AS BIGINT)"


def _chunks_sql(most: int = 512, least: int = 32) -> str:
    """The chunker in SQL: a fold over the pieces of the first boundary at which all fit."""
    splits = ["string_split(content, E'\\n\\n')", "string_split(content, E'\\n')", "string_split_regex(content, '[.!?。！？]')", "string_split_regex(content, '[ \\t]')"]
    options = ", ".join(f"list_filter({x}, lambda p: p <> '')" for x in splits)
    glue, extra = "CASE b WHEN 1 THEN E'\\n\\n' WHEN 2 THEN E'\\n' ELSE ' ' END", "1"
    unit = f"list_transform(options[b], lambda p: {{'done': CAST([] AS VARCHAR[]), 'cur': p, 'n': {tokens_sql('p')}}})"
    fold = (
        f"list_reduce({unit}, lambda a, p: CASE WHEN a.cur = '' THEN {{'done': a.done, 'cur': p.cur, 'n': p.n}} WHEN a.n + p.n + {extra} <= {most} THEN {{'done': a.done, 'cur': a.cur || {glue} || p.cur, 'n': a.n + p.n + {extra}}} "
        f"WHEN a.n < {least} THEN {{'done': list_append(a.done, a.cur || {glue} || p.cur), 'cur': '', 'n': CAST(0 AS BIGINT)}} ELSE {{'done': list_append(a.done, a.cur), 'cur': p.cur, 'n': p.n}} END)"
    )
    return (
        f"SELECT doc_id, doc_id || ':' || (seq - 1) AS chunk_id, CAST(seq - 1 AS INTEGER) AS seq, pieces[seq] AS content, sha256(pieces[seq]) AS content_hash, {tokens_sql('pieces[seq]')} AS token_estimate FROM (SELECT doc_id, pieces, unnest(range(1, len(pieces) + 1)) AS seq FROM ("
        f"SELECT doc_id, [content] AS pieces FROM records WHERE {tokens_sql('content')} <= {most} UNION ALL SELECT doc_id, CASE WHEN b IS NULL THEN list_transform(range(0, length(content), {most}), lambda i: substr(content, i + 1, {most})) "
        f"ELSE list_filter(list_append(r.done, r.cur), lambda p: p <> '') END FROM (SELECT *, {fold} AS r FROM (SELECT *, list_position(list_transform(options, lambda o: len(list_filter(o, lambda p: {tokens_sql('p')} > {most})) = 0), TRUE) AS b "
        f"FROM (SELECT doc_id, content, [{options}] AS options FROM records WHERE {tokens_sql('content')} > {most})))))"
    )


def oracle(query: str) -> str:
    """query in DuckDB's SQL, over the CTEs records, tags, tombstones and metrics."""
    fill = {"sha": "sha256", "text": "VARCHAR", "documents": "documents", "events": "events"}
    parts = {"records": _RECORDS, "tags": _TAGS, "tombstones": _TOMBSTONES, "metrics": _METRICS, "import_errors": _ERRORS}
    heads = ", ".join(f"{n} AS ({t.format(**fill)})" for n, t in parts.items() if re.search(rf"\b{n}\b", query) or (n == "records" and re.search(r"\bchunks\b", query)))
    if re.search(r"\bchunks\b", query):
        heads += f", chunks AS ({_chunks_sql()})"
    if query.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {query.lstrip()[len('WITH RECURSIVE') :]}"
    if query.lstrip().upper().startswith("WITH"):
        return f"WITH {heads}, {query.lstrip()[len('WITH') :]}" if heads else query
    return f"WITH {heads} {query}" if heads else query
