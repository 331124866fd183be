"""Queries p1, p2 and p7: schema drift, nested records and timestamps over the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollate.operators.drift import drift_report, field_rows, layouts, unified, union_rows
from recollate.operators.nested import flatten_records
from recollate.operators.timestamps import with_instant
from recollate.session import cut
from recollate.tables import spread, table


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    """Every value that may denote an instant, with its record."""
    sources = (
        ("memories", F.col("id"), "created_at"),
        ("memori_entity_fact", F.col("id").cast("string"), "date_created"),
        ("memary_stream_entry", F.concat_ws("#", "source_path", F.col("entry_index").cast("string")), "date"),
    )
    return reduce(
        DataFrame.unionByName,
        (table(spark, folder, name).select(F.lit(name).alias("origin"), key.alias("record_key"), "instance", F.col(value).alias("value")) for name, key, value in sources),
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """One UTC instant per readable value of the three tables."""
    zones = table(spark, folder, "store_instance").groupBy("instance").agg(F.min("tz_name").alias("tz_name"), F.min("date_order").alias("date_order"))
    values = _timed(spark, folder).filter(F.col("value").rlike("[0-9]")).distinct()
    timed = with_instant(values.join(zones, "instance", "left"), "value", "tz_name", "date_order")
    return timed.filter(F.col("epoch_us").isNotNull() & F.col("record_key").isNotNull()).select("origin", "record_key", "epoch_us").distinct()


def _nested(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON text with its record; metadata counts only if it is an object."""
    lines = table(spark, folder, "openviking_message").select(
        F.lit("openviking_message").alias("origin"), F.concat(F.col("source_path"), F.lit("#"), F.col("line_no").cast("string")).alias("record_key"), F.col("raw_json").alias("text")
    )
    notes = table(spark, folder, "memories").select(
        F.lit("memories").alias("origin"), F.concat(F.col("id"), F.lit("@"), F.col("export_no").cast("string")).alias("record_key"), F.when(F.col("metadata").rlike(r"^\s*\{"), F.col("metadata")).alias("text")
    )
    return spread(lines.unionByName(notes))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per object that is an element of an array in raw_json or metadata, linked to its parent."""
    return flatten_records(_nested(spark, folder), ["origin", "record_key"], "text")


def p2_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The flat child table: each array object with its own JSON beside its link."""
    return flatten_records(_nested(spark, folder), ["origin", "record_key"], "text", with_node=True)


def _exports(spark: SparkSession, folder: str, others: bool = False) -> DataFrame:
    return union_rows(
        [
            field_rows(table(spark, folder, "memories"), "memories", "metadata", "metadata", others=others),
            field_rows(table(spark, folder, "block"), "block", "metadata_", "metadata_", "label", others=others),
        ]
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each field added, removed, renamed or retyped from one export of an instance to the next."""
    return drift_report(_exports(spark, folder)).drop("score", "chosen")


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All exports in one consistent table with all columns of both, renamed fields under one name."""
    rows = _exports(spark, folder, others=True)
    # Both are schema-sized and used for the names as well as for the columns.
    fields = cut(layouts(rows))
    report = cut(drift_report(_exports(spark, folder), proposed=True, fields=fields))
    return unified(rows, report, fields)


QUERIES = {"p1_found": p1_found, "p1_unified": p1_unified, "p2_found": p2_found, "p2_nodes": p2_nodes, "p7_found": p7_found}

# DuckDB's parser accepts a comma before a closing bracket, which strict JSON does not.
_NODES = r"""WITH RECURSIVE texts AS (SELECT DISTINCT 'openviking_message' AS origin, source_path || '#' || line_no AS record_key, raw_json AS t FROM openviking_message
 UNION SELECT 'memories', id || '@' || export_no, CASE WHEN regexp_matches(metadata, '^\s*\{') THEN metadata END FROM memories),
 roots AS (SELECT origin, record_key, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(json_extract_string(v, '$')) AND regexp_matches(json_extract_string(v, '$'), '^\s*[\[{]') THEN CAST(json_extract_string(v, '$') AS JSON) ELSE v END AS v
  FROM (SELECT origin, record_key, CAST(CASE WHEN json_valid(t) AND NOT regexp_matches(t, ',\s*[\]}]') THEN t END AS JSON) AS v FROM texts WHERE t IS NOT NULL AND record_key IS NOT NULL)),
 walk(origin, record_key, path, anc, elem, v) AS (SELECT origin, record_key, '$', '$', FALSE, v FROM roots WHERE v IS NOT NULL UNION ALL
  SELECT origin, record_key, path, anc, elem, CASE WHEN json_type(v) = 'VARCHAR' AND regexp_matches(json_extract_string(v, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(v, '$')) THEN CAST(json_extract_string(v, '$') AS JSON) ELSE v END
  FROM (SELECT origin, record_key, CASE WHEN json_type(w.v) = 'OBJECT' THEN w.path || '.' || c.key ELSE w.path || '[' || c.key || ']' END AS path, CASE WHEN elem AND json_type(w.v) = 'OBJECT' THEN w.path ELSE anc END AS anc, json_type(w.v) = 'ARRAY' AS elem, c.value AS v
   FROM walk w, json_each(w.v) c WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')))
 SELECT DISTINCT origin, record_key, path AS node_path, anc AS parent_path FROM walk WHERE elem AND json_type(v) = 'OBJECT'"""
_CHANGES = r"""WITH src AS (SELECT DISTINCT 'memories' AS origin, instance, export_no, id, metadata AS j, CAST(NULL AS VARCHAR) AS label FROM memories UNION ALL SELECT DISTINCT 'block', instance, export_no, id, metadata_, label FROM block),
 rec AS (SELECT origin, instance, export_no, id, label, CAST(CASE WHEN regexp_matches(j, '^\s*\{') AND json_valid(j) AND NOT regexp_matches(j, ',\s*[\]}]') THEN j END AS JSON) AS o FROM src),
 raw AS (SELECT origin, instance, export_no, rec.id AS id, CASE origin WHEN 'block' THEN 'metadata_.' ELSE 'metadata.' END || c.key AS field, c.value AS v FROM rec, json_each(o) c WHERE o IS NOT NULL
  UNION ALL SELECT origin, instance, export_no, id, 'label', CASE WHEN regexp_matches(label, '^\s*\[') AND json_valid(label) THEN CAST(label AS JSON) ELSE to_json(label) END FROM rec WHERE label IS NOT NULL),
 cells AS (SELECT DISTINCT origin, instance, export_no, id, field, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t,
  CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END AS x FROM raw),
 present AS (SELECT origin, instance, export_no, field, list_sort(coalesce(list(DISTINCT t) FILTER (t IS NOT NULL), [])) AS types FROM cells GROUP BY 1, 2, 3, 4),
 steps AS (SELECT origin, instance, export_no, lag(export_no) OVER (PARTITION BY origin, instance ORDER BY export_no) AS former_no FROM (SELECT DISTINCT origin, instance, export_no FROM src)),
 gone AS (SELECT s.*, p.field FROM steps s JOIN present p ON p.origin = s.origin AND p.instance = s.instance AND p.export_no = s.former_no WHERE NOT EXISTS (SELECT 1 FROM present q WHERE q.origin = s.origin AND q.instance = s.instance AND q.export_no = s.export_no AND q.field = p.field)),
 fresh AS (SELECT s.*, p.field FROM steps s JOIN present p ON p.origin = s.origin AND p.instance = s.instance AND p.export_no = s.export_no WHERE former_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM present q WHERE q.origin = s.origin AND q.instance = s.instance AND q.export_no = s.former_no AND q.field = p.field)),
 readable AS (SELECT DISTINCT origin, instance, export_no, id FROM rec WHERE o IS NOT NULL),
 carriers AS (SELECT g.origin, g.instance, g.export_no, g.field, c.id, c.t, c.x FROM gone g JOIN cells c ON c.origin = g.origin AND c.instance = g.instance AND c.export_no = g.former_no AND c.field = g.field
  JOIN readable a ON a.origin = g.origin AND a.instance = g.instance AND a.export_no = g.former_no AND a.id = c.id JOIN readable b ON b.origin = g.origin AND b.instance = g.instance AND b.export_no = g.export_no AND b.id = c.id),
 total AS (SELECT origin, instance, export_no, field, count(*) AS n FROM carriers GROUP BY 1, 2, 3, 4),
 same AS (SELECT k.origin, k.instance, k.export_no, k.field AS former, f.field, count(*) AS n FROM carriers k JOIN fresh f ON f.origin = k.origin AND f.instance = k.instance AND f.export_no = k.export_no
  JOIN cells c ON c.origin = k.origin AND c.instance = k.instance AND c.export_no = k.export_no AND c.id = k.id AND c.field = f.field AND c.t IS NOT DISTINCT FROM k.t AND c.x IS NOT DISTINCT FROM k.x GROUP BY 1, 2, 3, 4, 5),
 renamed AS (SELECT s.origin, s.instance, s.export_no, s.field, s.former FROM same s JOIN total t ON t.origin = s.origin AND t.instance = s.instance AND t.export_no = s.export_no AND t.field = s.former AND t.n = s.n)
 SELECT origin, instance, export_no, field, 'renamed' AS change, former FROM renamed
 UNION ALL SELECT origin, instance, export_no, field, 'removed', '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.origin = g.origin AND r.instance = g.instance AND r.export_no = g.export_no AND r.former = g.field)
 UNION ALL SELECT origin, instance, export_no, field, 'added', '' FROM fresh g WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.origin = g.origin AND r.instance = g.instance AND r.export_no = g.export_no AND r.field = g.field)
 UNION ALL SELECT s.origin, s.instance, s.export_no, p.field, 'retyped', '' FROM steps s JOIN present p ON p.origin = s.origin AND p.instance = s.instance AND p.export_no = s.export_no JOIN present q ON q.origin = s.origin AND q.instance = s.instance AND q.export_no = s.former_no AND q.field = p.field WHERE p.types <> q.types"""
ORACLE: dict[str, str] = {"p1_found": _CHANGES, "p2_found": _NODES}
