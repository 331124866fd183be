"""Queries p3 to p6 and p8 to p10 over the whole tables."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollate.llm import packing, personal
from recollate.llm.conversations import SPEAKERS, conversations, has_text, speaker_of, with_text
from recollate.llm.leakage import cleaned, leaks
from recollate.llm.neardup import groups, near_duplicates
from recollate.llm.packing import fill_containers
from recollate.llm.personal import Detector
from recollate.llm.splitting import LIMIT, OVERLAP, split_long
from recollate.llm.subjects import assign, train
from recollate.operators.nested import strict_json
from recollate.operators.timestamps import with_instant
from recollate.session import cut
from recollate.tables import spread, table


def _long_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that may be too long, with its item; exact copies once."""
    sources = (("tdai_l2_scenario", "path", "content"), ("openclaw_session_blob", "path", "content"), ("block", "id", "value"))
    parts = [
        table(spark, folder, name).filter(F.length(text) > 2000).select(F.lit(name).alias("origin"), F.col(key).alias("item_key"), F.col(text).alias("text")) for name, key, text in sources
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the oversized items, with their texts."""
    return split_long(_long_items(spark, folder).distinct(), ["origin", "item_key"], "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that had to be cut."""
    pieces = split_long(_long_items(spark, folder), ["origin", "item_key"], "text", with_text=False)
    return pieces.filter("n_pieces > 1 AND piece_no = 0").select("origin", "item_key").distinct()


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Every oversized text put together again from its pieces: its hash, whether all pieces keep the limit, and whether all overlap as they should."""
    keys = ["origin", "item_key", "of"]
    pieces = split_long(_long_items(spark, folder).withColumn("of", F.sha2("text", 256)).distinct(), keys, "text")
    each = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("p"))
    new = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], OVERLAP + 1, LIMIT)))
    held = F.forall("p", lambda x: (x["end_pos"] - x["start_pos"] <= LIMIT) & (F.length(x["piece"]) == x["end_pos"] - x["start_pos"]))
    linked = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i)["start_pos"] == F.get("p", i - 1)["end_pos"] - OVERLAP)
    return each.select("origin", "item_key", F.sha2(F.array_join(new, ""), 256).alias("rebuilt"), held.alias("within_limit"), linked.alias("overlapping")).distinct()


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Both message tables as one event log."""
    flat = table(spark, folder, "messages").select(
        F.lit("messages").alias("origin"), "session_id", F.col("id").alias("message_key"), F.lit(0).cast("long").alias("line"), "role", "created_at",
        has_text(F.col("content")).alias("filled"), F.lit(False).alias("broken"), F.col("content").alias("text"),
    )
    raw = table(spark, folder, "openviking_message")
    whole = strict_json(F.col("raw_json"))
    held = F.try_variant_get(whole, "$", "string")
    message = F.when(F.try_variant_get(whole, "$", "map<string,variant>").isNull() & held.rlike(r"^\s*\{"), strict_json(held)).otherwise(whole)
    lines = raw.select("source_path", "line_no", "session_id", F.inline(F.array(F.struct(message.alias("m")))))
    parts = F.try_variant_get("m", "$.parts", "array<variant>")
    texts = F.transform(F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.try_variant_get(p, "$.text", "string"))
    nested = lines.select(
        F.lit("openviking_message").alias("origin"),
        "session_id",
        F.coalesce(F.try_variant_get("m", "$.id", "string"), F.concat_ws("#", "source_path", F.col("line_no").cast("string"))).alias("message_key"),
        F.coalesce(F.col("line_no"), F.lit(0)).alias("line"),
        F.try_variant_get("m", "$.role", "string").alias("role"),
        F.try_variant_get("m", "$.created_at", "string").alias("created_at"),
        has_text(F.array_join(texts, "")).alias("filled"),
        F.try_variant_get("m", "$", "map<string,variant>").isNull().alias("broken"),
        F.array_join(texts, "").alias("text"),
    )
    log = flat.unionByName(nested).withColumn("created_at", F.when(F.col("created_at").rlike(r"^\s*\d{4}-\d{2}-\d{2}[Tt ]"), F.col("created_at")))
    log = log.withColumn("no_zone", F.lit(None).cast("string")).withColumn("no_order", F.lit(None).cast("string"))
    timed = with_instant(log, "created_at", "no_zone", "no_order", out="instant")
    return timed.select(
        "origin", "session_id", "message_key", F.col("line").alias("version"), "instant", "line", F.lit("create").alias("op"), speaker_of(F.col("role")).alias("speaker"), "filled", "broken", "text"
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The turns of all sessions that hold, in order."""
    return conversations(_events(spark, folder))


def p4_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The same turns with their texts."""
    events = _events(spark, folder)
    return with_text(cut(conversations(events)), events)


def p4_edited(spark: SparkSession, folder: str) -> DataFrame:
    """The turns after later rows of the log: by the last digit of the MD5 of their ids, messages are deleted (0), emptied by an edit (1) or sent again (2)."""
    events = _events(spark, folder)
    digit = F.when(F.col("origin") == "messages", F.substring(F.md5("message_key"), 32, 1))
    later = events.withColumn("digit", digit).filter(F.col("digit").isin("0", "1", "2")).withColumn("version", F.col("version") + 1).withColumn("line", F.col("line") + 1)
    later = later.withColumn("instant", F.col("instant") + 3_600_000_000).withColumn("op", F.when(F.col("digit") == "0", "delete").when(F.col("digit") == "1", "edit").otherwise("retry"))
    later = later.withColumn("filled", F.col("filled") & (F.col("digit") != "1")).drop("digit")
    return conversations(events.unionByName(later))


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of three tables under one key."""
    sources = (("memories", "memory"), ("block", "value"), ("memori_entity_fact", "content"))
    parts = [table(spark, folder, name).select(F.concat(F.lit(f"{name}:"), F.col("id").cast("string")).alias("key"), F.col(text).alias("text")) for name, text in sources]
    return spread(reduce(DataFrame.unionByName, parts))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of different records that share at least 0.8 of their words."""
    return near_duplicates(_notes(spark, folder), "key", "text")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its class of copies and the number of classes linked to it."""
    return groups(_notes(spark, folder), "key", "text")


def _messages_with_persons(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of both tables; a memory has the same text in every export."""
    memories = table(spark, folder, "memories").select(F.lit("memories").alias("origin"), F.col("id").alias("record_key"), F.col("memory").alias("text"))
    blobs = table(spark, folder, "openclaw_session_blob").select(F.lit("openclaw_session_blob").alias("origin"), F.col("path").alias("record_key"), F.col("content").alias("text"))
    return spread(memories.unionByName(blobs).filter(F.col("record_key").isNotNull()))


@cache
def _detector() -> Detector:
    return personal.train()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each mention of personal information."""
    return personal.mentions(_messages_with_persons(spark, folder), ["origin", "record_key"], "text", _detector()).distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts with typed placeholders."""
    return personal.redacted(_messages_with_persons(spark, folder), ["origin", "record_key"], "text", _detector())


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document."""
    return fill_containers(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers, counted."""
    return packing.check(p8_containers(spark, folder), table(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every document, by a chain trained on the labelled ones."""
    docs = table(spark, folder, "documents")
    chain = train(docs, table(spark, folder, "subject_label"), table(spark, folder, "subject_area"))
    return assign(spread(docs), chain).distinct()


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with each leaked item and how much they share."""
    return leaks(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, folder, "eval_item"), "item_id", "text")


def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that it shares beyond the limits."""
    return cleaned(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, folder, "eval_item"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents hold a run of at least twelve words of which item."""
    return p9_leaks(spark, folder).select("doc_id", "item_id").distinct()


QUERIES = {
    "p10_found": p10_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_checked": p3_checked,
    "p4_found": p4_found,
    "p4_conversations": p4_conversations,
    "p4_edited": p4_edited,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p8_containers": p8_containers,
    "p8_checked": p8_checked,
    "p9_found": p9_found,
    "p9_leaks": p9_leaks,
    "p9_cleaned": p9_cleaned,
}
_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_TURNS = r"""WITH roles(name, speaker) AS (VALUES ROLES),
 lines AS (SELECT session_id, source_path, line_no, CASE WHEN json_valid(raw_json) THEN CASE WHEN json_type(raw_json) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(raw_json, '$')) THEN json_extract_string(raw_json, '$') END ELSE raw_json END END AS j
  FROM (SELECT DISTINCT session_id, source_path, line_no, raw_json FROM openviking_message WHERE session_id IS NOT NULL)),
 ev AS (SELECT DISTINCT 'messages' AS origin, session_id, id AS message_key, 0 AS line, role, created_at, coalesce(content, '') AS txt, FALSE AS broken FROM messages WHERE session_id IS NOT NULL
  UNION ALL SELECT 'openviking_message', session_id, coalesce(json_extract_string(j, '$.id'), source_path || '#' || line_no), line_no, json_extract_string(j, '$.role'), json_extract_string(j, '$.created_at'),
  coalesce(array_to_string(list_transform(list_filter(CAST(json_extract(j, '$.parts') AS JSON[]), lambda p: json_extract_string(p, '$.type') = 'text'), lambda p: json_extract_string(p, '$.text')), ''), ''), j IS NULL FROM lines),
 parsed AS (SELECT origin, session_id, message_key, line, broken, speaker, txt, CASE WHEN regexp_matches(created_at, '^\s*\d{4}-\d{2}-\d{2}[Tt ]') THEN epoch_us(TRY_CAST(created_at AS TIMESTAMPTZ)) END AS moment, regexp_matches(txt, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') AS filled
  FROM ev LEFT JOIN roles ON name = lower(regexp_replace(role, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g'))),
 folded AS (SELECT origin, session_id, message_key, min(moment) AS moment, min(line) AS line, arg_max(speaker, line) AS speaker, arg_max(filled, line) AS filled, arg_max(txt, line) AS txt, bool_or(broken) AS broken FROM parsed GROUP BY 1, 2, 3),
 bad AS (SELECT DISTINCT origin, session_id FROM folded WHERE broken OR speaker IS NULL OR moment IS NULL),
 turns AS (SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS turn_no, lag(speaker) OVER w AS before, last_value(CASE WHEN speaker IN ('user', 'assistant') THEN speaker END IGNORE NULLS) OVER (PARTITION BY origin, session_id ORDER BY moment, line, message_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said
  FROM folded WHERE filled WINDOW w AS (PARTITION BY origin, session_id ORDER BY moment, line, message_key)),
 kept AS (SELECT origin, session_id FROM turns GROUP BY 1, 2 HAVING bool_or(speaker = 'user') AND arg_min(speaker, turn_no) FILTER (speaker <> 'system') = 'user' AND arg_max(speaker, turn_no) FILTER (speaker IN ('user', 'assistant')) = 'assistant'
  AND NOT bool_or(coalesce(speaker = 'user' AND before <> 'user' AND said = 'user', FALSE)))
 SELECT origin, session_id, turn_no, message_key, speaker COLUMNS FROM turns JOIN kept USING (origin, session_id) WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.origin = turns.origin AND b.session_id = turns.session_id)""".replace(
        "ROLES", ", ".join(f"('{name}', '{speaker}')" for speaker, names in SPEAKERS.items() for name in names)
    )
ORACLE: dict[str, str] = {
    "p3_found": "SELECT DISTINCT * FROM (SELECT 'tdai_l2_scenario' AS origin, path AS item_key FROM tdai_l2_scenario WHERE length(content) > 2000 UNION ALL SELECT 'openclaw_session_blob', path FROM openclaw_session_blob "
    "WHERE length(content) > 2000 UNION ALL SELECT 'block', id FROM block WHERE length(value) > 2000)",
    "p3_checked": "SELECT DISTINCT origin, item_key, sha256(t) AS rebuilt, TRUE AS within_limit, TRUE AS overlapping FROM (SELECT 'tdai_l2_scenario' AS origin, path AS item_key, content AS t FROM tdai_l2_scenario UNION ALL "
    "SELECT 'openclaw_session_blob', path, content FROM openclaw_session_blob UNION ALL SELECT 'block', id, value FROM block) WHERE length(t) > 2000",
    "p4_found": _TURNS.replace("COLUMNS", ""),
    "p4_conversations": _TURNS.replace("COLUMNS", ", txt AS text"),
    "p4_edited": _TURNS.replace("COLUMNS", "").replace("coalesce(content, '') AS txt", "CASE WHEN right(md5(id), 1) = '1' THEN '' ELSE coalesce(content, '') END AS txt").replace("FROM messages WHERE", "FROM messages WHERE right(md5(id), 1) <> '0' AND"),
    "p5_found": f"""WITH texts AS (SELECT DISTINCT 'memories:' || id AS key, memory AS t FROM memories UNION SELECT 'block:' || id, value FROM block UNION SELECT 'memori_entity_fact:' || id, content FROM memori_entity_fact),
 sets AS (SELECT key, list_distinct({_WORDS.format("t")}) AS w FROM texts WHERE t IS NOT NULL), words AS (SELECT key, len(w) AS n, unnest(w) AS word FROM sets), df AS (SELECT word, count(*) AS df FROM words GROUP BY 1),
 prefix AS (SELECT key, word FROM (SELECT key, word, n, row_number() OVER (PARTITION BY key ORDER BY df, word) AS r FROM words JOIN df USING (word)) WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
 pairs AS (SELECT DISTINCT a.key AS key_a, b.key AS key_b FROM prefix a JOIN prefix b ON a.word = b.word AND a.key < b.key)
 SELECT key_a, key_b FROM (SELECT key_a, key_b, len(list_intersect(x.w, y.w)) AS common, len(x.w) + len(y.w) AS total FROM pairs JOIN sets x ON x.key = key_a JOIN sets y ON y.key = key_b) WHERE common >= 0.8 * (total - common) - 1e-12""",
    "p8_checked": "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS placed, CAST(0 AS BIGINT) AS cut_without_need, CAST(0 AS BIGINT) AS placed_twice, CAST(0 AS BIGINT) AS wrong_containers FROM documents",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_item), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
 gi AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS gram FROM i, unnest(range(1, len(w) - 10)) AS t(k)), gd AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS gram FROM d, unnest(range(1, len(w) - 10)) AS t(k))
 SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (gram)""",
}
