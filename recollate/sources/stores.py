"""The thirteen stores, each read and projected to the common record.

Every reader returns (records, errors). A record has RECORD's columns; what cannot be projected goes to errors with its place and reason
instead of failing the read. Times are Unix seconds; ids are the SHA-256 of adapter, instance and native id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollate.operators.timestamps import with_instant
from recollate.sources import sqlite
from recollate.sources.files import body, front_matter, lines, text_files

RECORD = ["id", "adapter", "instance", "native_id", "native_path", "content", "kind", "scope", "created_at", "updated_at", "tags", "metadata", "raw_hash", "schema_version", "derived_from"]
#: Prefix of the keys that carry a record's origin through another store.
ORIGIN = "origin_"
Read = tuple[DataFrame, DataFrame]

# Kind and scope by the type in a memory file's front matter.
MEMORY_TYPES = {"user": ("fact", "user"), "feedback": ("feedback", "user"), "project": ("fact", "project"), "reference": ("reference", "user"), "preference": ("preference", "user"), "skill": ("skill", "user")}
# Kind and scope by memory_type.
CUBE_TYPES = {
    "WorkingMemory": ("reference", "ephemeral"), "LongTermMemory": ("fact", "user"), "UserMemory": ("preference", "user"), "PreferenceMemory": ("preference", "user"), "OuterMemory": ("reference", "user"),
    "ToolSchemaMemory": ("skill", "project"), "SkillMemory": ("skill", "project"), "ToolTrajectoryMemory": ("episode", "project"), "RawFileMemory": ("reference", "project"), "fact": ("fact", "user"),
    "opinion": ("preference", "user"), "preference": ("preference", "user"), "event": ("episode", "user"), "procedure": ("skill", "user"), "skill": ("skill", "user"),
}
# Kind and scope by the place of a file below local/<account>/.
VIKING_PLACES = (
    (r"^resources/", "reference", "user"), (r"^user/[^/]+/memories/profile\.md$", "preference", "user"), (r"^user/[^/]+/memories/preferences/", "preference", "user"), (r"^user/[^/]+/memories/entities/", "fact", "user"),
    (r"^user/[^/]+/memories/events/", "episode", "user"), (r"^agent/[^/]+/memories/cases/", "episode", "project"), (r"^agent/[^/]+/memories/patterns/", "reference", "project"), (r"^agent/[^/]+/memories/tools/", "reference", "project"),
    (r"^agent/[^/]+/memories/skills/", "reference", "project"), (r"^agent/[^/]+/skills/", "skill", "project"), (r"^agent/[^/]+/instructions/", "reference", "project"), (r"^session/[^/]+/\.(?:abstract|overview)\.md$", "episode", "session"),
)
PREVIEW = 400


def _pick(key: Column, table: dict[str, tuple[str, str]], default: tuple[str, str]) -> tuple[Column, Column]:
    kind, scope = F.lit(default[0]), F.lit(default[1])
    for name, (k, s) in table.items():
        kind, scope = F.when(key == name, k).otherwise(kind), F.when(key == name, s).otherwise(scope)
    return kind, scope


def seconds(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the Unix seconds of a text column in any notation; times without zone are UTC."""
    timed = with_instant(df.withColumn("__tz", F.lit("UTC")).withColumn("__order", F.lit("MDY")), value, "__tz", "__order", out="__us")
    return timed.withColumn(out, F.floor(F.col("__us") / 1000000)).drop("__tz", "__order", "__us")


def finish(df: DataFrame, adapter: str, instance: str | None) -> Read:
    """(records, errors) of a projection with native_id, content, kind, scope and any of the other columns."""
    have = set(df.columns)
    fill = {"native_path": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("long"), "tags": F.array().cast("array<string>"), "metadata": F.lit("{}"), "created_at": F.lit(None).cast("long")}
    for name, value in fill.items():
        if name not in have:
            df = df.withColumn(name, value)
    own = {"adapter": F.lit(adapter), "instance": F.lit(instance or ""), "native_id": F.col("native_id"), "kind": F.col("kind"), "scope": F.col("scope")}
    own["raw_hash"] = F.col("raw_hash") if "raw_hash" in have else F.sha2(F.coalesce("content", F.lit("")), 256)
    # A record that came out of another store carries its origin: it gets its identity and classification back, and the block goes.
    meta = F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>")
    origin = F.when(F.col("metadata").contains(f'"{ORIGIN}source_adapter"'), F.map_filter(meta, lambda k, _: k.startswith(ORIGIN)))
    df = df.select("*", F.inline(F.array(F.struct(origin.alias("__origin")))))
    of = lambda n: F.try_variant_get(F.try_element_at("__origin", F.lit(f"{ORIGIN}{n}")), "$", "string")
    back = {n: F.coalesce(of(f"source_{n}" if n in ("adapter", "instance") else n), c) for n, c in own.items()}
    tags = F.coalesce(F.try_variant_get(F.try_element_at("__origin", F.lit(f"{ORIGIN}tags")), "$", "array<string>"), "tags")
    rest = F.map_filter(meta, lambda k, _: ~k.startswith(ORIGIN))
    full = df.select(
        F.sha2(F.concat_ws(":", back["adapter"], back["instance"], back["native_id"]), 256).alias("id"), back["adapter"].alias("adapter"), back["instance"].alias("instance"), back["native_id"].alias("native_id"), "native_path",
        F.coalesce("content", F.lit("")).alias("content"), back["kind"].alias("kind"), back["scope"].alias("scope"), F.col("created_at").cast("long"), F.col("updated_at").cast("long"), tags.alias("tags"),
        F.when(F.col("__origin").isNotNull(), F.to_json(rest)).otherwise(F.col("metadata")).alias("metadata"), back["raw_hash"].alias("raw_hash"), F.lit(1).alias("schema_version"), of("derived_from").alias("derived_from"),
        F.col("content").isNull().alias("__broken"),
    )
    broken = F.col("native_id").isNull() | F.col("__broken")
    errors = full.filter(broken).select("adapter", "instance", "native_id", "native_path", F.lit("normalize").alias("phase"), F.when(F.col("native_id").isNull(), "no native id").otherwise("no content").alias("error"))
    return full.filter(~broken).select(*RECORD), errors


def _all(parts: list[Read]) -> Read:
    return reduce(DataFrame.unionByName, [p[0] for p in parts]), reduce(DataFrame.unionByName, [p[1] for p in parts])


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _variant(text: str, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(F.col(text)), path, "string")


def session_turns(content: Column, style: str) -> Column:
    """array<struct<role, text, at>> of a session file, one expression per file.

    style 'events': lines {type, message: {role, content}, timestamp}; 'items': lines {type: response_item, payload: {type: message, role, content}}. Other lines, other
    roles and turns without text are dropped; tool calls leave a short mark.
    """
    get = lambda v, p: F.try_variant_get(v, p, "string")
    events = style == "events"
    base = "$.message" if events else "$.payload"

    def text(v: Column) -> Column:
        blocks = F.try_variant_get(v, f"{base}.content", "array<variant>")

        def one(b: Column) -> Column:
            kind, result = get(b, "$.type"), F.coalesce(get(b, "$.content"), F.lit(""))
            preview = F.concat(F.lit("[tool_result("), F.length(result).cast("string"), F.lit(" chars): "), F.substring(result, 1, PREVIEW), F.when(F.length(result) > PREVIEW, "…").otherwise(""), F.lit("]"))
            marked = F.when(kind.isin("text", "input_text", "output_text"), stripped(F.coalesce(get(b, "$.text"), F.lit(""))))
            return marked.when(kind == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(get(b, "$.name"), F.lit("?")), F.lit("]"))).when(kind == "tool_result", preview) if events else marked

        joined = F.array_join(F.filter(F.transform(blocks, one), lambda t: t.isNotNull() & (t != "")), "\n\n")
        return stripped(F.when(blocks.isNotNull(), joined).otherwise(F.coalesce(get(v, f"{base}.content"), F.lit(""))))

    parsed = F.transform(F.split(content, r"\r?\n"), lambda line: F.try_parse_json(line))
    wanted = lambda v: get(v, "$.type").isin("user", "assistant") if events else ((get(v, "$.type") == "response_item") & (get(v, "$.payload.type") == "message") & get(v, "$.payload.role").isin("user", "assistant"))
    role = lambda v: F.coalesce(get(v, f"{base}.role"), get(v, "$.type"))
    turns = F.transform(F.filter(parsed, lambda v: F.coalesce(wanted(v), F.lit(False))), lambda v: F.struct(role(v).alias("role"), text(v).alias("text"), F.unix_seconds(F.try_to_timestamp(get(v, "$.timestamp"))).alias("at")))
    return F.filter(turns, lambda t: t["text"] != "")


def render_turns(turns: Column) -> Column:
    """The turns as Markdown, each under its role and minute."""
    stamp = lambda t: F.date_format(F.timestamp_seconds(t["at"]), "yyyy-MM-dd'T'HH:mm'Z'")
    one = lambda t: F.concat(F.lit("**"), t["role"], F.lit("**"), F.when(t["at"].isNotNull(), F.concat(F.lit(" — "), stamp(t))).otherwise(""), F.lit("\n\n"), t["text"], F.lit("\n\n"))
    return F.array_join(F.transform(turns, one), "")


def _sessions(files: DataFrame, style: str) -> DataFrame:
    read = files.select("path", "rel", "mtime", F.inline(F.array(F.struct(session_turns(F.col("content"), style).alias("turns")))))
    at = F.transform("turns", lambda t: t["at"])
    return read.select(
        F.concat(F.lit("session|"), "rel").alias("native_id"), F.col("path").alias("native_path"), render_turns(F.col("turns")).alias("content"), F.lit("episode").alias("kind"), F.lit("session").alias("scope"),
        F.coalesce(F.array_min(at), "mtime").alias("created_at"), F.array_max(at).alias("updated_at"), F.to_json(F.struct(F.size("turns").alias("message_count"))).alias("metadata"),
    )


def claude_code(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """Memory files with front matter (the index file is skipped) and session logs."""
    files = text_files(spark, root, "*.md", since).filter(F.col("rel").rlike(r"(^|/)memory/[^/]+\.md$") & (F.col("name") != "MEMORY.md"))
    kind, scope = _pick(front_matter(F.col("content"), "type"), MEMORY_TYPES, ("unknown", "ephemeral"))
    name, about = front_matter(F.col("content"), "name"), front_matter(F.col("content"), "description")
    memory = files.select(
        F.concat(F.lit("memory|"), "rel").alias("native_id"), F.col("path").alias("native_path"), body(F.col("content")).alias("content"), kind.alias("kind"), scope.alias("scope"), F.col("mtime").alias("created_at"),
        F.filter(F.array(name, about), lambda t: t.isNotNull()).alias("tags"), F.coalesce(front_matter(F.col("content"), "origin"), F.to_json(F.struct(name.alias("name"), about.alias("description")))).alias("metadata"), F.sha2("content", 256).alias("raw_hash"),
    )
    return _all([finish(memory, "claude-code", instance), finish(_sessions(text_files(spark, root, "*.jsonl", since), "events"), "claude-code", instance)])


def codex(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """Session logs: one JSON object a line in .jsonl, in .json a whole document, an array of the same objects or an object that holds one."""
    logs = text_files(spark, root, "*.jsonl", since)
    v = F.try_parse_json("content")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("items", "events", "messages")], F.when(v.isNotNull(), F.array(v)))
    lines_of = F.array_join(F.transform(listed, lambda i: F.to_json(i)), "\n")
    whole = text_files(spark, root, "*.json", since).withColumn("content", F.when(listed.isNotNull(), lines_of).otherwise(F.col("content")))
    return finish(_sessions(logs.unionByName(whole), "items"), "codex", instance)


def hermes(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """Two Markdown files, and every table with a text column of the databases beside them."""
    files = text_files(spark, root, "*.md", since).filter(F.col("rel").isin("MEMORY.md", "USER.md"))
    user = F.col("name") == "USER.md"
    parts = [finish(files.select(F.concat(F.lit("md|"), "name").alias("native_id"), F.col("path").alias("native_path"), "content", F.when(user, "preference").otherwise("reference").alias("kind"), F.lit("user").alias("scope"), F.col("mtime").alias("created_at")), "hermes", instance)]
    for db in sorted(p for p in Path(root).iterdir() if p.suffix in (".db", ".sqlite", ".sqlite3")):
        for t in sqlite.tables(str(db)):
            names = [n for n, _ in sqlite.columns(str(db), t)]
            text = next((n for n in ("content", "text", "body", "message") if n in names), None)
            if text is None:
                continue
            key = next((n for n in ("id", "uuid", "message_id") if n in names), names[0])
            at = next((n for n in ("created_at", "timestamp", "date", "ts") if n in names), None)
            rows = sqlite.read_table(spark, str(db), t).select(F.concat(F.lit(f"session|{t}|"), F.col(key).cast("string")).alias("native_id"), F.col(text).cast("string").alias("content"), (F.col(at).cast("string") if at else F.lit(None).cast("string")).alias("__at"))
            timed = seconds(rows, "__at", "created_at").drop("__at")
            if since is not None:
                timed = timed.filter(F.col("created_at").isNull() | (F.col("created_at") > since))
            parts.append(finish(timed.withColumn("native_path", F.lit(str(db))).withColumn("kind", F.lit("episode")).withColumn("scope", F.lit("session")), "hermes", instance))
    return _all(parts)


def openclaw(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    files = text_files(spark, root, "*", since)
    rel = F.col("rel")
    part = F.when(rel.rlike(r"^(openclaw\.json|workspace/(AGENTS|SOUL|TOOLS)\.md)$"), "config").when(rel.rlike(r"^workspace/skills/[^/]+/SKILL\.md$"), "skill").when(rel.rlike(r"^workspace/sessions/[^/]+\.(json|jsonl|ndjson)$"), "session")
    kind, scope = _pick(F.col("part"), {"config": ("reference", "user"), "skill": ("skill", "user"), "session": ("episode", "session")}, ("unknown", "ephemeral"))
    known = files.withColumn("part", part).filter(F.col("part").isNotNull())
    return finish(known.select(F.concat("part", F.lit("|"), "rel").alias("native_id"), F.col("path").alias("native_path"), "content", kind.alias("kind"), scope.alias("scope"), F.col("mtime").alias("created_at")), "openclaw", instance)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def mem0(spark: SparkSession, path: str, instance: str | None = None, since: int | None = None) -> Read:
    """memories(id, memory) with optional columns; unknown columns go to metadata, which never loses a key of its own."""
    rows = sqlite.read_table(spark, path, "memories")
    known = {"id", "memory", "metadata", "created_at", "updated_at", "categories", "hash"}
    extra = [c for c in rows.columns if c not in known]
    df = rows.select(F.col("id").cast("string").alias("native_id"), F.col("memory").alias("content"), _optional(rows, "created_at").alias("__c"), _optional(rows, "updated_at").alias("__u"), _optional(rows, "metadata").alias("__m"), F.to_json(F.struct(*[F.col(c) for c in extra]) if extra else F.create_map()).alias("__x"))
    own = F.coalesce(F.try_variant_get(F.try_parse_json("__m"), "$", "map<string,variant>"), F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))
    more = F.map_filter(F.try_variant_get(F.try_parse_json("__x"), "$", "map<string,variant>"), lambda k, _: ~F.map_contains_key(own, k))
    tags = F.coalesce(F.try_variant_get(F.try_parse_json("__m"), "$.categories", "array<string>"), F.array().cast("array<string>"))
    df = seconds(seconds(df.withColumn("metadata", F.to_json(F.map_concat(own, more))).withColumn("tags", tags), "__c", "created_at"), "__u", "updated_at")
    if since is not None:
        seen = F.coalesce("updated_at", "created_at")
        df = df.filter(seen.isNull() | (seen > since))
    return finish(df.withColumn("kind", F.lit("fact")).withColumn("scope", F.lit("user")), "mem0", instance)


def letta(spark: SparkSession, path: str, instance: str | None = None, since: int | None = None) -> Read:
    rows = sqlite.read_table(spark, path, "block")
    meta = "metadata_" if "metadata_" in rows.columns else "metadata"
    df = rows.select(
        F.col("id").cast("string").alias("native_id"), F.col("value").alias("content"), _optional(rows, "created_at").alias("__c"), _optional(rows, "updated_at").alias("__u"),
        F.filter(F.array(_optional(rows, "label")), lambda t: t.isNotNull()).alias("tags"), _optional(rows, "label").alias("__l"), _optional(rows, "description").alias("__d"), _optional(rows, meta).alias("__m"),
    )
    # The keys of the block's own metadata stand beside its label and description, which never replace one of them.
    own = F.coalesce(F.try_variant_get(F.try_parse_json("__m"), "$", "map<string,variant>"), F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))
    more = F.map_filter(F.try_variant_get(F.parse_json(F.to_json(F.struct(F.col("__l").alias("label"), F.col("__d").alias("description")))), "$", "map<string,variant>"), lambda k, _: ~F.map_contains_key(own, k))
    imported = F.coalesce(F.map_contains_key(own, F.lit(f"{ORIGIN}source_adapter")), F.lit(False))
    df = df.withColumn("metadata", F.when(imported, F.to_json(own)).otherwise(F.to_json(F.map_concat(own, more)))).drop("__l", "__d", "__m")
    df = seconds(seconds(df, "__c", "created_at"), "__u", "updated_at")
    if since is not None:
        seen = F.coalesce("updated_at", "created_at")
        df = df.filter(seen.isNull() | (seen > since))
    return finish(df.withColumn("kind", F.lit("fact")).withColumn("scope", F.lit("user")), "letta", instance)


def memori(spark: SparkSession, path: str, instance: str | None = None, since: int | None = None) -> Read:
    """Facts, process attributes, messages, summaries and knowledge-graph triples, each with left joins to what they belong to."""
    t = lambda name: sqlite.read_table(spark, path, name)
    parts = []

    def add(df: DataFrame, kind: str, scope: str) -> None:
        timed = seconds(df, "__at", "created_at").drop("__at")
        if since is not None:
            timed = timed.filter(F.col("created_at").isNull() | (F.col("created_at") > since))
        parts.append(finish(timed.withColumn("kind", F.lit(kind)).withColumn("scope", F.lit(scope)), "memori", instance))

    key = lambda family: F.concat(F.lit(f"{family}|"), F.coalesce(F.col("f.uuid"), F.col("f.id").cast("string"))).alias("native_id")
    latest = F.coalesce(F.col("f.date_last_time"), F.col("f.date_created")).alias("__at")
    for name, owner, link, kind, scope in (("memori_entity_fact", "memori_entity", "entity_id", "fact", "user"), ("memori_process_attribute", "memori_process", "process_id", "reference", "project")):
        f, o = t(name), t(owner)
        if f is not None and o is not None:
            joined = f.alias("f").join(o.alias("o"), F.col(f"f.{link}") == F.col("o.id"), "left")
            add(joined.select(key(name.removeprefix("memori_")), F.col("f.content").alias("content"), latest, F.to_json(F.struct(F.col("o.external_id").alias("owner"), F.col("f.num_times").alias("num_times"))).alias("metadata")), kind, scope)
    conv, msg = t("memori_conversation"), t("memori_conversation_message")
    if conv is not None and msg is not None:
        joined = msg.alias("f").join(conv.alias("c"), F.col("f.conversation_id") == F.col("c.id"), "left")
        add(joined.select(key("message"), F.col("f.content").alias("content"), F.col("f.date_created").alias("__at"), F.to_json(F.struct(F.col("f.role").alias("role"), F.col("c.uuid").alias("conversation"))).alias("metadata")), "episode", "session")
    if conv is not None:
        add(conv.alias("f").filter(F.col("summary").isNotNull()).select(key("summary"), F.col("f.summary").alias("content"), F.col("f.date_created").alias("__at")), "episode", "session")
    graph, subject, predicate, thing = (t(f"memori_{n}") for n in ("knowledge_graph", "subject", "predicate", "object"))
    if None not in (graph, subject, predicate, thing):
        joined = graph.alias("f").join(subject.alias("s"), F.col("f.subject_id") == F.col("s.id"), "left").join(predicate.alias("p"), F.col("f.predicate_id") == F.col("p.id"), "left").join(thing.alias("o"), F.col("f.object_id") == F.col("o.id"), "left")
        add(joined.select(key("triple"), F.concat_ws(" | ", F.coalesce("s.name", F.lit("")), F.coalesce("p.content", F.lit("")), F.coalesce("o.name", F.lit(""))).alias("content"), latest), "fact", "user")
    return _all(parts)


def memos(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """textual_memory.json files: a list, or a list under a known key; only activated items."""
    files = text_files(spark, root, "textual_memory.json", since)
    v = F.try_parse_json("content")
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("nodes", "items", "memories", "memory_items")])
    each = files.select("path", "mtime", F.explode(items).alias("i"))
    get = lambda p: F.try_variant_get("i", p, "string")
    kind, scope = _pick(get("$.metadata.memory_type"), CUBE_TYPES, ("reference", "user"))
    df = each.filter(F.coalesce(F.lower(get("$.metadata.status")) == "activated", F.lit(True))).select(
        get("$.id").alias("native_id"), F.col("path").alias("native_path"), get("$.memory").alias("content"), kind.alias("kind"), scope.alias("scope"), F.coalesce(get("$.metadata.updated_at"), get("$.metadata.created_at")).alias("__at"), "mtime",
        F.coalesce(F.try_variant_get("i", "$.metadata.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"), F.to_json(F.try_variant_get("i", "$.metadata", "variant")).alias("metadata"),
    )
    # What an export added beside the origin goes with it.
    added = F.map_filter(F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>"), lambda k, _: ~k.isin("status", "memory_type", "tags", "created_at"))
    df = df.withColumn("metadata", F.when(F.col("metadata").contains(f'"{ORIGIN}source_adapter"'), F.to_json(added)).otherwise(F.col("metadata")))
    return finish(seconds(df, "__at", "__s").withColumn("created_at", F.coalesce("__s", "mtime")), "memos", instance)


def memary(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    files = text_files(spark, root, "*", since)
    at = lambda name: files.filter(F.col("name") == name)
    v = F.try_parse_json("content")
    get = lambda p: F.try_variant_get("i", p, "string")
    each = lambda name, arrays: at(name).select("path", "mtime", F.posexplode(arrays).alias("n", "i"))
    whole = F.try_variant_get(v, "$", "array<variant>")
    number = F.col("n").cast("string")
    stream = each("memory_stream.json", whole).select(F.concat(F.lit("stream|"), number).alias("native_id"), F.concat(F.lit("entity mentioned: "), get("$.entity")).alias("content"), get("$.date").alias("__at"), "path", "mtime", F.lit("reference").alias("kind"), F.lit("project").alias("scope"))
    tally = each("entity_knowledge_store.json", whole).select(F.concat(F.lit("tally|"), number).alias("native_id"), F.concat(F.lit("entity tally: "), get("$.entity"), F.lit(" (count="), get("$.count"), F.lit(")")).alias("content"), get("$.date").alias("__at"), "path", "mtime", F.lit("reference").alias("kind"), F.lit("project").alias("scope"))
    chat = each("past_chat.json", F.coalesce(whole, F.try_variant_get(v, "$.messages", "array<variant>"))).select(F.concat(F.lit("chat|"), number).alias("native_id"), F.concat_ws(": ", get("$.role"), get("$.content")).alias("content"), F.lit(None).cast("string").alias("__at"), "path", "mtime", F.lit("episode").alias("kind"), F.lit("session").alias("scope"))
    persona = files.filter(F.col("name").isin("system_persona.txt", "user_persona.txt")).select(
        F.concat(F.lit("persona|"), "name").alias("native_id"), stripped(F.col("content")).alias("content"), F.lit(None).cast("string").alias("__at"), "path", "mtime", F.when(F.col("name") == "user_persona.txt", "preference").otherwise("reference").alias("kind"), F.when(F.col("name") == "user_persona.txt", "user").otherwise("project").alias("scope")
    )
    df = seconds(stream.unionByName(tally).unionByName(chat).unionByName(persona), "__at", "__s")
    if since is not None:
        df = df.filter(F.col("__s").isNull() | (F.col("__s") > since))
    return finish(df.withColumn("created_at", F.coalesce("__s", "mtime")).withColumn("native_path", F.col("path")), "memary", instance)


def mempalace(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """An identity file, and two collections of a vector database whose metadata rows are turned into one map per item."""
    files = text_files(spark, root, "identity.txt", since)
    parts = [finish(files.select(F.lit("identity").alias("native_id"), F.col("path").alias("native_path"), stripped(F.col("content")).alias("content"), F.lit("preference").alias("kind"), F.lit("user").alias("scope"), F.col("mtime").alias("created_at")), "mempalace", instance)]
    for db in sorted(Path(root).rglob("*.sqlite3")):
        items, segments, collections, meta = (sqlite.read_table(spark, str(db), n) for n in ("embeddings", "segments", "collections", "embedding_metadata"))
        if None in (items, segments, collections, meta):
            continue
        owner = segments.alias("s").join(collections.alias("c"), F.col("s.collection") == F.col("c.id")).select(F.col("s.id").cast("string").alias("segment_id"), F.col("c.name").alias("collection")).filter(F.col("collection").isin("mempalace_drawers", "mempalace_closets"))
        pairs = meta.select("id", F.col("key"), F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string")).alias("value")).filter(F.col("key").isNotNull()).groupBy("id", "key").agg(F.max("value").alias("value"))
        maps = pairs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
        joined = items.join(owner, "segment_id").join(maps, "id", "left")
        closet = F.col("collection") == "mempalace_closets"
        get = lambda k: F.try_element_at("m", F.lit(k))
        df = joined.filter(~F.coalesce(get("type") == "registry", F.lit(False))).select(
            F.concat_ws("|", "collection", "embedding_id").alias("native_id"), get("chroma:document").alias("content"), F.when(closet, "reference").otherwise("episode").alias("kind"), F.lit("project").alias("scope"),
            F.coalesce(get("created_unix"), get("filed_at")).alias("__at"), F.to_json(F.map_filter("m", lambda k, _: k != "chroma:document")).alias("metadata"), F.lit(str(db)).alias("native_path"),
        )
        parts.append(finish(seconds(df, "__at", "created_at"), "mempalace", instance))
    return _all(parts)


def openviking(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """Files classified by their place, and one record per line of the message logs; internal files are skipped."""
    below = F.regexp_extract("rel", r"^local/[^/]+/(.*)$", 1)
    files = text_files(spark, root, "*", since).withColumn("below", below).filter((F.col("below") != "") & ~F.col("name").isin(".relations.json", ".meta.json") & ~F.col("rel").rlike(r"(^|/)(_system|\.git|\.locks?)/"))
    kind, scope = F.lit("unknown"), F.lit("ephemeral")
    for pattern, k, s in reversed(VIKING_PLACES):
        kind, scope = F.when(F.col("below").rlike(pattern), k).otherwise(kind), F.when(F.col("below").rlike(pattern), s).otherwise(scope)
    layer = F.when(F.col("name") == ".abstract.md", "L0").when(F.col("name") == ".overview.md", "L1").otherwise("L2")
    plain = files.filter(F.col("name") != "messages.jsonl").select(F.concat(F.lit("viking://"), "below").alias("native_id"), F.col("path").alias("native_path"), "content", kind.alias("kind"), scope.alias("scope"), F.col("mtime").alias("created_at"), F.to_json(F.struct(layer.alias("layer"))).alias("metadata"))
    log = lines(files.filter(F.col("name") == "messages.jsonl")).withColumn("session", F.regexp_extract("rel", r"session/([^/]+)/", 1))
    v = F.try_parse_json("line")
    texts = F.transform(F.filter(F.try_variant_get(v, "$.parts", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.try_variant_get(p, "$.text", "string"))
    said = log.select(F.concat_ws("|", F.lit("message"), "session", F.coalesce(_variant("line", "$.id"), F.col("line_no").cast("string"))).alias("native_id"), F.col("path").alias("native_path"), F.when(v.isNotNull(), F.coalesce(F.array_join(texts, "\n"), F.lit(""))).alias("content"), F.lit("episode").alias("kind"), F.lit("session").alias("scope"), _variant("line", "$.created_at").alias("__at"), "mtime")
    return _all([finish(plain, "openviking", instance), finish(seconds(said, "__at", "__s").withColumn("created_at", F.coalesce("__s", "mtime")), "openviking", instance)])


def tdai(spark: SparkSession, root: str, instance: str | None = None, since: int | None = None) -> Read:
    """Four layers: references, fact lines, scenarios and the persona. A fact line may carry a content of its own."""
    files = text_files(spark, root, "*", since)
    layer = F.when(F.col("name") == "persona.md", "L3").when(F.col("rel").rlike(r"(^|/)refs/[^/]+\.md$"), "L0").when(F.col("name").rlike(r"\.(jsonl|ndjson)$"), "L1").when(F.col("name").endswith(".md"), "L2")
    known = files.withColumn("layer", layer).filter(F.col("layer").isNotNull())
    kind, scope = _pick(F.col("layer"), {"L0": ("episode", "session"), "L1": ("fact", "user"), "L2": ("reference", "user"), "L3": ("preference", "user")}, ("unknown", "ephemeral"))
    short = lambda *c: F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 32).alias("native_id")
    whole = known.filter("layer <> 'L1'").select(short("layer", "rel"), F.col("path").alias("native_path"), "content", kind.alias("kind"), scope.alias("scope"), F.col("mtime").alias("created_at"))
    facts = lines(known.filter("layer = 'L1'")).select(short("rel", F.col("line_no").cast("string")), F.col("path").alias("native_path"), F.coalesce(_variant("line", "$.content"), "line").alias("content"), F.lit("fact").alias("kind"), F.lit("user").alias("scope"), F.coalesce(_variant("line", "$.created_at").try_cast("long"), "mtime").alias("created_at"), _variant("line", "$.updated_at").try_cast("long").alias("updated_at"), F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json("line"), "$.origin", "variant")), F.lit("{}")).alias("metadata"))
    return _all([finish(whole, "tdai", instance), finish(facts, "tdai", instance)])


def resources(listed: DataFrame, instance: str | None = None) -> Read:
    """Records of resources already fetched from a server: uri, text, fetched_at (Unix seconds); templates are skipped."""
    kept = listed.filter(F.col("uri").isNull() | ~F.col("uri").contains("{"))
    return finish(kept.select(F.col("uri").alias("native_id"), F.col("text").alias("content"), F.lit("unknown").alias("kind"), F.lit("ephemeral").alias("scope"), F.col("fetched_at").alias("created_at"), F.array("uri").alias("tags")), "generic-mcp", instance)


def generic_mcp(spark: SparkSession, path: str, instance: str | None = None, since: int | None = None) -> Read:
    """Resources listed by a server, as JSON lines {uri, text, fetched_at}; lines without a uri go to the errors."""
    listed = spark.read.schema("uri string, text string, fetched_at long").json(path)
    return resources(listed if since is None else listed.filter(F.col("fetched_at").isNull() | (F.col("fetched_at") > since)), instance)


READERS: dict[str, Callable[..., Read]] = {
    "generic-mcp": generic_mcp,
    "claude-code": claude_code, "codex": codex, "hermes": hermes, "openclaw": openclaw, "mem0": mem0, "letta": letta, "memori": memori, "memos": memos, "memary": memary, "mempalace": mempalace, "openviking": openviking, "tdai": tdai,
}
