"""Sources, sinks and the watch loop as queries: each builds a store from whole input tables, reads it with its reader, and has SQL over the same rows.

The stores stand in the shared folder of the session, which must be a mounted path, and are built anew at each call. A store is written
row by row through the driver, as other programs would have written it; reading is distributed.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import sqlite3
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollate.plans import model
from recollate.plans.model import oracle
from recollate.session import cut, shared_folder
from recollate.sinks import export
from recollate.sources import files, stores
from recollate.streaming import watch
from recollate.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str, Path], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            place = Path(shared_folder(spark).removeprefix("file:"), f"store-{uuid.uuid4().hex}")
            place.mkdir(parents=True)
            try:
                return cut(f(spark, folder, place))
            finally:
                shutil.rmtree(place, ignore_errors=True)

        QUERIES[f.__name__] = run
        ORACLE[f.__name__] = oracle(sql)
        return f

    return add


def _rows(df: DataFrame) -> Iterator[tuple]:
    return (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True))


def _sqlite(path: Path, ddl: str, statement: str, rows: Iterator[tuple]) -> str:
    with sqlite3.connect(path) as c:
        c.executescript(ddl)
        c.executemany(statement, rows)
    return str(path)


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _sessions(spark: SparkSession, folder: str) -> Iterator[tuple[str, list[tuple]]]:
    """(session, its messages (id, role, content, created_at) in order of id), exact copies once."""
    m = table(spark, folder, "messages").filter("session_id IS NOT NULL").select("session_id", "id", "role", "content", "created_at").distinct().orderBy("session_id", "id")
    for session, rows in groupby(_rows(m), key=lambda r: r[0]):
        yield session, [r[1:] for r in rows]


# --- databases


@query("SELECT id || '@' || export_no AS native_id, memory AS content, sha256('mem0:main:' || id || '@' || export_no) AS id, 'fact' AS kind, 'user' AS scope FROM (SELECT DISTINCT id, export_no, memory FROM memories WHERE memory IS NOT NULL)")
def source_mem0(s: SparkSession, d: str, at: Path) -> DataFrame:
    rows = table(s, d, "memories").select(F.concat("id", F.lit("@"), "export_no"), "memory", "user_id", F.lit(None).cast("string"), "created_at").distinct().groupBy(F.col("concat(id, @, export_no)").alias("id")).agg(F.max("memory"), F.max("user_id"), F.lit(None).cast("string"), F.max("created_at"))
    db = _sqlite(at / "m.db", "CREATE TABLE memories (id TEXT, memory TEXT, user_id TEXT, metadata TEXT, created_at TEXT)", "INSERT INTO memories VALUES (?,?,?,?,?)", _rows(rows))
    return stores.mem0(s, db, "main")[0].select("native_id", "content", "id", "kind", "scope")


@query("SELECT id || '@' || export_no AS native_id, max(value) AS content, coalesce(max(label), '') AS label FROM block WHERE value IS NOT NULL GROUP BY 1")
def source_letta(s: SparkSession, d: str, at: Path) -> DataFrame:
    rows = table(s, d, "block").filter("value IS NOT NULL").groupBy(F.concat("id", F.lit("@"), "export_no").alias("id")).agg(F.max("value"), F.max("label"))
    db = _sqlite(at / "l.db", "CREATE TABLE block (id TEXT, value TEXT, label TEXT)", "INSERT INTO block VALUES (?,?,?)", _rows(rows))
    return stores.letta(s, db)[0].select("native_id", "content", F.array_join("tags", ",").alias("label"))


@query("SELECT 'entity_fact|' || uuid AS native_id, content, CAST(CASE WHEN entity_id % 2 = 0 THEN 'owner-' || entity_id END AS VARCHAR) AS owner, CAST(num_times AS BIGINT) AS num_times FROM (SELECT DISTINCT id, uuid, entity_id, content, num_times FROM memori_entity_fact) WHERE content IS NOT NULL")
def source_memori(s: SparkSession, d: str, at: Path) -> DataFrame:
    facts = table(s, d, "memori_entity_fact").select("id", "uuid", "entity_id", "content", "num_times").distinct()
    ddl = "CREATE TABLE memori_entity (id INTEGER, uuid TEXT, external_id TEXT); CREATE TABLE memori_entity_fact (id INTEGER, uuid TEXT, entity_id INTEGER, content TEXT, num_times INTEGER, date_last_time TEXT, date_created TEXT)"
    db = _sqlite(at / "r.db", ddl, "INSERT INTO memori_entity_fact VALUES (?,?,?,?,?,NULL,NULL)", _rows(facts))
    owners = facts.filter("entity_id % 2 = 0").select("entity_id", F.concat(F.lit("owner-"), "entity_id")).distinct()
    _sqlite(at / "r.db", "", "INSERT INTO memori_entity (id, external_id) VALUES (?,?)", _rows(owners))
    return stores.memori(s, db)[0].select("native_id", "content", F.get_json_object("metadata", "$.owner").alias("owner"), F.get_json_object("metadata", "$.num_times").cast("long").alias("num_times"))


@query("SELECT 'session|messages|' || id AS native_id, content, 'episode' AS kind FROM (SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL) UNION ALL SELECT 'md|USER.md', 'likes tea', 'preference' UNION ALL SELECT 'md|MEMORY.md', 'knows tea', 'reference'")
def source_hermes(s: SparkSession, d: str, at: Path) -> DataFrame:
    _write(at / "MEMORY.md", "knows tea")
    _write(at / "USER.md", "likes tea")
    rows = table(s, d, "messages").filter("content IS NOT NULL").select("id", "role", "content", "created_at").distinct()
    _sqlite(at / "state.db", "CREATE TABLE messages (id TEXT, role TEXT, content TEXT, created_at TEXT); CREATE TABLE bare (id TEXT)", "INSERT INTO messages VALUES (?,?,?,?)", _rows(rows))
    return stores.hermes(s, str(at))[0].select("native_id", "content", "kind")


@query("SELECT CASE WHEN id % 3 = 0 THEN 'mempalace_closets' ELSE 'mempalace_drawers' END || '|e' || id AS native_id, content, CASE WHEN id % 3 = 0 THEN 'reference' ELSE 'episode' END AS kind, 1700000000 + id AS created_at FROM (SELECT DISTINCT id, content FROM memori_entity_fact WHERE content IS NOT NULL) WHERE id % 7 <> 0 UNION ALL SELECT 'identity', 'I am', 'preference', NULL")
def source_mempalace(s: SparkSession, d: str, at: Path) -> DataFrame:
    """Every seventh item is a registry entry, which the reader leaves out; every third lies in a closet."""
    _write(at / "identity.txt", "I am\n")
    facts = table(s, d, "memori_entity_fact").filter("content IS NOT NULL").select("id", "content").distinct()
    ddl = ("CREATE TABLE collections (id TEXT, name TEXT); CREATE TABLE segments (id TEXT, collection TEXT); CREATE TABLE embeddings (id INTEGER, segment_id TEXT, embedding_id TEXT);"
           "CREATE TABLE embedding_metadata (id INTEGER, key TEXT, string_value TEXT, int_value INTEGER, float_value REAL, bool_value INTEGER);"
           "INSERT INTO collections VALUES ('c0', 'mempalace_drawers'), ('c1', 'mempalace_closets'), ('c2', 'other'); INSERT INTO segments VALUES ('s0', 'c0'), ('s1', 'c1'), ('s2', 'c2')")  # fmt: skip
    path = at / "chroma.sqlite3"
    _sqlite(path, ddl, "INSERT INTO embeddings VALUES (?,?,?)", _rows(facts.select("id", F.when(F.col("id") % 3 == 0, "s1").otherwise("s0"), F.concat(F.lit("e"), "id"))))
    _sqlite(path, "", "INSERT INTO embedding_metadata (id, key, string_value) VALUES (?,'chroma:document',?)", _rows(facts))
    _sqlite(path, "", "INSERT INTO embedding_metadata (id, key, string_value) VALUES (?,'type','registry')", _rows(facts.filter("id % 7 = 0").select("id")))
    _sqlite(path, "", "INSERT INTO embedding_metadata (id, key, int_value) VALUES (?,'created_unix',?)", _rows(facts.select("id", F.col("id") + 1700000000)))
    return stores.mempalace(s, str(at))[0].select("native_id", "content", "kind", F.when(F.col("native_id") != "identity", F.col("created_at")).alias("created_at"))


# --- files


_TURNS = "SELECT md5(session_id) AS m, role, content FROM (SELECT DISTINCT session_id, id, role, content FROM messages WHERE session_id IS NOT NULL) WHERE role IN ('user', 'assistant') AND regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''"


@query(f"WITH t AS ({_TURNS}) SELECT 'session|p/' || m || '.jsonl' AS native_id, CAST(count(*) AS BIGINT) AS turns, 'episode' AS kind FROM t GROUP BY 1 UNION ALL SELECT 'memory|p/memory/' || md5(path) || '.md', 1, 'feedback' FROM (SELECT DISTINCT path FROM tdai_l2_scenario)")
def source_session_logs(s: SparkSession, d: str, at: Path) -> DataFrame:
    """Memory files with front matter and session logs of events, the index file left out."""
    for session, rows in _sessions(s, d):
        _write(at / "p" / f"{_md5(session)}.jsonl", "\n".join(json.dumps({"type": r[1] or "x", "message": {"role": r[1], "content": r[2]}, "timestamp": r[3]}) for r in rows))
    for (path,) in _rows(table(s, d, "tdai_l2_scenario").select("path").distinct()):
        _write(at / "p/memory" / f"{_md5(path)}.md", "---\nname: n\nmetadata:\n  type: feedback\n---\n\nbody\n")
    _write(at / "p/memory/MEMORY.md", "index")
    read, _ = stores.claude_code(s, str(at))
    turns = F.coalesce(F.get_json_object("metadata", "$.message_count").cast("long"), F.lit(1).cast("long"))
    return read.filter(turns > 0).select("native_id", turns.alias("turns"), "kind")


@query(f"WITH t AS ({_TURNS}) SELECT 'session|' || m || CASE WHEN m < '8' THEN '.json' ELSE '.jsonl' END AS native_id, count(*) AS turns FROM t GROUP BY 1")
def source_item_logs(s: SparkSession, d: str, at: Path) -> DataFrame:
    """Session logs of response items, half of them one line an item, half a pretty-printed document."""
    for session, rows in _sessions(s, d):
        items = [{"type": "response_item", "payload": {"type": "message", "role": r[1], "content": [{"type": "input_text", "text": r[2] or ""}]}, "timestamp": r[3]} for r in rows]
        name = _md5(session)
        if name < "8":
            _write(at / f"{name}.json", json.dumps(items, indent=2))
        else:
            _write(at / f"{name}.jsonl", "\n".join(map(json.dumps, items)))
    turns = F.get_json_object("metadata", "$.message_count").cast("long")
    return stores.codex(s, str(at))[0].filter(turns > 0).select("native_id", turns.alias("turns"))


@query("SELECT 'session|workspace/sessions/' || md5(path) || '.jsonl' AS native_id, sha256(content) AS raw_hash, 'episode' AS kind FROM (SELECT DISTINCT path, content FROM openclaw_session_blob WHERE content IS NOT NULL AND content <> '') UNION ALL SELECT 'config|openclaw.json', sha256('{}'), 'reference' UNION ALL SELECT 'skill|workspace/skills/a/SKILL.md', sha256('do'), 'skill'")
def source_openclaw(s: SparkSession, d: str, at: Path) -> DataFrame:
    for path, content in _rows(table(s, d, "openclaw_session_blob").select("path", "content").filter("content <> ''").distinct()):
        p = at / "workspace/sessions" / f"{_md5(path)}.jsonl"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content.encode())
    _write(at / "openclaw.json", "{}")
    _write(at / "workspace/skills/a/SKILL.md", "do")
    _write(at / "workspace/other.txt", "no")
    return stores.openclaw(s, str(at))[0].select("native_id", "raw_hash", "kind")


@query(f"""WITH m AS (SELECT DISTINCT md5(session_id) AS s, id, content FROM messages WHERE session_id IS NOT NULL), x AS (SELECT DISTINCT s FROM m)
 SELECT 'message|' || s || '|' || id AS native_id, coalesce(content, '') AS content, 'episode' AS kind, NULL AS layer FROM m UNION ALL SELECT 'viking://session/' || s || '/.abstract.md', 'short', 'episode', 'L0' FROM x
 UNION ALL SELECT 'viking://session/' || s || '/.overview.md', 'long', 'episode', 'L1' FROM x UNION ALL SELECT 'viking://resources/_notes.md', 'n', 'reference', 'L2'""")
def source_openviking(s: SparkSession, d: str, at: Path) -> DataFrame:
    """Message logs with the summaries beside them, whose names begin with a dot."""
    for session, rows in _sessions(s, d):
        place = at / "local/a/session" / _md5(session)
        _write(place / "messages.jsonl", "\n".join(json.dumps({"id": r[0], "role": r[1], "parts": [{"type": "text", "text": r[2] or ""}, {"type": "image"}]}) for r in rows))
        _write(place / ".abstract.md", "short")
        _write(place / ".overview.md", "long")
        _write(place / ".meta.json", "{}")
    _write(at / "local/a/resources/_notes.md", "n")
    return stores.openviking(s, str(at))[0].select("native_id", "content", "kind", F.get_json_object("metadata", "$.layer").alias("layer"))


@query("SELECT sha256(content) AS raw_hash, 'reference' AS kind, count(*) AS n FROM (SELECT DISTINCT path, content FROM tdai_l2_scenario WHERE content <> '') GROUP BY 1 UNION ALL SELECT sha256(content), 'fact', count(*) FROM (SELECT DISTINCT id, content FROM memori_entity_fact WHERE content IS NOT NULL) GROUP BY 1 UNION ALL SELECT sha256('me'), 'preference', 1 UNION ALL SELECT sha256('ref'), 'episode', 1")
def source_tdai(s: SparkSession, d: str, at: Path) -> DataFrame:
    for n, (_, content) in enumerate(_rows(table(s, d, "tdai_l2_scenario").select("path", "content").filter("content <> ''").distinct())):
        p = at / "scenes" / f"{n}.md"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(content.encode())
    facts = table(s, d, "memori_entity_fact").filter("content IS NOT NULL").select("id", "content").distinct()
    _write(at / "facts.jsonl", "\n".join(json.dumps({"content": r[1]}) for r in _rows(facts)))
    _write(at / "persona.md", "me")
    _write(at / "refs/r.md", "ref")
    return stores.tdai(s, str(at))[0].groupBy("raw_hash", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(id AS VARCHAR) AS native_id, content, CASE WHEN id % 2 = 0 THEN 'preference' ELSE 'fact' END AS kind FROM (SELECT DISTINCT id, content FROM memori_entity_fact WHERE content IS NOT NULL) WHERE id % 5 <> 0")
def source_memos(s: SparkSession, d: str, at: Path) -> DataFrame:
    """Every fifth item is archived, which the reader leaves out."""
    facts = table(s, d, "memori_entity_fact").filter("content IS NOT NULL").select("id", "content").distinct()
    items = [{"id": str(i), "memory": c, "metadata": {"memory_type": "UserMemory" if i % 2 == 0 else "LongTermMemory", "status": "archived" if i % 5 == 0 else "Activated"}} for i, c in _rows(facts)]
    _write(at / "c/textual_memory.json", json.dumps({"nodes": items}, ensure_ascii=False))
    return stores.memos(s, str(at))[0].select("native_id", "content", "kind")


@query("SELECT content, count(*) AS n FROM (SELECT 'entity mentioned: ' || entity AS content FROM (SELECT DISTINCT source_path, entry_index, entity FROM memary_stream_entry WHERE entity IS NOT NULL) UNION ALL SELECT 'entity tally: ' || entity || ' (count=' || count(*) || ')' FROM (SELECT DISTINCT source_path, entry_index, entity FROM memary_stream_entry WHERE entity IS NOT NULL) GROUP BY entity UNION ALL SELECT 'me') GROUP BY 1")
def source_memary(s: SparkSession, d: str, at: Path) -> DataFrame:
    seen = table(s, d, "memary_stream_entry").filter("entity IS NOT NULL").select("source_path", "entry_index", "entity").distinct()
    _write(at / "memory_stream.json", json.dumps([{"entity": r[2]} for r in _rows(seen)], ensure_ascii=False))
    _write(at / "entity_knowledge_store.json", json.dumps([{"entity": e, "count": n} for e, n in _rows(seen.groupBy("entity").count())], ensure_ascii=False))
    _write(at / "user_persona.txt", "me\n")
    return stores.memary(s, str(at))[0].groupBy("content").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'mem://' || doc_id AS native_id, coalesce(text, '') AS content, 'unknown' AS kind FROM documents WHERE text IS NOT NULL")
def source_resources(s: SparkSession, d: str, at: Path) -> DataFrame:
    docs = table(s, d, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("mem://"), "doc_id").alias("uri"), "text", F.col("doc_id").alias("fetched_at"))
    docs.unionByName(docs.sparkSession.createDataFrame([("mem://{id}", "template", 0)], docs.schema)).write.json(str(at / "listed"))
    return stores.generic_mcp(s, str(at / "listed"))[0].select("native_id", "content", "kind")


# --- sinks: every record goes out and comes back

_SENT = "SELECT id, adapter, instance, native_id, sha256(content) AS content_hash, kind, scope FROM sent"
_ORIGINS = "WITH sent AS (SELECT DISTINCT sha256('mem0:main:' || uuid) AS id, 'mem0' AS adapter, 'main' AS instance, uuid AS native_id, content, 'fact' AS kind, 'user' AS scope FROM memori_entity_fact WHERE content IS NOT NULL AND content <> '') "


def _sent(s: SparkSession, d: str, at: Path) -> DataFrame:
    facts = table(s, d, "memori_entity_fact").filter("content <> ''").select("uuid", "content").distinct()
    db = _sqlite(at / "sent.db", "CREATE TABLE memories (id TEXT, memory TEXT, metadata TEXT, created_at TEXT)", "INSERT INTO memories VALUES (?,?,'{\"categories\":[\"a\",\"b\"],\"own\":7}','1700000000')", _rows(facts))
    return stores.mem0(s, db, "main")[0]


def _round_trip(form: str, reader: Callable) -> Callable:
    def f(s: SparkSession, d: str, at: Path) -> DataFrame:
        records = _sent(s, d, at)
        export.export(records, form, str(at / "out"))
        back, _ = reader(s, str(at / "out"))
        same = (F.get_json_object("metadata", "$.own") == "7") & (F.array_join("tags", ",") == "a,b")
        return back.filter(same).select("id", "adapter", "instance", "native_id", F.sha2("content", 256).alias("content_hash"), "kind", "scope")

    return f


for _form, _reader in (("mem0-sqlite", stores.mem0), ("letta-sqlite", stores.letta), ("memos-dir", stores.memos), ("tdai-dir", stores.tdai), ("memory-dir", stores.claude_code)):
    _f = _round_trip(_form, _reader)
    _f.__name__ = f"sink_{_form.replace('-', '_')}"
    # Memory files are trimmed when they are read.
    query(_ORIGINS + (_SENT.replace("sha256(content)", "sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g'))") if _form == "memory-dir" else _SENT))(_f)


@query(_ORIGINS + "SELECT 'entity_fact|' || native_id AS native_id, content, 'mem0' AS owner FROM sent")
def sink_memori_sqlite(s: SparkSession, d: str, at: Path) -> DataFrame:
    export.export(_sent(s, d, at), "memori-sqlite", str(at / "out"))
    return stores.memori(s, str(at / "out"))[0].select("native_id", "content", F.get_json_object("metadata", "$.owner").alias("owner"))


@query(_ORIGINS + "SELECT id, content, kind FROM sent")
def sink_jsonl(s: SparkSession, d: str, at: Path) -> DataFrame:
    export.export(export.select(_sent(s, d, at), "mem0", "main", "fact"), "jsonl", str(at / "out"))
    return s.read.json(str(at / "out")).select("id", "content", "kind")


@query(_ORIGINS + "SELECT id, content, native_id FROM sent")
def sink_csv(s: SparkSession, d: str, at: Path) -> DataFrame:
    export.export(_sent(s, d, at), "csv", str(at / "out"))
    return s.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(at / "out")).select("id", "content", "native_id")


@query("SELECT record_id, adapter, CAST(forgotten_at AS VARCHAR) AS forgotten_at FROM tombstones")
def sink_report_csv(s: SparkSession, d: str, at: Path) -> DataFrame:
    export.report_csv(model.tombstones(s, d).select("record_id", "adapter", "forgotten_at", "reason"), str(at / "out"))
    read = s.read.option("header", "true").csv(str(at / "out"))
    return read.select(*read.columns)


# --- small files


@query("SELECT event_id AS line_no, event_type AS action FROM events WHERE event_id % 10 <> 3")
def source_audit_log(s: SparkSession, d: str, at: Path) -> DataFrame:
    """A log with every tenth line broken; lines keep their numbers."""
    events = table(s, d, "events").select("event_id", "event_type").orderBy("event_id")
    with (at / "audit.log").open("w") as f:
        for n, action in _rows(events):
            f.write("broken\n" if n % 10 == 3 else json.dumps({"timestamp": None, "action": action, "detail": {}}) + "\n")
    return files.audit_log(s, str(at / "audit.log")).select(F.col("line_no").cast("long").alias("line_no"), "action")


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS query, 2 AS grade FROM (SELECT DISTINCT item_id, text FROM eval_item)")
def source_judgments(s: SparkSession, d: str, at: Path) -> DataFrame:
    lines = [json.dumps({"id": str(i), "query": t, "relevant": [{"record_id": f"r{i}", "grade": 2}]}) for i, t in _rows(table(s, d, "eval_item").select("item_id", "text").distinct())]
    _write(at / "j.jsonl", "# judged\n\n" + "\n".join(lines) + "\n")
    return files.judgments(s, str(at / "j.jsonl")).select("id", "query", F.get("relevant", 0)["grade"].alias("grade"))


@query("SELECT * FROM (VALUES ('mem0', 'low'), ('openviking', 'high'), ('memos', 'medium')) AS t(adapter, confidence)")
def source_detectors(s: SparkSession, d: str, at: Path) -> DataFrame:
    for folder in (".mem0", ".openviking/data", ".memos", ".other"):
        (at / folder).mkdir(parents=True)
    return files.detect(s, str(at)).select("adapter", "confidence")


@query("SELECT * FROM (VALUES ('search.limit', '3'), ('search.mode', 'hybrid'), ('chunk.max_tokens', '512'), ('own.x', 'y')) AS t(setting, value)")
def source_settings(s: SparkSession, d: str, at: Path) -> DataFrame:
    _write(at / "c.toml", '[search]\nlimit = 3\n[own]\nx = "y"\n')
    got = files.config(str(at / "c.toml"))
    return s.createDataFrame([(f"{a}.{b}", str(got[a][b])) for a, b in (("search", "limit"), ("search", "mode"), ("chunk", "max_tokens"), ("own", "x"))], "setting string, value string")


# --- the watch loop

_EVENTS = "e AS (SELECT DISTINCT event_id, event_type AS source, ts FROM events)"


@query(f"WITH {_EVENTS}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 SECOND THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)), bursts AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY ts, event_id) AS burst FROM marked) "
       "SELECT source, epoch_us(max(ts)) + 2000000 AS settled_us, count(*) AS changes FROM bursts GROUP BY source, burst")  # fmt: skip
def watch_debounce(s: SparkSession, d: str, at: Path) -> DataFrame:
    events = table(s, d, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts")).distinct()
    return watch.debounce(events).select("source", F.unix_micros("settled_at").alias("settled_us"), "changes")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' WHEN source IS NOT NULL THEN 'all' END AS owner FROM documents WHERE source IS NOT NULL")
def watch_route(s: SparkSession, d: str, at: Path) -> DataFrame:
    paths = table(s, d, "documents").filter("source IS NOT NULL").select("doc_id", F.concat(F.lit("/r/"), F.when(F.col("doc_id") % 2 == 0, "even/").otherwise("odd/"), F.col("doc_id").cast("string"), F.lit("/f.md")).alias("path"))
    roots = s.createDataFrame([("/r", "all"), ("/r/even", "even"), ("/r/ev", "none")], "root string, source string")
    return paths.join(watch.route(paths, roots), "path").select("doc_id", F.col("source").alias("owner"))


def _stream(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path if Path(path).is_dir() else f"{d}/events.parquet*")


@query("SELECT DISTINCT user_id, event_type FROM events")
def watch_catch_up(s: SparkSession, d: str, at: Path) -> DataFrame:
    """What is there when the watch starts, as a stream that stops at its end; repeats within the overlap are absorbed, later ones by the idempotent write."""
    fresh = watch.without_repeats(_stream(s, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"])
    run = watch.follow(fresh, lambda df, n: df.write.mode("overwrite").parquet(str(at / f"out/batch={n}")), str(at / "cp"), catch_up=True)
    run.awaitTermination(600)
    return s.read.parquet(str(at / "out")).select("user_id", "event_type").distinct()


@query("SELECT event_type AS source, epoch_us(max(ts)) AS last_us, count(*) AS seen FROM events GROUP BY 1")
def watch_last_import(s: SparkSession, d: str, at: Path) -> DataFrame:
    """The last time and number of rows of each source, kept from batch to batch of a stream in a table of its own."""
    rows = _stream(s, d).select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    run = watch.follow(rows, lambda df, n: watch.remember(df, n, str(at / "state")), str(at / "cp"), catch_up=True)
    run.awaitTermination(600)
    return watch.remembered(s, str(at / "state")).select("source", F.unix_micros("last").alias("last_us"), "seen")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def watch_windows(s: SparkSession, d: str, at: Path) -> DataFrame:
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return watch.windowed_counts(events, "ts", "1 hour", None, "event_type").select(F.unix_micros("start").alias("start_us"), "event_type", "n")
