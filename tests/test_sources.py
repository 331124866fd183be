import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from recollate.sinks import export
from recollate.sources import files, sqlite, stores


def db(path, *statements):
    with sqlite3.connect(path) as c:
        for s, *rows in statements:
            c.executemany(s, rows[0]) if rows else c.execute(s)
    return str(path)


def write(root, tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def by_id(read):
    records, errors = read
    assert records.columns == stores.RECORD
    return {r["native_id"]: r for r in records.collect()}, errors.collect()


def test_claude_code_and_codex(spark, tmp_path):
    log = "\n".join(json.dumps(x) for x in [
        {"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "2026-05-17T03:14:00Z"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": " yes "}, {"type": "tool_use", "name": "ls"}, {"type": "tool_result", "content": "r" * 500}, {"type": "thinking", "text": "no"}]}, "timestamp": "2026-05-17T03:15:00Z"},
        {"type": "summary", "x": 1},
    ])
    root = write(tmp_path / "c", {"p/memory/a.md": "---\nname: A\ndescription: about\nmetadata:\n  type: feedback\n---\n\nbody\n", "p/memory/MEMORY.md": "index", "p/s.jsonl": log, "p/readme.md": "x"})
    got, errors = by_id(stores.claude_code(spark, root, "main"))
    assert set(got) == {"memory|p/memory/a.md", "session|p/s.jsonl"} and not errors
    m = got["memory|p/memory/a.md"]
    assert (m["kind"], m["scope"], m["content"], m["tags"], m["instance"]) == ("feedback", "user", "body", ["A", "about"], "main")
    s = got["session|p/s.jsonl"]["content"]
    assert s.startswith("**user** — 2026-05-17T03:14Z\n\nhi\n\n**assistant**") and "[tool_use: ls]" in s and "[tool_result(500 chars): " + "r" * 400 + "…]" in s and "no" not in s.replace("[", "")
    items = "\n".join(json.dumps(x) for x in [{"timestamp": "2026-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}}, {"type": "event", "payload": {}}])
    got, _ = by_id(stores.codex(spark, write(tmp_path / "x", {"a/r.jsonl": items})))
    assert got["session|a/r.jsonl"]["content"] == "**user** — 2026-01-01T00:00Z\n\nq\n\n"


def test_sqlite_stores(spark, tmp_path):
    path = db(tmp_path / "m.db", ("CREATE TABLE memories (id TEXT, memory TEXT, user_id TEXT, metadata TEXT, created_at TEXT)",), ("INSERT INTO memories VALUES (?,?,?,?,?)", [("1", "x", "u", '{"categories":["c"],"user_id":"own"}', "1700000000"), ("2", None, None, "bad", None)]))
    got, errors = by_id(stores.mem0(spark, path))
    assert got["1"]["created_at"] == 1700000000 and got["1"]["tags"] == ["c"] and json.loads(got["1"]["metadata"])["user_id"] == "own"
    assert [e["error"] for e in errors] == ["no content"]
    assert by_id(stores.mem0(spark, path, since=1700000000))[0] == {}
    path = db(tmp_path / "l.db", ("CREATE TABLE block (id TEXT, value TEXT, label TEXT, metadata_ TEXT, created_at TEXT)",), ("INSERT INTO block VALUES ('b', 'v', 'human', '{}', '2024-01-01T00:00:00Z')",))
    assert by_id(stores.letta(spark, path))[0]["b"]["tags"] == ["human"]
    ddl = [
        "CREATE TABLE memori_entity (id INTEGER, uuid TEXT, external_id TEXT)", "CREATE TABLE memori_entity_fact (id INTEGER, uuid TEXT, entity_id INTEGER, content TEXT, num_times INTEGER, date_last_time TEXT, date_created TEXT)",
        "CREATE TABLE memori_subject (id INTEGER, uuid TEXT, name TEXT)", "CREATE TABLE memori_predicate (id INTEGER, uuid TEXT, content TEXT)", "CREATE TABLE memori_object (id INTEGER, uuid TEXT, name TEXT)",
        "CREATE TABLE memori_knowledge_graph (id INTEGER, uuid TEXT, subject_id INTEGER, predicate_id INTEGER, object_id INTEGER, date_last_time TEXT, date_created TEXT)",
        "INSERT INTO memori_entity VALUES (1,'e','ext')", "INSERT INTO memori_entity_fact VALUES (1,'f',1,'fact',2,NULL,'2024-01-01 00:00:00')", "INSERT INTO memori_entity_fact VALUES (2,'g',99,'orphan',2,'2024-01-02 00:00:00','2024-01-01 00:00:00')",
        "INSERT INTO memori_subject VALUES (1,'s','ann')", "INSERT INTO memori_predicate VALUES (1,'p','likes')", "INSERT INTO memori_object VALUES (1,'o','tea')", "INSERT INTO memori_knowledge_graph VALUES (1,'k',1,1,1,NULL,'2024-01-01 00:00:00')",
    ]
    got, _ = by_id(stores.memori(spark, db(tmp_path / "r.db", *[(s,) for s in ddl])))
    assert got["triple|k"]["content"] == "ann | likes | tea" and set(got) == {"entity_fact|f", "entity_fact|g", "triple|k"}
    assert got["entity_fact|g"]["created_at"] == 1704153600


def test_hidden_files_are_read(spark, tmp_path):
    root = write(tmp_path / "t", {"x.md": "1", "_under.md": "2", ".dot.md": "3", "sub/.a/b.md": "4", "_d/c.md": "5", "y.txt": "6", ".z.txt": "7"})
    assert sorted((r["rel"], r["name"], r["content"]) for r in files.text_files(spark, root, "*.md").collect()) == [(".dot.md", ".dot.md", "3"), ("_d/c.md", "c.md", "5"), ("_under.md", "_under.md", "2"), ("sub/.a/b.md", "b.md", "4"), ("x.md", "x.md", "1")]
    assert files.text_files(spark, root, "*.md", since=4_000_000_000).count() == 0


def test_pretty_printed_sessions(spark, tmp_path):
    item = {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": " q\n"}]}}
    got, _ = by_id(stores.codex(spark, write(tmp_path / "x", {"a.json": json.dumps([item, item], indent=2), "b.json": json.dumps({"items": [item]}, indent=1), "c.json": "{torn"})))
    assert {k: json.loads(r["metadata"])["message_count"] for k, r in got.items()} == {"session|a.json": 2, "session|b.json": 1, "session|c.json": 0}


def test_metadata_survives_an_export(spark, tmp_path):
    source = db(tmp_path / "m.db", ("CREATE TABLE memories (id TEXT, memory TEXT, metadata TEXT)",), ("INSERT INTO memories VALUES ('1', 'x', ?)", [('{"own":{"k":[1]},"categories":["c"]}',)]))
    records = stores.mem0(spark, source, "i")[0].withColumn("derived_from", F.lit("parent"))
    export.export(records, "mem0-sqlite", str(tmp_path / "out"))
    r = stores.mem0(spark, str(tmp_path / "out"))[0].first()
    assert json.loads(r["metadata"]) == {"own": {"k": [1]}, "categories": ["c"]} and r["derived_from"] == "parent" and r["tags"] == ["c"]
    with sqlite3.connect(tmp_path / "out") as c:
        assert {"own", "origin_source_adapter", "origin_derived_from"} < set(json.loads(c.execute("SELECT metadata FROM memories").fetchone()[0]))
    export.report_csv(records.select("id", "tags", "raw_hash"), str(tmp_path / "report"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "report")).columns == ["id", "tags"]


def test_sqlite_splits_read_every_row_once(spark, tmp_path):
    path = db(tmp_path / "n.db", ("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT, x REAL, b BLOB)",), ("INSERT INTO t VALUES (?,?,?,?)", [(i, f"v{i}", i / 2, b"z") for i in range(1, 252)]))
    spark.dataSource.register(sqlite.SqliteSource)
    df = spark.read.format("sqlite_rows").option("path", path).option("table", "t").option("rows_per_split", "50").load()
    assert df.rdd.getNumPartitions() == 6 and sorted(r["id"] for r in df.collect()) == list(range(1, 252))
    assert sqlite.read_table(spark, path, "missing") is None


def test_file_stores(spark, tmp_path):
    got, _ = by_id(stores.memos(spark, write(tmp_path / "o", {"c/textual_memory.json": json.dumps({"nodes": [{"id": "1", "memory": "a", "metadata": {"memory_type": "UserMemory", "status": "Activated"}}, {"id": "2", "memory": "b", "metadata": {"status": "archived"}}]})})))
    assert list(got) == ["1"] and got["1"]["kind"] == "preference"
    got, _ = by_id(stores.memary(spark, write(tmp_path / "y", {"memory_stream.json": '[{"entity":"E","date":"2024-01-01T00:00:00"}]', "entity_knowledge_store.json": '[{"entity":"E","count":3,"date":"2024-01-01"}]', "past_chat.json": '{"messages":[{"role":"user","content":"q"}]}', "user_persona.txt": "me"})))
    assert {r["content"] for r in got.values()} == {"entity mentioned: E", "entity tally: E (count=3)", "user: q", "me"}
    got, _ = by_id(stores.openclaw(spark, write(tmp_path / "w", {"openclaw.json": "{}", "workspace/AGENTS.md": "a", "workspace/skills/s/SKILL.md": "k", "workspace/sessions/1.jsonl": "l", "other.txt": "x"})))
    assert {r["kind"] for r in got.values()} == {"reference", "skill", "episode"} and len(got) == 4
    tree = {"local/a/resources/r/x.md": "r", "local/a/user/u/memories/profile.md": "p", "local/a/agent/g/skills/s.md": "k", "local/a/session/s1/.abstract.md": "sum", "local/a/session/s1/.overview.md": "over", "local/a/resources/_r.md": "u", "local/a/session/s1/messages.jsonl": '{"id":"m1","role":"user","parts":[{"type":"text","text":"hey"}]}\nbroken\n', "local/a/session/s1/.meta.json": "{}"}
    got, errors = by_id(stores.openviking(spark, write(tmp_path / "v", tree)))
    layers = {k: json.loads(r["metadata"]).get("layer") for k, r in got.items() if k.startswith("viking")}
    assert layers == {"viking://resources/r/x.md": "L2", "viking://resources/_r.md": "L2", "viking://user/u/memories/profile.md": "L2", "viking://agent/g/skills/s.md": "L2", "viking://session/s1/.abstract.md": "L0", "viking://session/s1/.overview.md": "L1"}
    assert got["viking://session/s1/.abstract.md"]["content"] == "sum" and got["viking://session/s1/.abstract.md"]["scope"] == "session"
    assert got["message|s1|m1"]["content"] == "hey" and len(errors) == 1 and {r["kind"] for r in got.values()} == {"reference", "preference", "skill", "episode"}
    got, _ = by_id(stores.tdai(spark, write(tmp_path / "t", {"persona.md": "P", "refs/r.md": "R", "f.jsonl": '{"content":"F"}\nraw\n', "s.md": "S"})))
    assert {(r["content"], r["kind"]) for r in got.values()} == {("P", "preference"), ("R", "episode"), ("F", "fact"), ("raw", "fact"), ("S", "reference")}
    hermes = tmp_path / "h"
    write(hermes, {"MEMORY.md": "mem", "USER.md": "usr", "other.md": "no"})
    db(hermes / "state.db", ("CREATE TABLE messages (id TEXT, role TEXT, content TEXT, created_at TEXT)",), ("INSERT INTO messages VALUES ('1','user','c','2024-01-01T00:00:00Z')",), ("CREATE TABLE bare (id TEXT)",))
    got, _ = by_id(stores.hermes(spark, str(hermes)))
    assert set(got) == {"md|MEMORY.md", "md|USER.md", "session|messages|1"}
    palace = tmp_path / "pal"
    write(palace, {"identity.txt": "I am"})
    db(palace / "chroma.sqlite3", ("CREATE TABLE collections (id TEXT, name TEXT)",), ("INSERT INTO collections VALUES ('c','mempalace_drawers')",), ("CREATE TABLE segments (id TEXT, collection TEXT)",), ("INSERT INTO segments VALUES ('s','c')",),
       ("CREATE TABLE embeddings (id INTEGER, segment_id TEXT, embedding_id TEXT)",), ("INSERT INTO embeddings VALUES (1,'s','e1')",), ("CREATE TABLE embedding_metadata (id INTEGER, key TEXT, string_value TEXT, int_value INTEGER, float_value REAL, bool_value INTEGER)",),
       ("INSERT INTO embedding_metadata VALUES (1,'chroma:document','doc',NULL,NULL,NULL)",), ("INSERT INTO embedding_metadata VALUES (1,'created_unix',NULL,1700000000,NULL,NULL)",))
    got, _ = by_id(stores.mempalace(spark, str(palace)))
    assert got["mempalace_drawers|e1"]["content"] == "doc" and got["mempalace_drawers|e1"]["created_at"] == 1700000000
    listed = spark.createDataFrame([("mem://1", "t", 5), ("mem://{id}", "x", 5)], "uri string, text string, fetched_at long")
    assert set(by_id(stores.resources(listed))[0]) == {"mem://1"}


def test_small_files(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('# c\n\n{"id":"q","query":"x","relevant":[{"record_id":"r","grade":2}]}\n')
    assert [r["id"] for r in files.judgments(spark, str(path)).collect()] == ["q"]
    log = tmp_path / "audit.log"
    export.append_audit(str(log), "import", {"n": 1}, 0)
    log.open("a").write("broken\n")
    export.append_audit(str(log), "forget", {}, 60)
    assert [(r["line_no"], r["action"]) for r in files.audit_log(spark, str(log)).orderBy("line_no").collect()] == [(0, "import"), (2, "forget")]
    (tmp_path / "c.toml").write_text("[search]\nlimit = 3\n")
    assert files.config(str(tmp_path / "c.toml"))["search"] == {"limit": 3, "mode": "hybrid"} and files.config(None) == files.DEFAULTS
    (tmp_path / ".mem0").mkdir()
    assert [(r["adapter"], r["confidence"]) for r in files.detect(spark, str(tmp_path)).collect()] == [("mem0", "low")]
    assert files.text_files(spark, str(tmp_path), "*.nope").count() == 0


def test_exports_round_trip(spark, tmp_path):
    source = db(tmp_path / "m.db", ("CREATE TABLE memories (id TEXT, memory TEXT, created_at TEXT)",), ("INSERT INTO memories VALUES (?,?,?)", [("1", 'a,"b"\nc', "1700000000"), ("2", "zwei", "1700000100")]))
    records, _ = stores.mem0(spark, source)
    texts = {'a,"b"\nc', "zwei"}
    for form, back in (("mem0-sqlite", stores.mem0), ("letta-sqlite", stores.letta), ("memori-sqlite", stores.memori)):
        export.export(records, form, str(tmp_path / form))
        assert {r["content"] for r in back(spark, str(tmp_path / form))[0].collect()} == texts
        with pytest.raises(FileExistsError):
            export.export(records, form, str(tmp_path / form))
    export.export(records, "memos-dir", str(tmp_path / "cube"))
    assert {r["content"] for r in stores.memos(spark, str(tmp_path / "cube"))[0].collect()} == texts
    export.export(records, "memory-dir", str(tmp_path / "md"))
    assert {r["content"] for r in stores.claude_code(spark, str(tmp_path / "md"))[0].collect()} == texts
    export.export(records, "jsonl", str(tmp_path / "out.jsonl"))
    assert spark.read.json(str(tmp_path / "out.jsonl")).count() == 2
    export.export(records, "csv", str(tmp_path / "out.csv"))
    assert {r["content"] for r in spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "out.csv")).collect()} == texts
    export.export(records, "tdai-dir", str(tmp_path / "facts"))
    assert len(list((tmp_path / "facts").glob("*.jsonl"))) >= 1
    columns = ["id", "adapter", "instance", "native_id", "content", "kind", "scope", "tags", "raw_hash"]
    want = sorted(map(tuple, records.select(*columns).collect()))
    for form, back in (("mem0-sqlite", stores.mem0), ("letta-sqlite", stores.letta), ("tdai-dir", stores.tdai), ("memos-dir", stores.memos), ("memory-dir", stores.claude_code)):
        again, _ = back(spark, str(tmp_path / {"tdai-dir": "facts", "memos-dir": "cube", "memory-dir": "md"}.get(form, form)), "elsewhere")
        assert sorted(map(tuple, again.select(*columns).collect())) == want, form
        assert {r["metadata"] for r in again.select("metadata").collect()} == {"{}"}
    with pytest.raises(ValueError):
        export.export(records, "nope", "x")
