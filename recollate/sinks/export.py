"""Records to files and databases of other stores. Nothing existing is ever overwritten."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from recollate.sources.stores import ORIGIN

# Which format gives a store its own shape back.
ROUND_TRIP = {"mem0": "mem0-sqlite", "letta": "letta-sqlite", "memori": "memori-sqlite", "memos": "memos-dir", "tdai": "tdai-dir", "claude-code": "memory-dir"}
CSV_COLUMNS = ["id", "adapter", "instance", "kind", "scope", "created_at", "native_id", "native_path", "content"]


def select(records: DataFrame, adapter: str | None = None, instance: str | None = None, kind: str | None = None) -> DataFrame:
    from recollate.operators.selection import csv_filter

    df = csv_filter(records, adapter, instance)
    return (df.filter(F.col("kind") == kind) if kind else df).orderBy("created_at", "id")


def _fresh(path: str) -> Path:
    out = Path(path)
    if out.exists():
        raise FileExistsError(f"{path} exists")
    return out


def origin_block(records: DataFrame) -> Column:
    """A record's own metadata and its origin as one JSON object, to be kept in the metadata of another store; the origin's keys win."""
    names = {"source_adapter": "adapter", "source_instance": "instance", "kind": "kind", "scope": "scope", "tags": "tags", "native_id": "native_id", "raw_hash": "raw_hash", "derived_from": "derived_from"}
    block = F.try_variant_get(F.parse_json(F.to_json(F.struct(*[F.col(c).alias(f"{ORIGIN}{n}") for n, c in names.items() if c in records.columns]))), "$", "map<string,variant>")
    own = F.try_variant_get(F.try_parse_json("metadata"), "$", "map<string,variant>") if "metadata" in records.columns else F.lit(None).cast("map<string,variant>")
    kept = F.map_filter(own, lambda k, _: ~k.startswith(ORIGIN))
    return F.to_json(F.coalesce(F.map_concat(kept, block), block))


def jsonl(records: DataFrame, path: str) -> None:
    """One JSON object per line, written by all tasks; fails if the path exists."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("errorifexists").text(path)


def csv(records: DataFrame, path: str) -> None:
    records.select(*CSV_COLUMNS).write.mode("errorifexists").option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def _rfc3339(seconds: int | None) -> str | None:
    return None if seconds is None else datetime.fromtimestamp(seconds, UTC).isoformat()


def _database(records: DataFrame, path: str, tables: str, insert: Callable[[sqlite3.Cursor, Iterator[Row]], None]) -> None:
    """One SQLite file can only be written in one place: rows stream through the driver partition by partition, never all at once."""
    out = _fresh(path)
    rows = records.withColumn("origin", origin_block(records)).orderBy("created_at", "id").toLocalIterator(prefetchPartitions=True)
    with sqlite3.connect(out) as c:
        c.executescript(tables)
        insert(c.cursor(), rows)


def mem0_sqlite(records: DataFrame, path: str) -> None:
    table = "CREATE TABLE memories (id TEXT PRIMARY KEY, memory TEXT NOT NULL, user_id TEXT, agent_id TEXT, run_id TEXT, metadata TEXT, created_at TEXT, updated_at TEXT, hash TEXT)"
    _database(records, path, table, lambda c, rows: c.executemany("INSERT INTO memories VALUES (?, ?, NULL, NULL, NULL, ?, ?, ?, ?)", ((r["id"], r["content"], r["origin"], _rfc3339(r["created_at"]), _rfc3339(r["updated_at"]), r["raw_hash"]) for r in rows)))


def letta_sqlite(records: DataFrame, path: str) -> None:
    table = "CREATE TABLE block (id TEXT PRIMARY KEY, value TEXT NOT NULL, label TEXT, description TEXT, metadata_ TEXT, created_at TEXT, updated_at TEXT)"

    def label(r: Row) -> str:
        try:
            own = json.loads(r["metadata"]).get("label")
        except (ValueError, AttributeError, TypeError):
            own = None
        return own or f"imported/{r['adapter']}"

    _database(records, path, table, lambda c, rows: c.executemany("INSERT INTO block VALUES (?, ?, ?, NULL, ?, ?, ?)", ((r["id"], r["content"], label(r), r["origin"], _rfc3339(r["created_at"]), _rfc3339(r["updated_at"])) for r in rows)))


def memori_sqlite(records: DataFrame, path: str) -> None:
    tables = (
        "CREATE TABLE memori_entity (id INTEGER PRIMARY KEY, uuid TEXT, external_id TEXT);"
        "CREATE TABLE memori_entity_fact (id INTEGER PRIMARY KEY, uuid TEXT, entity_id INTEGER, content TEXT, num_times INTEGER, date_last_time TEXT, date_created TEXT);"
    )

    def insert(c: sqlite3.Cursor, rows: Iterator[Row]) -> None:
        owners: dict[str, int] = {}
        for n, r in enumerate(rows, 1):
            if r["adapter"] not in owners:
                owners[r["adapter"]] = len(owners) + 1
                c.execute("INSERT INTO memori_entity VALUES (?, ?, ?)", (owners[r["adapter"]], r["adapter"], r["adapter"]))
            at = datetime.fromtimestamp(r["created_at"] or 0, UTC).strftime("%Y-%m-%d %H:%M:%S")
            c.execute("INSERT INTO memori_entity_fact VALUES (?, ?, ?, ?, 1, ?, ?)", (n, r["native_id"], owners[r["adapter"]], r["content"], at, at))

    _database(records, path, tables, insert)


def memos_dir(records: DataFrame, path: str) -> None:
    """textual_memory.json, one array, streamed."""
    out = _fresh(path)
    out.mkdir(parents=True)
    by_kind = {"preference": "PreferenceMemory", "skill": "SkillMemory", "episode": "ToolTrajectoryMemory"}
    rows = records.withColumn("origin", origin_block(records)).orderBy("created_at", "id").toLocalIterator(prefetchPartitions=True)
    with (out / "textual_memory.json").open("w") as f:
        f.write("[")
        for n, r in enumerate(rows):
            kind = ("WorkingMemory" if r["scope"] == "ephemeral" else "OuterMemory") if r["kind"] == "reference" else by_kind.get(r["kind"], "LongTermMemory")
            meta = json.loads(r["origin"]) | {"status": "activated", "memory_type": kind, "tags": list(r["tags"] or []), "created_at": _rfc3339(r["created_at"])}
            f.write((",\n" if n else "\n") + json.dumps({"id": r["id"], "memory": r["content"], "metadata": meta}, ensure_ascii=False))
        f.write("\n]\n")


def tdai_dir(records: DataFrame, path: str) -> None:
    """Fact lines with their origin, written by all tasks."""
    folder = str(_fresh(path))

    def write(rows: Iterator[Row]) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        part = Path(folder, f"facts-{TaskContext.get().partitionId():05}.jsonl")
        draft = part.with_suffix(f".{TaskContext.get().taskAttemptId()}")
        with draft.open("w") as f:
            f.writelines(r[0] + "\n" for r in rows)
        draft.rename(part)  # a task that is run again replaces its own file only

    records.select(F.to_json(F.struct("content", "created_at", "updated_at", F.parse_json(origin_block(records)).alias("origin")))).foreachPartition(write)


def memory_dir(records: DataFrame, path: str, project: str = "exported") -> None:
    """One Markdown file with front matter per record, written by the tasks into a folder that all executors share."""
    folder = str(_fresh(path) / project / "memory")
    types = {"feedback": "feedback", "preference": "preference", "reference": "reference", "skill": "skill", "fact": "user"}

    def write(rows: Iterator[Row]) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            tags = list(r["tags"] or [])
            name = re.sub(r"[\r\n]", " ", tags[0]) if tags else r["id"]
            stem = re.sub(r"[^a-z0-9]", "-", name.lower()).strip("-")[:80] or "memory"
            about = re.sub(r"[\r\n]", " ", tags[1]) if len(tags) > 1 else ""
            text = f"---\nname: {name}\ndescription: {about}\nmetadata:\n  type: {types.get(r['kind'], 'project')}\norigin: {r['origin']}\n---\n\n{r['content']}\n"
            Path(folder, f"{stem}-{r['id'][:32]}.md").write_text(text)

    records.select("id", "kind", "tags", "content", origin_block(records).alias("origin")).foreachPartition(write)


FORMATS: dict[str, Callable[[DataFrame, str], None]] = {"jsonl": jsonl, "csv": csv, "mem0-sqlite": mem0_sqlite, "letta-sqlite": letta_sqlite, "memori-sqlite": memori_sqlite, "memos-dir": memos_dir, "tdai-dir": tdai_dir, "memory-dir": memory_dir}


def export(records: DataFrame, form: str, path: str | None) -> None:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    if not path:
        raise ValueError("a path is needed")
    FORMATS[form](records, path)


def report_csv(report: DataFrame, path: str, sensitive: tuple[str, ...] = ("raw_hash", "native_path", "reason", "content")) -> None:
    """A listing (forgotten records, duplicate groups, audit lines) as CSV without its sensitive columns; arrays are joined by semicolons."""
    flat = [F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in report.schema if f.name not in sensitive]
    report.select(*flat).write.mode("errorifexists").option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def append_audit(path: str, action: str, detail: dict, at: int) -> None:
    """One line at the end of a JSON-lines log."""
    with Path(path).open("a") as f:
        f.write(json.dumps({"timestamp": _rfc3339(at), "action": action, "detail": detail}, ensure_ascii=False) + "\n")
