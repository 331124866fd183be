"""Text files of a store as rows, and the small files beside them."""

from __future__ import annotations

import fnmatch
import os
import tomllib
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, rel string, name string, content string, mtime long"


def text_files(spark: SparkSession, root: str, glob: str = "*", since: int | None = None) -> DataFrame:
    """path, rel (below root), name, content, mtime (Unix seconds) of all files below root whose name fits glob; none gives an empty table.

    since: only files changed after that time, filtered at the listing. The file reader passes over names that begin with a dot or an
    underscore, so files with such a name anywhere below root are listed here and opened by the tasks; the folder must be visible to them.
    """
    base = str(Path(root).resolve())
    plain, hidden = False, []
    for folder, _, names in os.walk(base):
        for name in fnmatch.filter(names, glob):
            path = os.path.join(folder, name)
            if not any(part[0] in "._" for part in path[len(base) + 1 :].split(os.sep)):
                plain = True
            elif since is None or os.stat(path).st_mtime > since:
                hidden.append((path,))
    parts = []
    if plain:
        reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        if since is not None:
            reader = reader.option("timeZone", "UTC").option("modifiedAfter", f"{_iso(since)}")
        df = reader.text(f"file://{base}", wholetext=True).select(F.col("value").alias("content"), "_metadata.file_path", "_metadata.file_modification_time")
        path = F.url_decode(F.regexp_replace(F.col("file_path"), r"^file:/+", "/"))
        parts.append(df.select(path.alias("path"), "content", F.unix_seconds("file_modification_time").alias("mtime")))
    if hidden:
        paths = spark.createDataFrame(sorted(hidden), "path string")
        parts.append(paths.repartition(min(len(hidden), spark.sparkContext.defaultParallelism), "path").mapInArrow(_open, "path string, content string, mtime long"))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    named = reduce(DataFrame.unionByName, parts)
    return named.select("path", F.substr("path", F.lit(len(base) + 2)).alias("rel"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content", "mtime")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():  # one file at a time, they may be large
            text = Path(path).read_bytes().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string()), pa.array([int(os.stat(path).st_mtime)], pa.int64())], names=["path", "content", "mtime"])


def _iso(seconds: int) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S")


def lines(df: DataFrame) -> DataFrame:
    """path, rel, line_no (from 0), line, mtime of every line that isn't blank."""
    each = df.select("path", "rel", "mtime", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))
    return each.filter(F.trim("line") != "")


def front_matter(content: Column, key: str) -> Column:
    """The scalar of a key in the front matter between --- lines, indented or not; null without it."""
    head = F.regexp_extract(content, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    value = F.trim(F.regexp_extract(head, rf"(?m)^[ \t]*{key}:[ \t]*(.*)$", 1))
    bare = F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")
    return F.when(bare != "", bare)


def body(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""), r"\A\s+|\s+\z", "")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """id, query, relevant of a JSON-lines file; blank and # lines are skipped, lines that don't parse have a null id."""
    schema = "id string, query string, source string, instance string, kind string, scope string, relevant array<struct<record_id: string, adapter: string, instance: string, native_id: string, grade: int>>"
    raw = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return raw.select(F.from_json("value", schema).alias("j")).select("j.*")


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no, timestamp, action, detail of a JSON-lines log; broken lines are skipped, their numbers are not reused."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    parsed = each.select("line_no", F.try_parse_json("line").alias("v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return parsed.filter(F.col("v").isNotNull() & get("action").isNotNull()).select("line_no", get("timestamp").alias("timestamp"), get("action").alias("action"), F.to_json(F.try_variant_get("v", "$.detail", "variant")).alias("detail"))


# Settings and their defaults.
DEFAULTS = {"search": {"limit": 10, "mode": "hybrid"}, "chunk": {"max_tokens": 512, "min_tokens": 32}, "context": {"max_records": 20, "max_tokens": 4000, "per_source": 5, "per_project": 3}}


def config(path: str | None) -> dict:
    """Settings of a TOML file over the defaults; a missing file gives the defaults."""
    given = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    return {k: v | given.get(k, {}) for k, v in DEFAULTS.items()} | {k: v for k, v in given.items() if k not in DEFAULTS}


# Where a store is found below a home directory, and how sure that makes us.
PROBES = {
    "claude-code": ((".claude/projects", "high"),), "codex": ((".codex/sessions", "high"), (".codex", "medium")), "hermes": ((".hermes/MEMORY.md", "high"), (".hermes", "medium")),
    "openclaw": ((".openclaw/openclaw.json", "high"), (".openclaw", "medium")), "mem0": ((".mem0/memories.db", "high"), (".mem0", "low")), "letta": ((".letta/letta.db", "high"), (".letta", "low")),
    "memori": ((".memori/memori.db", "high"), (".memori", "low")), "memos": ((".memos/textual_memory.json", "high"), (".memos", "medium")), "memary": ((".memary/memory_stream.json", "high"), (".memary", "low")),
    "mempalace": ((".mempalace/identity.txt", "high"), (".mempalace", "medium")), "openviking": ((".openviking/data", "high"), (".openviking", "low")), "tdai": ((".tdai/persona.md", "high"), (".tdai", "low")),
}


def detect(spark: SparkSession, home: str) -> DataFrame:
    """adapter, location, confidence of the stores below home: the surest probe of each."""
    found = []
    for adapter, probes in PROBES.items():
        hit = next(((p, c) for p, c in probes if (Path(home) / p).exists()), None)
        if hit:
            found.append((adapter, str(Path(home) / hit[0]), hit[1]))
    return spark.createDataFrame(found, "adapter string, location string, confidence string")
