"""SQLite tables as a Spark data source.

``spark.read.format("sqlite_rows").option("path", ...).option("table", ...)``: every file (path may be a glob or a comma list) is cut into ranges
of row ids of ``rows_per_split``, each read by its own task; the files must be visible to the executors. Columns keep their names; all
values come as text, long, double or binary by the declared type.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _files(path: str) -> list[str]:
    return sorted(f for p in path.split(",") for f in (glob.glob(p) or [p]))


def _connect(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def columns(file: str, table: str) -> list[tuple[str, str]]:
    """(name, declared type) of a table's columns; empty if there is no such table."""
    with _connect(file) as c:
        return [(r[1], (r[2] or "").upper()) for r in c.execute("SELECT * FROM pragma_table_info(?)", (table,))]


def tables(file: str) -> list[str]:
    with _connect(file) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.step = int(options.get("rows_per_split", 100_000))

    def partitions(self) -> list[Rows]:
        out = []
        for f in _files(self.path):
            if not columns(f, self.table):
                continue
            with _connect(f) as c:
                low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            if low is not None:
                out += [Rows(f, a, min(a + self.step - 1, high)) for a in range(low, high + 1, self.step)]
        return out or [Rows("", 0, -1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        names = [f.name for f in self.schema]
        types = [kinds[f.dataType.simpleString()] for f in self.schema]
        convert = {pa.string(): lambda v: v if isinstance(v, str) else str(v), pa.int64(): int, pa.float64(): float, pa.binary(): lambda v: v if isinstance(v, bytes) else str(v).encode()}

        def cell(v, t):
            try:
                return None if v is None else convert[t](v)
            except (TypeError, ValueError):
                return None

        if not partition.file:
            return
        have = {n for n, _ in columns(partition.file, self.table)}
        picked = ", ".join(f'"{n}"' if n in have else "NULL" for n in names)
        with _connect(partition.file) as c:
            cursor = c.execute(f'SELECT {picked} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.first, partition.last))
            while rows := cursor.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([cell(r[i], t) for r in rows], t) for i, t in enumerate(types)], names=names)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> StructType:
        """The union of the files' columns, by introspection."""
        found: dict[str, object] = {}
        for f in _files(self.options["path"]):
            for name, declared in columns(f, self.options["table"]):
                kind = LongType() if "INT" in declared else DoubleType() if declared in ("REAL", "DOUBLE", "FLOAT") else BinaryType() if "BLOB" in declared else StringType()
                found.setdefault(name, kind)
        return StructType([StructField(n, t) for n, t in found.items()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The rows of a table in one or more SQLite files, or None if no file has it."""
    if not any(columns(f, table) for f in _files(path)):
        return None
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").option("path", path).option("table", table).load()
