"""Tables of SQLite files as a data source; tasks read each file in ranges of rows.

The files must lie where the driver and all executors see them under the same path. They are opened read-only, so that
what a write-ahead log beside a file holds is read too. Files that lack the table give no rows; a file
that is no database, is locked, or whose table lacks a column wanted raises its error.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructType

#: Rows of a range.
ROWS = 100_000


def found(root: str, pattern: str = "*.db") -> list[str]:
    """The files of a folder and below, or the file itself; a folder that isn't there has none."""
    top = Path(root)
    return [str(top)] if top.is_file() else sorted(str(p) for p in top.rglob(pattern) if p.is_file())


def modified(path: str) -> int:
    """When a database was written last, in nanoseconds; new rows may be in its write-ahead log alone."""
    return max(os.stat(p).st_mtime_ns for p in (path, f"{path}-wal") if os.path.exists(p))


def _connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    """Rows of a file from a row id to before another; None: no bound."""

    def __init__(self, path: str, first: int | None, end: int | None):
        self.path, self.first, self.end = path, first, end


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, "INTEGER" if isinstance(f.dataType, LongType) else "TEXT") for f in schema]
        self.root, self.name, self.table = options["path"], options["table"], _quoted(options["table"])
        self.pattern, self.rows = options.get("pattern", "*.db"), int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        """Ranges of as many rows each, whatever their ids are; a table without row ids is one range."""
        out = []
        for path in found(self.root, self.pattern):
            connection = _connected(path)
            try:
                if not connection.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ? COLLATE NOCASE", (self.name,)).fetchone():
                    continue
                try:
                    starts = [r[0] for r in connection.execute(f"SELECT rowid FROM (SELECT rowid, row_number() OVER (ORDER BY rowid) AS n FROM {self.table}) WHERE n % ? = 1 % ? ORDER BY rowid", (self.rows, self.rows))]
                except sqlite3.OperationalError as error:
                    if "no such column: rowid" not in str(error):
                        raise
                    out.append(RowRange(path, None, None))
                    continue
                out += [RowRange(path, a, b) for a, b in zip(starts, [*starts[1:], None])]
            finally:
                connection.close()
        return out or [RowRange("", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        if not partition.path:
            return
        columns = ", ".join(f"CAST(t.{_quoted(n)} AS {kind})" for n, kind in self.fields)
        bounds = [(f"rowid {sign} ?", v) for sign, v in ((">=", partition.first), ("<", partition.end)) if v is not None]
        where = " WHERE " + " AND ".join(c for c, _ in bounds) if bounds else ""
        connection = _connected(partition.path)
        try:
            yield from connection.execute(f"SELECT {columns} FROM {self.table} AS t{where}", [v for _, v in bounds])
        finally:
            connection.close()


class SqliteSource(DataSource):
    """Options: path, table, pattern (*.db), rows (of a range). Columns are those of the schema given, texts or longs."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def table(spark: SparkSession, root: str, name: str, schema: str, **options: str) -> DataFrame:
    """A table of the SQLite files of a folder; schema has the columns wanted, as ``string`` or ``bigint``."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).schema(schema).options(table=name, **options).load(root)
