"""Python data source ``sqlite``: a table or query of an SQLite file, read in parallel ranges of its rowid.

Options: ``path``, ``table`` or ``query`` (which wins), ``partitions`` (tables only). The schema is given by the caller.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return SqliteReader(dict(self.options), schema.fieldNames())


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if "query" in self.options:
            return [Rows(None, None)]
        with self._connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return [Rows(None, None)]
        n = max(1, int(self.options.get("partitions", "4")))
        step = -(-(high - low + 1) // n)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, rows: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._connect() as db:
            if "query" in self.options:
                yield from db.execute(f"SELECT {names} FROM ({self.options['query']})")
            else:
                where = "" if rows.low is None else f" WHERE rowid BETWEEN {rows.low} AND {rows.high}"
                yield from db.execute(f'SELECT {names} FROM "{self.options["table"]}"{where}')
