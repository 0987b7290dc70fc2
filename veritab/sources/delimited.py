"""A Spark data source of delimited files, each with a header of its own: (path, row_no, kv).

The listing plans the partitions: one for each file, small ones together. Each task reads the headers of its own files and streams their rows, so no
file is read to plan another and rows are as wide as their own header. Quotes, line ends inside them and separators are those of CSV, in
headers too. A name that a header repeats has the value of its last column; columns without a name, and fields beyond the header, are left
out; fields that a row lacks are empty. Blank lines are no rows. With ``columns`` only these are kept.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "veritab_delimited"
SCHEMA = "path string, row_no long, kv map<string,string>"
#: Bytes of small files that one task reads, and rows of a batch.
TOGETHER, ROWS = 32 << 20, 4096


@dataclass
class Files(InputPartition):
    """The files of a task."""

    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], separator: str, columns: list[str] | None):
        self.files, self.separator, self.columns = files, separator, columns

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        weight = TOGETHER
        for path, size in sorted(self.files):
            if weight + size > TOGETHER:
                out.append(Files([]))
                weight = 0
            out[-1].paths.append(path)
            weight += size
        return out or [Files([])]

    def read(self, partition: Files):
        for path in partition.paths:
            yield from self._rows(path)

    def _rows(self, path: str):
        from pyarrow import fs

        csv.field_size_limit(1 << 30)
        store, place = fs.FileSystem.from_uri(path)
        wanted = None if self.columns is None else set(self.columns)
        with store.open_input_stream(place) as raw:
            rows = filter(None, csv.reader(io.TextIOWrapper(raw, "utf-8", "replace", newline=""), delimiter=self.separator))
            head = next(rows, [])
            # The last column of each name, in the order of the columns.
            last = {name: k for k, name in enumerate(head) if name and (wanted is None or name in wanted)}
            held: list[list[tuple[str, str]]] = []
            number = 0
            for row in rows:
                held.append([(name, row[k] if k < len(row) else "") for name, k in last.items()])
                if len(held) == ROWS:
                    yield self._batch(path, number, held)
                    number, held = number + len(held), []
            if held:
                yield self._batch(path, number, held)

    def _batch(self, path: str, before: int, rows: list) -> pa.RecordBatch:
        kv = pa.array(rows, pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(before + 1, before + len(rows) + 1), pa.int64()), kv], ["path", "row_no", "kv"])


class Delimited(DataSource):
    """The source; options: files (a JSON list of paths and sizes), separator, columns (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        columns = self.options.get("columns")
        return _Reader([tuple(f) for f in json.loads(self.options["files"])], self.options.get("separator", ","), json.loads(columns) if columns else None)
