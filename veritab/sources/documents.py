"""A Spark data source of JSON documents, one to an id: written by tasks, made visible by one commit.

A folder holds files of JSON lines, one file a task and commit, and a manifest that lists the files of each generation.
Tasks write their files under names of their own. Only the commit names them in the manifest, so a task that fails, runs twice or
belongs to a write that fails leaves nothing that a reader sees; an abort takes its files away. ``append`` adds a generation,
``overwrite`` leaves the new one alone. The manifest has a row for each file, not for each document.

Reading gives (id, generation, document), a partition a file; ``latest`` keeps the last generation of each id. A
manifest of another major version is an error; a folder without one holds no documents.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from veritab.schema import VERSION

FORMAT = "veritab_documents"
MANIFEST = "manifest.json"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _manifest(uri: str) -> list[dict]:
    """The files of all generations in order."""
    from pyarrow import fs

    store, place = _store(uri)
    if store.get_file_info(f"{place}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{place}/{MANIFEST}") as f:
        held = json.loads(f.read())
    if str(held.get("schema_version")).split(".")[0] != VERSION.split(".")[0]:
        raise ValueError(f"unsupported schema version: {held.get('schema_version')}")
    return held["files"]


@dataclass
class Written(WriterCommitMessage):
    """A task's file and how many documents it holds; no name if it got none."""

    name: str | None
    documents: int


@dataclass
class Part(InputPartition):
    """A file to read."""

    name: str
    generation: int


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite

    def write(self, iterator) -> Written:
        store, place = _store(self.uri)
        name, n, out = f"part-{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for row in iterator:
                if out is None:
                    store.create_dir(place, recursive=True)
                    out = store.open_output_stream(f"{place}/{name}")
                out.write((json.dumps({"id": row["id"], "document": row["document"]}, ensure_ascii=False) + "\n").encode())
                n += 1
        finally:
            if out is not None:
                out.close()
        return Written(name if n else None, n)

    def commit(self, messages) -> None:
        store, place = _store(self.uri)
        held = _manifest(self.uri)
        generation = 1 + max((f["generation"] for f in held), default=0)
        new = [{"name": m.name, "generation": generation, "documents": m.documents} for m in messages if m and m.name]
        store.create_dir(place, recursive=True)
        draft = f"{place}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"schema_version": VERSION, "files": new if self.overwrite else held + new}).encode())
        store.move(draft, f"{place}/{MANIFEST}")
        if self.overwrite:
            for f in held:
                store.delete_file(f"{place}/{f['name']}")

    def abort(self, messages) -> None:
        store, place = _store(self.uri)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{place}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Part]:
        return [Part(f["name"], f["generation"]) for f in _manifest(self.uri)] or [Part("", 0)]

    def read(self, partition: Part):
        if partition.name:
            store, place = _store(self.uri)
            with store.open_input_stream(f"{place}/{partition.name}") as f:
                rest = b""
                while chunk := f.read(1 << 20):
                    *whole, rest = (rest + chunk).split(b"\n")
                    for line in whole:
                        held = json.loads(line)
                        yield held["id"], partition.generation, held["document"]


class Documents(DataSource):
    """The source; its one option is the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id string, generation long, document string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def write_documents(documents: DataFrame, folder: str, mode: str = "append") -> None:
    """documents: (id, document)."""
    documents.sparkSession.dataSource.register(Documents)
    # The source has one schema, generation included; what is written has none yet.
    shaped = documents.select(F.col("id").cast("string"), F.lit(None).cast("long").alias("generation"), "document")
    shaped.write.format(FORMAT).mode(mode).save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, generation, document) of all generations."""
    spark.dataSource.register(Documents)
    return spark.read.format(FORMAT).load(folder)


def latest(documents: DataFrame) -> DataFrame:
    """(id, document): the last generation of each id; of equal ids in one generation, the greatest text."""
    return documents.groupBy("id").agg(F.max_by("document", F.struct("generation", "document")).alias("document"))
