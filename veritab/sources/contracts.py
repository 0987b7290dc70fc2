"""Versioned JSON contracts and tolerance settings."""

from __future__ import annotations

import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.schema import CELL, RESULTS, TABLE, VERSION, checked_failure, checked_version
from veritab.sources import documents

DEFAULTS = {"relative": 0.05, "absolute": None, "multiplier": 3.0}
#: Names that a setting goes by.
KEYS = {"rel": "relative", "relative": "relative", "abs": "absolute", "absolute": "absolute", "yellow": "multiplier", "yellow_multiplier": "multiplier"}
CONFIG_NAME = "tolerances.toml"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(pos, address, value, uncertainty, n_seeds, failure, caveats); another major version or an unknown code is an error."""
    docs = spark.read.schema(RESULTS).json(path, multiLine=True)
    rows = docs.select(checked_version(F.col("schema_version")).alias("version"), F.posexplode("cells").alias("pos", "c")).where("version is not null")
    return rows.select(*_entry_columns())


def _entry_columns() -> list[Column]:
    caveats = F.coalesce("c.caveats", F.array().cast("array<string>"))
    return [*map(F.col, ["pos", "c.address", "c.value", "c.uncertainty", "c.n_seeds"]), checked_failure(F.col("c.failure")).alias("failure"), caveats.alias("caveats")]


def read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(paper, table struct) of what write_papers wrote, under the ids that it was given."""
    held = documents.latest(documents.read_documents(spark, folder))
    return _tables(held.select(F.col("id").alias("paper"), F.from_json("document", PAPER).alias("d")).select("paper", "d.*"))


def read_table_files(spark: SparkSession, path: str) -> DataFrame:
    """(paper, table struct) of files that hold one paper each; a paper is known by its file."""
    return _tables(spark.read.schema(PAPER).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("paper"), "*"))


def _tables(docs: DataFrame) -> DataFrame:
    return docs.select("paper", checked_version(F.col("schema_version")).alias("version"), F.explode("tables").alias("t")).where("version is not null").select("paper", "t.*")


def paper_json(cells: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(paper_id, value): each paper's tables as one versioned JSON text that read_tables reads.

    cells: as extract_cells gives them; paragraphs: (paper_id, label, ord, paragraph). A paper's cells meet in one row.
    """
    fields = [x.strip().split()[0] for x in CELL.split(", ")]
    cell = F.struct(*[(F.col(c) if c in cells.columns else F.array().cast("array<string>")).alias(c) for c in fields])
    heads = F.array_sort(F.collect_set(F.struct("col", "col_path")))
    tables = cells.groupBy("paper_id", "inline", "index", "table_id").agg(
        F.max("label").alias("label"), F.max("caption").alias("caption"), F.max("environment").alias("environment"),
        F.transform(heads, lambda h: h["col_path"]).alias("column_headers"), F.transform(F.array_sort(F.collect_list(F.struct("row", "col", cell.alias("cell")))), lambda x: x["cell"]).alias("cells"),
    )
    if paragraphs is not None:
        said = paragraphs.groupBy("paper_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "paragraph"))), lambda x: x["paragraph"]).alias("referencing_paragraphs"))
        tables = tables.join(said, ["paper_id", "label"], "left")
    else:
        tables = tables.withColumn("referencing_paragraphs", F.lit(None).cast("array<string>"))
    one = F.struct(F.col("index").cast("int").alias("index"), "label", "caption", "environment", "column_headers", "cells", F.coalesce("referencing_paragraphs", F.array().cast("array<string>")).alias("referencing_paragraphs"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("inline", "index", one.alias("table")))), lambda x: x["table"])
    papers = tables.groupBy("paper_id").agg(ordered.alias("tables"))
    return papers.select("paper_id", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "tables")).alias("value"))


def write_papers(cells: DataFrame, folder: str, paragraphs: DataFrame | None = None, mode: str = "append") -> None:
    """Each paper of paper_json as a document under its id; a paper that is written again replaces itself."""
    written = paper_json(cells, paragraphs).select(F.col("paper_id").cast("string").alias("id"), F.col("value").alias("document"))
    documents.write_documents(written, folder, mode)


def _nested(schema: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


#: A paper's document.
PAPER = f"schema_version string, tables array<struct<{_nested(TABLE)}>>"


def result_entry() -> Column:
    """The JSON text of a result: failure or value, never both; a value that is null without a failure is kept."""
    failed = F.col("failure").isNotNull()
    made = lambda c: F.when(~failed, F.col(c)).alias(c)
    rest = F.to_json(F.struct("address", F.when(failed, F.col("failure")).alias("failure"), made("value"), made("uncertainty"), made("n_seeds"), F.when(F.size("caveats") > 0, F.col("caveats")).alias("caveats")))
    return F.when(~failed & F.col("value").isNull(), F.regexp_replace(rest, r"\}$", ',"value":null}')).otherwise(rest)


def result_json(results: DataFrame) -> DataFrame:
    """(value): result_entry of each result."""
    return results.select(result_entry().alias("value"))


def write_results(results: DataFrame, folder: str, runs: DataFrame | None = None, mode: str = "append") -> None:
    """Each run's results as one versioned document under its id; a run that is written again replaces itself.

    results: (run_id, pos, address, value, uncertainty, n_seeds, failure, caveats). runs: (run_id, run map<string,string>),
    what is known of a run; one without results is written too. The results of a run meet in one row.
    """
    listed = results.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", result_entry().alias("entry")))), lambda x: x["entry"]), ",").alias("cells"))
    known = listed.join(runs, "run_id", "full") if runs is not None else listed.withColumn("run", F.lit(None).cast("map<string,string>"))
    whole = F.concat(
        F.lit(f'{{"schema_version":"{VERSION}","run":'), F.coalesce(F.to_json("run"), F.lit("{}")),
        F.lit(',"cells":['), F.coalesce("cells", F.lit("")), F.lit("]}"),
    )
    documents.write_documents(known.select(F.col("run_id").cast("string").alias("id"), whole.alias("document")), folder, mode)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, run, pos, address, value, ...) of what write_results wrote, checked like read_results; runs without results have one row without an address."""
    held = documents.latest(documents.read_documents(spark, folder)).select("id", F.from_json("document", RESULTS).alias("d"))
    rows = held.select(F.col("id").alias("run_id"), F.col("d.run").alias("run"), checked_version(F.col("d.schema_version")).alias("version"), F.posexplode_outer("d.cells").alias("pos", "c")).where("version is not null")
    return rows.select("run_id", "run", *_entry_columns())


def parse_tolerance(spec: str) -> dict:
    """A bare number is relative; key=value pairs stand apart by commas or spaces."""
    out = {}
    for part in re.split(r"[,\s]+", spec.strip()):
        key, _, value = part.rpartition("=")
        name = KEYS.get(key.strip().lower() or "relative")
        try:
            number = float(value)
        except ValueError:
            raise ValueError(f"not a tolerance: {part!r}") from None
        if name is None or number < 0:
            raise ValueError(f"not a tolerance: {part!r}")
        out[name] = number
    return out


def read_config(text: str) -> tuple[dict, dict[str, dict]]:
    """(default, each table's own) of a TOML text; a table's setting inherits what it leaves out."""

    def checked(entry: dict) -> dict:
        out = {}
        for key, value in entry.items():
            if key not in KEYS or isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ValueError(f"not a tolerance setting: {key} = {value!r}")
            out[KEYS[key]] = float(value)
        return out

    data = tomllib.loads(text)
    if unknown := set(data) - {"default", "tables"}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    default = DEFAULTS | checked(data.get("default", {}))
    return default, {t: default | checked(entry) for t, entry in data.get("tables", {}).items()}


def discover_config(start: str) -> Path | None:
    """The nearest settings file at or above a folder."""
    here = Path(start).resolve()
    return next((p / CONFIG_NAME for p in (here, *here.parents) if (p / CONFIG_NAME).is_file()), None)


def resolve_policy(spark: SparkSession, spec: str | None, config: str | None) -> tuple[dict, DataFrame]:
    """(default, tolerances DataFrame): a command-line spec replaces the whole default, never a table's own."""
    default, tables = read_config(config) if config else (dict(DEFAULTS), {})
    if spec:
        default = DEFAULTS | parse_tolerance(spec)
    rows = [(t, e["relative"], e["absolute"], e["multiplier"]) for t, e in tables.items()]
    return default, spark.createDataFrame(rows, "table_id string, relative double, absolute double, multiplier double")
