"""Papers, artifacts and repositories as DataFrames.

Everything is read by Spark's own readers; small helpers inside tasks only unpack one
archive or join one paper's files.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import tarfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.sources import delimited, includes

#: What a repository's files are by suffix or name, and folders that are not its own work.
SCRIPT_SUFFIXES = ["py", "sh", "r"]
ARTIFACT_SUFFIXES = ["csv", "tsv"]
README_NAMES = ["readme.md", "readme.rst", "readme.txt", "readme"]
REQUIREMENT_FILES = ["requirements.txt", "pyproject.toml", "environment.yml", "environment.yaml"]
SKIPPED = [
    ".git", ".venv", "venv", "env", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "site-packages", ".idea", ".vscode", "build", "dist", ".eggs",
]
SCRIPT_BYTES, ARTIFACT_BYTES = 1 << 20, 64 << 20


def _safe(name: str) -> bool:
    return not name.startswith("/") and ".." not in name.split("/")


def _decoded(data: bytes) -> str | None:
    """UTF-8, else Latin-1; None for binary data."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return None if "\x00" in text[:4096] else text


def members(payload: bytes) -> list[tuple[str, str]]:
    """(path, text) of a plain or gzipped tar, a gzipped text, or a text."""
    if payload[:2] == b"\x1f\x8b":
        payload = gzip.decompress(payload)
    try:
        with tarfile.open(fileobj=io.BytesIO(payload)) as tar:
            found = [(m.name, _decoded(tar.extractfile(m).read())) for m in tar.getmembers() if m.isfile() and _safe(m.name)]
    except tarfile.TarError:
        found = [("main.tex", _decoded(payload))]
    return [(name, text) for name, text in found if text is not None]


def unpack(archives: DataFrame) -> DataFrame:
    """(paper_id, path, text) of the text members of archives (path, content), as binaryFile reads them."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = members(bytes(content or b""))
                yield pa.RecordBatch.from_pydict({"paper_id": pa.array([name] * len(rows), pa.string()), "path": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())})

    return archives.select("path", "content").mapInArrow(run, "paper_id string, path string, text string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return unpack(spark.read.format("binaryFile").load(path))


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of every file below a folder."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tex_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").rlike(r"\.(?:tex|ltx)$"))


def main_files(files: DataFrame) -> DataFrame:
    """(paper_id, main): the first file with a document class outside comments, else the first file."""
    plain = F.regexp_replace("text", r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")
    classed = F.when(plain.rlike(r"\\documentclass\b"), F.col("path"))
    return tex_files(files).groupBy("paper_id").agg(F.coalesce(F.min(classed), F.min("path")).alias("main"))


def papers(files: DataFrame) -> DataFrame:
    """(paper_id, text): each paper's sources as one text, its input and include files in place."""
    sources = tex_files(files)
    return includes.documents(sources, main_files(sources))


def read_papers(spark: SparkSession, target: str) -> DataFrame:
    """(paper_id, text) of a .tex file, an archive, or a folder of sources, told apart by the name."""
    if target.lower().endswith((".tex", ".ltx")):
        return spark.read.option("wholetext", True).text(target).select(F.col("_metadata.file_path").alias("paper_id"), F.col("value").alias("text"))
    if target.lower().endswith((".gz", ".tar", ".tgz")):
        return papers(read_archives(spark, target))
    tree = read_tree(spark, target)
    return papers(tree.select(F.lit(target).alias("paper_id"), F.substring_index("path", target.rstrip("/") + "/", -1).alias("path"), "text"))


def classify(files: DataFrame) -> DataFrame:
    """files (path, length) that a repository's inventory lists, with their kind: script, artifact, readme or requirements."""
    parts = F.split("path", "/")
    name = F.lower(F.element_at(parts, -1))
    suffix = F.regexp_extract(name, r"\.([^.]+)$", 1)
    skipped = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED)))
    kind = (
        F.when(name.isin(README_NAMES), "readme").when(name.isin(REQUIREMENT_FILES), "requirements")
        .when(suffix.isin(SCRIPT_SUFFIXES) & (F.col("length") <= SCRIPT_BYTES), "script").when(suffix.isin(ARTIFACT_SUFFIXES) & (F.col("length") <= ARTIFACT_BYTES), "artifact")
    )
    return files.where(~skipped).withColumn("kind", kind).where("kind is not null")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, kind) below a folder; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return classify(files)


def read_artifacts(spark: SparkSession, paths: str | list[str], separator: str = ",", columns: list[str] | None = None) -> DataFrame:
    """(path, row_no, kv map<string,string>) of CSV or TSV files, each with a header of its own; all values are text.

    paths: files, folders or patterns. Only their listing is read to plan; what rows and headers mean is told in ``delimited``.
    """
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "length")
    found = [[r["path"], r["length"]] for r in listed.collect()]
    spark.dataSource.register(delimited.Delimited)
    reader = spark.read.format(delimited.FORMAT).option("files", json.dumps(found)).option("separator", separator)
    return (reader if columns is None else reader.option("columns", json.dumps(columns))).load()


def ordered_distinct(df: DataFrame, key: str, value: Column, order: str) -> DataFrame:
    """(key, values): distinct values in the order of their first row."""
    first = df.groupBy(key, value.alias("value")).agg(F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return first.withColumn("rank", rank).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))


def pyproject_names(text: str) -> list[str]:
    """Distributions that a pyproject file declares; none if it can't be read."""
    import tomllib

    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project = data.get("project", {})
    entries = [*project.get("dependencies", []), *(e for group in project.get("optional-dependencies", {}).values() for e in group), *(n for n in data.get("tool", {}).get("poetry", {}).get("dependencies", {}) if n != "python")]
    return sorted({re.sub(r"[-_.]+", "-", m[0]).lower() for e in entries if (m := re.match(r"[A-Za-z0-9][A-Za-z0-9._-]*", e))})


def conda_names(files: DataFrame) -> DataFrame:
    """(path, distribution) of list entries in environment files (path, text)."""
    flat = files.select("path", F.explode(F.split("text", r"\r?\n")).alias("line"))
    name = F.regexp_extract("line", r"^\s*-\s*(?:[\w.-]+::)?([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:[=<>!~ ].*)?$", 1)
    return flat.select("path", F.lower(F.regexp_replace(name, r"[-_.]+", "-")).alias("distribution")).where("distribution not in ('', 'python', 'pip')").distinct()
