"""documents -> resampled, line-deduplicated, near-deduplicated, decontaminated, encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet before the next one reads it. All but the last return the columns of
``documents``. Rows are told apart by doc_id and text together, so ids that are null
or repeated lose nothing. Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import bpe, decontam, line_dedup, quality, simhash
from veritab.llm.common import staged
from veritab.llm.queries import table, tokenizer_file

#: Rows to drop up to which they are sent to every task; more are joined.
SMALL = 200_000


def resample_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the Gumbel top-k doesn't select go."""
    return quality.resample(docs, table(spark, sf_dir, "labels"))[1].keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: cross-site boilerplate lines go; n_chars follows the text, no row is dropped.

    Texts that share half of their five-word shingles or more are copies, in chains too. One of each
    group counts for a line's sites, so what only copies share stays for the next stage, and every
    boilerplate line goes, however much of its document it is. At a similarity of 0.5
    fingerprints differ in 69 of 256 bits on average with a deviation of 7.
    """
    counted = simhash.keep_one(docs, shingle=5, radius=100, width=4, smallest=8, least=0.5)
    done = line_dedup.remove_boilerplate(docs, counted=counted)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on five-word shingles: one document of each group stays.

    A similarity of 0.8 means shingle sets at an angle of 27 degrees, 39 of 256 bits on average
    with a deviation of 6; unrelated texts differ in 128. Candidates reach to 70 bits, and the
    similarity of their shingle sets decides.
    """
    return simhash.keep_one(docs, shingle=5, radius=70, width=4, smallest=8, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with an occurrence of a ten-word window of an item go."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"))
    found = decontam.decontaminate(docs.select(key.alias("__key"), "text"), table(spark, sf_dir, "benchmark"), id_col="__key")
    hit = staged(found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__key")).distinct(), "hit")
    if hit.count() <= SMALL:
        hit = F.broadcast(hit)
    return docs.withColumn("__key", key).join(hit, "__key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: (doc_id, n_tokens, ids) of each document."""
    done = bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", resample_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding", encode),
]

#: SQL can express neither the hashed models nor BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return docs
