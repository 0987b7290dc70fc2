"""Plans kept by repository commit, mapper and paper: storing one again replaces it, whole or not at all.

A store writes its recipes into a folder of their own first. Then it replaces, for each paper stored, the paper's entry in a
manifest partitioned by them; the entry names the folder and the version. So a reader
finds the old plan or the new one, a paper without recipes has an entry too, and nothing is ever appended to a plan. Keys are
strings whatever they look like: 12, 12e4 and 120000 differ. For that, partitions go by ``slot``, a hash of the three that no reader
takes for a number. Folders that no entry names any more can go.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.schema import VERSION

ENTRY = "version string, generation string, recipes long, commit string, mapper string, paper_key string, slot string"


def slot(commit: Column, mapper: Column, paper_key: Column) -> Column:
    """The partition of a key."""
    return F.concat(F.lit("k"), F.sha2(F.to_json(F.array(commit, mapper, paper_key)), 256))


def store_plan(plan: DataFrame, folder: str, commit: str, mapper: str, papers: DataFrame | None = None) -> None:
    """plan: recipes with their paper_key. papers: (paper_key) of all papers planned, if some may have no recipe."""
    generation = uuid.uuid4().hex
    place = f"{folder.rstrip('/')}/recipes/generation={generation}"
    key = F.col("paper_key").cast("string")
    own = slot(F.lit(commit), F.lit(mapper), F.col("paper_key"))
    plan.withColumn("paper_key", key).withColumn("slot", own).write.partitionBy("slot").parquet(place)
    counts = plan.groupBy(key.alias("paper_key")).agg(F.count(F.lit(1)).alias("recipes"))
    if papers is not None:
        counts = counts.join(papers.select(key.alias("paper_key")).distinct(), "paper_key", "full")
    entries = counts.select(F.lit(VERSION).alias("version"), F.lit(generation).alias("generation"), F.coalesce("recipes", F.lit(0)).alias("recipes"), F.lit(commit).alias("commit"), F.lit(mapper).alias("mapper"), "paper_key", own.alias("slot"))
    writer = entries.repartition("slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("slot").parquet(f"{folder.rstrip('/')}/manifest")


def entries(spark: SparkSession, folder: str) -> DataFrame | None:
    """The manifest; None where nothing was stored."""
    try:
        return spark.read.schema(ENTRY).parquet(f"{folder.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_plan(spark: SparkSession, folder: str, commit: str, mapper: str, paper_key: str, schema: str) -> DataFrame | None:
    """The recipes stored for a key; None for a key that isn't there or was stored by another version.

    schema: of the recipes without their paper_key. Only the key's own partitions are read.
    """
    found = entries(spark, folder)
    if found is None:
        return None
    wanted = slot(F.lit(commit), F.lit(mapper), F.lit(paper_key))
    entry = found.where(F.col("slot") == wanted).first()
    if entry is None or entry["version"] != VERSION:
        return None
    if not entry["recipes"]:
        return spark.createDataFrame([], f"{schema}, paper_key string")
    place = f"{folder.rstrip('/')}/recipes/generation={entry['generation']}"
    return spark.read.schema(f"{schema}, paper_key string, slot string").parquet(place).where(F.col("slot") == wanted).drop("slot")
