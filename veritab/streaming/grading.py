"""Grading of results as they arrive: an optional streaming form of the grading join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.functions import scalars
from veritab.operators.grade import MULTIPLIER, RELATIVE, verdict


def harvest_stream(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Streaming mean and count of a value by keys; state is one row for each key."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(F.avg(F.when(scalars.is_finite(x), x)).alias("value"), F.count(F.when(scalars.is_finite(x), x)).alias("n"))


def graded(cells: DataFrame, results: DataFrame) -> DataFrame:
    """(address, status) of a batch of results against the static cells."""
    joined = cells.select("address", F.col("value").alias("p"), F.col("uncertainty").alias("u")).join(results.select("address", F.col("value").alias("v")), "address")
    band = scalars.band(F.col("p"), F.lit(RELATIVE), F.lit(None).cast("double"))
    return joined.select("address", verdict(F.col("p"), F.col("u"), F.col("v"), band, F.lit(MULTIPLIER)).alias("status"))


def grade_stream(cells: DataFrame, results: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Start a query that hands each micro-batch, graded, to sink; all that is there is processed, then it ends."""
    return results.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: sink(graded(cells, batch), n)).start()
