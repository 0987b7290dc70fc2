"""Cost estimates and the ledger that grants or refuses runs in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.scalars import weight_mb

#: Seconds to score a row against a GB of weights, GPU hours assumed where a script asks for one, and the default ceilings.
SECONDS_PER_ROW_GB, GPU_HOURS = 0.05, 0.5
CEILINGS = {"download_mb": 512.0, "gpu_hours": 1.0, "wall_hours": 2.0}


def estimate(scripts: DataFrame, models: DataFrame, rows: DataFrame) -> DataFrame:
    """(script, download_mb, wall_hours, gpu_hours). models: (script, model); rows: (repo-wide) one row with n_rows."""
    sized = models.distinct().withColumn("mb", weight_mb(F.col("model"))).where("mb is not null").groupBy("script").agg(F.sum("mb").alias("mb"))
    text = F.col("text")
    pinned = (F.contains(text, F.lit('device="cpu"')) | F.contains(text, F.lit("device='cpu'"))) & ~F.contains(text, F.lit("cuda"))
    asks = F.contains(text, F.lit("cuda")) | F.contains(F.lower(text), F.lit("gpu"))
    out = scripts.join(sized, "script", "left").crossJoin(F.broadcast(rows.select("n_rows").limit(1)))
    mb = F.coalesce("mb", F.lit(0.0))
    return out.select("script", mb.alias("download_mb"), (F.col("n_rows") * (mb / 1024) * SECONDS_PER_ROW_GB / 3600).alias("wall_hours"), F.when((mb > 0) & ~pinned & asks, GPU_HOURS).otherwise(0.0).alias("gpu_hours"))


def ledger(estimates: DataFrame, ceilings: dict[str, float] = CEILINGS) -> DataFrame:
    """(run, ord, refused, spent) of each estimate in its run's order; what is refused spends nothing.

    estimates: (run, ord, download_mb, gpu_hours, wall_hours); spent: what all grants so far add up to, in
    this order. A grant depends on all grants before it, so a task goes through the sorted estimates of
    its runs once and holds three sums, however long a run is.
    """
    kinds = ["download_mb", "gpu_hours", "wall_hours"]
    most = [ceilings[k] for k in kinds]
    kind = estimates.schema["run"].dataType.simpleString()

    def run(batches):
        last, spent = object(), [0.0] * 3
        for b in batches:
            refused, totals = [], []
            for name, *wants in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if name != last:
                    last, spent = name, [0.0] * 3
                over = next((k for k, w, s, m in zip(kinds, wants, spent, most, strict=True) if w > m - s), None)
                if over is None:
                    spent = [s + w for s, w in zip(spent, wants, strict=True)]
                refused.append(over)
                totals.append(spent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(refused, pa.string()), pa.array(totals, pa.list_(pa.float64()))], ["run", "ord", "refused", "spent"])

    amounts = [F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in kinds]
    placed = estimates.select("run", F.col("ord").cast("long").alias("ord"), *amounts).repartition("run").sortWithinPartitions("run", "ord")
    return placed.mapInArrow(run, f"run {kind}, ord long, refused string, spent array<double>")


def running_total(estimates: DataFrame, column: str) -> DataFrame:
    """estimates with the sum of a column so far in its run."""
    so_far = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return estimates.withColumn("total", F.sum(column).over(so_far))
