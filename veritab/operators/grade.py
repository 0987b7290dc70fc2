"""Grading: published cells against results, by address, within tolerance bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import scalars
from veritab.schema import STATUSES, checked_failure, described

RELATIVE, MULTIPLIER = 0.05, 3.0
NO_ENTRY = "no entry for this cell in the results file"
NOTHING = "results entry carried neither a value nor a failure code"


def latest(results: DataFrame) -> DataFrame:
    """One entry for each address: the last by position. max_by is a partial aggregate, so an address that repeats in a third of all rows costs one state a task."""
    whole = F.struct(*[c for c in results.columns if c != "address"])
    return results.groupBy("address").agg(F.max_by(whole, "pos").alias("r")).select("address", "r.*")


def with_tolerance(cells: DataFrame, tolerances: DataFrame | None, relative: float = RELATIVE, absolute: float | None = None, multiplier: float = MULTIPLIER) -> DataFrame:
    """cells with relative, absolute and multiplier: a table's own, field by field, else the default's."""
    own = tolerances if tolerances is not None else cells.sparkSession.createDataFrame([], "table_id string, relative double, absolute double, multiplier double")
    # A configuration has one small row for each table that it names.
    out = cells.join(F.broadcast(own.select("table_id", F.col("relative").alias("r"), F.col("absolute").alias("a"), F.col("multiplier").alias("m"))), "table_id", "left")
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v).cast("double"))
    return out.withColumns({"relative": default("r", relative), "absolute": default("a", absolute), "multiplier": default("m", multiplier)}).drop("r", "a", "m")


def verdict(p: Column, u: Column, v: Column, band: Column, multiplier: Column) -> Column:
    """Status of a finite pair: the published uncertainty first, then the band, the sign, the wider band."""
    d = F.abs(v - p)
    return (
        F.when(~scalars.is_finite(p) | ~scalars.is_finite(v), "RED").when(u.isNotNull() & (d <= F.abs(u)), "GREEN").when(d <= band, "GREEN")
        .when(p * v < 0, "RED").when(d <= band * multiplier, "YELLOW").otherwise("RED")
    )


def compare(cells: DataFrame, results: DataFrame, tolerances: DataFrame | None = None) -> DataFrame:
    """Every numeric cell with its status, delta, band, failure and notes.

    cells: (ord, table_id, address, text, is_numeric, value, uncertainty, unit); results: (pos, address, value, failure, caveats).
    """
    got = latest(results).select("address", F.lit(True).alias("found"), F.col("value").alias("v"), checked_failure(F.col("failure")).alias("failed"), F.col("caveats").alias("caveats"))
    out = with_tolerance(cells.where("is_numeric"), tolerances).join(got, "address", "left")
    p, u, v = F.col("value"), F.col("uncertainty"), F.col("v")
    band = scalars.band(p, F.col("relative"), F.col("absolute"))
    comparable = F.col("found") & F.col("failed").isNull() & v.isNotNull()
    finite = scalars.is_finite(p) & scalars.is_finite(v)
    status = F.when(F.col("found").isNull(), "NOT_ATTEMPTED").when(~comparable, "UNRUNNABLE").otherwise(verdict(p, u, v, band, F.col("multiplier")))
    failure = F.when(F.col("found") & F.col("failed").isNotNull(), F.col("failed")).when(F.col("found") & v.isNull(), F.struct(F.lit("OTHER").alias("code"), F.lit(NOTHING).alias("evidence")))
    within = comparable & finite & u.isNotNull() & (F.abs(v - p) <= F.abs(u))
    flipped = comparable & finite & ~F.coalesce(F.abs(v - p) <= F.abs(u), F.lit(False)) & (F.abs(v - p) > band) & (p * v < 0)
    own_notes = F.array(
        F.when(F.col("found").isNull(), NO_ENTRY),
        F.when(comparable & ~finite, F.concat(F.when(~scalars.is_finite(p), "the paper's").otherwise("the rerun's"), F.lit(" value is not finite, so the two cannot be compared"))),
        F.when(comparable & finite & (F.col("unit") != "none"), F.concat(F.lit("paper reports this in "), "unit", F.lit("; values compared as given"))),
        F.when(within, F.lit("within paper's reported uncertainty")),
        F.when(flipped, F.lit("sign differs from the paper")),
    )
    carried = F.when(comparable & finite, F.coalesce("caveats", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    shown = lambda x: F.when(scalars.is_finite(x), x)
    delta = F.when(comparable & finite, v - p)
    return out.select(
        "ord", "table_id", "address", "text", status.alias("status"), shown(p).alias("paper_value"), F.when(comparable, shown(v)).alias("result_value"), delta.alias("delta"),
        scalars.relative_delta(delta, p).alias("relative_delta"), F.when(comparable & finite, band).alias("band"), failure["code"].alias("failure_code"), failure["evidence"].alias("evidence"),
        F.concat(F.filter(own_notes, lambda n: n.isNotNull()), carried).alias("notes"),
    )


def unmatched(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Addresses of results that no numeric cell has."""
    return results.select("address").distinct().join(cells.where("is_numeric").select("address"), "address", "left_anti")


def status_counts(compared: DataFrame) -> DataFrame:
    """(status, n) of all five statuses, zero where there is none."""
    every = reduce(DataFrame.union, [compared.sparkSession.range(1).select(F.lit(s).alias("status")) for s in STATUSES])
    return every.join(compared.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def summary(compared: DataFrame) -> DataFrame:
    """(reproduced, comparable): green cells, and those with any colour."""
    return compared.agg(F.count_if(F.col("status") == "GREEN").alias("reproduced"), F.count_if(F.col("status").isin("GREEN", "YELLOW", "RED")).alias("comparable"))


def by_table(compared: DataFrame) -> DataFrame:
    """(table_label, first, n, green) in the paper's order: floats, loose tables, the rest."""
    label = F.regexp_extract("address", r"^[^›]*?(?= ›|$)", 0)
    number = F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")
    group = F.when(label.rlike(r"^Table \d+$"), 0).when(label.rlike(r"^Inline table \d+$"), 1).otherwise(2)
    out = compared.groupBy(label.alias("table_label"), group.alias("kind"), number.alias("number")).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "GREEN").alias("green"))
    return out.orderBy("kind", "number", "first")


def failure_legend(compared: DataFrame) -> DataFrame:
    """(code, evidence, description, n, cells): each distinct reason once, its cells in order of the paper."""
    from veritab.functions.names import short_address

    failed = compared.where("status = 'UNRUNNABLE' and failure_code is not null").withColumn("short", short_address(F.col("address")))
    out = failed.groupBy(F.col("failure_code").alias("code"), F.coalesce("evidence", F.lit("")).alias("evidence")).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.expr("listagg(short, ', ') within group (order by ord)").alias("cells"))
    return out.withColumn("description", described(F.col("code"))).orderBy("first")


def is_last_header(col_path: Column) -> Column:
    from veritab.functions.names import is_difference_marker

    return (F.size(col_path) > 0) & is_difference_marker(F.try_element_at(col_path, F.lit(-1)))


def difference_operands(cells: DataFrame) -> DataFrame:
    """(address, minuend, subtrahend, n) of difference cells; operands are null unless exactly two other numeric cells share the row."""
    numeric = cells.where("is_numeric").withColumn("derived", is_last_header(F.col("col_path")))
    row = Window.partitionBy("paper_id", "table_id", "row_path")
    others = F.array_sort(F.collect_list(F.when(~F.col("derived"), F.struct("col", "address"))).over(row))
    out = numeric.withColumn("others", others).where("derived")
    pair = lambda k: F.when(F.size("others") == 2, F.col("others")[k]["address"])
    return out.select("paper_id", "address", pair(0).alias("minuend"), pair(1).alias("subtrahend"), F.size("others").alias("n"))
