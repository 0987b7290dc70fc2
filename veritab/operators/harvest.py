"""Recipe execution: every recipe's filter and aggregates in one pass over the rows.

Recipes (address, path, value_column, statistic, uncertainty, filters array<struct<column, value>>)
meet artifact rows (path, row_no, kv map<string,string>) by path and filters; a missing column counts as
empty. Filters are pairs, not a map: two on one column select nothing, as they should.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.scalars import is_finite, to_number
from veritab.sources.staging import staged

#: Recipes up to which they are sent to every task; rows are many, recipes few.
SMALL = 50_000
DIGITS = 3
#: Distinct numbers that one running count goes over at most, and cuts of a range that has more.
FEW, SPLITTERS = 1 << 16, 63


def aggregates(x: Column) -> list[Column]:
    """Four of the statistics of the finite numbers, and how many were left out; each has a state of fixed size."""
    good = F.when(is_finite(x), x)
    return [
        F.avg(good).alias("mean"), F.sum(good).alias("sum"), F.count(good).cast("double").alias("count"),
        F.stddev_samp(good).alias("stdev"), F.count(good).alias("n_rows"), F.count_if(good.isNull()).alias("skipped"),
    ]


def medians(seen: DataFrame) -> DataFrame:
    """(address, median) of rows (address, x), exact, by distributed selection.

    Equal numbers are counted first. A rank that is asked for starts with the whole line as its range. While the range of a rank has more than
    FEW distinct numbers, SPLITTERS of them cut it into smaller ones, the numbers of each are counted where they stand, and the range that
    holds the rank takes its place. Only then a running count tells the number: it goes over FEW numbers at most,
    however many rows a recipe selects.
    """
    values = staged(seen.where(is_finite(F.col("x"))).groupBy("address", "x").agg(F.count(F.lit(1)).alias("n")))
    total = values.groupBy("address").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    ranks = F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")))
    whole = (F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    asked = staged(total.select("address", F.explode(F.filter(ranks, lambda k: k <= F.col("total"))).alias("rank"), *whole, F.lit(0).cast("long").alias("below"), "size"))
    while not (wide := asked.where(F.col("size") > FEW)).isEmpty():
        asked = staged(asked.where(F.col("size") <= FEW).unionByName(_narrowed(values, wide)))
    upto = Window.partitionBy("address", "rank").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = _inside(values, asked).withColumn("last", F.col("below") + F.sum("n").over(upto))
    found = counted.where((F.col("last") >= F.col("rank")) & (F.col("last") - F.col("n") < F.col("rank")))
    return found.groupBy("address").agg(F.avg("x").alias("median"))


def _inside(values: DataFrame, asked: DataFrame) -> DataFrame:
    """The numbers of each rank's range, which has its upper end but not its lower one."""
    return values.join(asked, "address").where((F.col("x") > F.col("low")) & (F.col("x") <= F.col("high")))


def _narrowed(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with the part of each range that holds the rank."""
    keys = ["address", "rank"]
    at = F.array(*[F.lit(k / (SPLITTERS + 1)) for k in range(1, SPLITTERS + 1)])
    inside = _inside(values, asked)
    cuts = inside.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("x", at, F.lit(100 * SPLITTERS))).alias("cuts"))
    dealt = inside.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    counts = dealt.groupBy(*keys, "part").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("size"), F.first("cuts").alias("cuts"), F.first("below").alias("below"), F.first("low").alias("low"), F.first("high").alias("high")
    )
    upto = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # SPLITTERS + 1 rows
    run = counts.withColumn("last", F.col("below") + F.sum("n").over(upto))
    held = run.where((F.col("last") >= F.col("rank")) & (F.col("last") - F.col("n") < F.col("rank")))
    cut = lambda k: F.get("cuts", k)
    return held.select(*keys, F.coalesce(cut(F.col("part") - 1), "low").alias("low"), F.coalesce(cut(F.col("part")), "high").alias("high"), (F.col("last") - F.col("n")).alias("below"), "size")


def selected(recipes: DataFrame, rows: DataFrame) -> DataFrame:
    """(address, statistic, x) of each row that a recipe selects; x is null where its column holds no number.

    Recipes are found by path, the columns that they filter and the values there: the filter is part of the join,
    so a row meets just the recipes that select it.
    """
    ordered = F.array_sort("filters")
    keyed = recipes.select("address", "path", "statistic", "value_column", F.transform(ordered, lambda f: f["column"]).alias("pins"), F.transform(ordered, lambda f: f["value"]).alias("pinned"))
    few = (lambda df: F.broadcast(df)) if recipes.count() <= SMALL else (lambda df: df)
    value = F.transform("pins", lambda c: F.trim(F.coalesce(F.try_element_at("kv", c), F.lit(""))))
    joined = rows.join(few(keyed.select("path", "pins").distinct()), "path").withColumn("pinned", value).join(few(keyed), ["path", "pins", "pinned"])
    return joined.select("address", "statistic", to_number(F.try_element_at("kv", F.col("value_column"))).alias("x"))


def picked(statistic: Column) -> Column:
    """The column that a statistic's name asks for."""
    out = F.lit(None).cast("double")
    for name in ("mean", "median", "sum", "count", "stdev"):
        out = F.when(statistic == name, F.col(name)).otherwise(out)
    return out


def harvest(recipes: DataFrame, rows: DataFrame) -> DataFrame:
    """(address, value, uncertainty, n_rows, skipped, error) of each recipe; error says why there is no value.

    Recipes are sent to all tasks when few. Partial aggregates keep a
    recipe over a third of all rows to one state a task. Values are rounded to three digits.
    """
    seen = selected(recipes, rows)
    stats = seen.groupBy("address").agg(*aggregates(F.col("x")))
    stats = stats.join(medians(seen.where("statistic = 'median'")), "address", "left")
    columns = rows.select("path", F.explode(F.map_keys("kv")).alias("column")).groupBy("path").agg(F.collect_set("column").alias("columns"))
    out = recipes.join(columns, "path", "left").join(stats, "address", "left")
    missing = F.filter(F.col("filters"), lambda f: ~F.array_contains("columns", f["column"]))
    n = F.coalesce("n_rows", F.lit(0))
    error = (
        F.when(F.col("columns").isNull(), F.concat(F.lit("no rows in "), "path"))
        .when(~F.array_contains("columns", F.col("value_column")), F.concat(F.lit("no column "), "value_column", F.lit(" in "), "path"))
        .when(F.size(missing) > 0, F.concat(F.lit("no column "), missing[0]["column"], F.lit(" in "), "path"))
        .when(n == 0, F.concat(F.lit("no numeric row of "), "path", F.lit(" passes the filters")))
        .when((F.col("statistic") == "stdev") & (n < 2), F.lit("a standard deviation needs two rows"))
    )
    value = F.when(error.isNull(), F.round(picked(F.col("statistic")), DIGITS))
    spread = F.when(error.isNull() & (F.col("uncertainty_statistic") == "stdev") & (n > 1), F.round("stdev", DIGITS))
    return out.select("address", value.alias("value"), spread.alias("uncertainty"), n.alias("n_rows"), F.coalesce("skipped", F.lit(0)).alias("skipped"), error.alias("error"))


def differences(derived: DataFrame, harvested: DataFrame) -> DataFrame:
    """(address, value, error) of cells derived as minuend - subtrahend, from the rounded operands."""
    left = harvested.select(F.col("address").alias("minuend"), F.col("value").alias("a"))
    right = harvested.select(F.col("address").alias("subtrahend"), F.col("value").alias("b"))
    out = derived.join(left, "minuend", "left").join(right, "subtrahend", "left")
    error = F.when(F.col("a").isNull(), F.concat(F.lit("no value for "), "minuend")).when(F.col("b").isNull(), F.concat(F.lit("no value for "), "subtrahend"))
    return out.select("address", F.round(F.col("a") - F.col("b"), DIGITS).alias("value"), error.alias("error"))


def as_rows(df: DataFrame, path: str | Column) -> DataFrame:
    """Any table as artifact rows: every column as text, keyed by its name."""
    named = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return df.select((F.lit(path) if isinstance(path, str) else path).alias("path"), F.monotonically_increasing_id().alias("row_no"), named.alias("kv"))
