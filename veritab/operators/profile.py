"""Profiling of all-text tables: numeric columns, categories, observed combinations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.scalars import to_number

#: Distinct values above which a column is data, and combinations that are kept.
MOST_VALUES, MOST_COMBINATIONS = 64, 2001
#: Columns that a task holds values of before it gives them on.
HELD_COLUMNS = 4096


def unpivot(rows: DataFrame) -> DataFrame:
    """(path, row_no, column, value) of every non-blank value of artifact rows, trimmed."""
    out = rows.select("path", "row_no", F.explode("kv").alias("column", "value"))
    return out.select("path", "row_no", "column", F.trim("value").alias("value")).where("value != ''")


def bounded_values(values: DataFrame, most: int = MOST_VALUES) -> DataFrame:
    """(path, column, value, first, number): the distinct values that each task sees of a column, with their first row, while they are at most ``most``.

    values: (path, row_no, column, value). A task that sees more gives one row without value for them all, so a column of unique values
    sends no text on. number: whether all that the task saw of the column are numbers. A column has more than ``most`` values just where
    a row without value or more than ``most`` different ones come back.
    """

    def rows_of(held: dict) -> pa.RecordBatch:
        rows = [(*key, value, first, number) for key, (own, number) in held.items() for value, first in (own or {None: None}).items()]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.string()] * 3, pa.int64(), pa.bool_()], strict=True)], ["path", "column", "value", "first", "number"])

    def run(batches):
        held: dict[tuple[str, str], tuple[dict[str, int] | None, bool]] = {}
        for batch in batches:
            once = pa.Table.from_batches([batch]).group_by(["path", "column", "value"]).aggregate([("row_no", "min"), ("number", "all")])
            for path, column, value, first, number in zip(*(once[c].to_pylist() for c in ("path", "column", "value", "row_no_min", "number_all")), strict=True):
                own, so_far = held.get((path, column), ({}, True))
                if own is not None:
                    own[value] = min(first, own.get(value, first))
                    own = own if len(own) <= most else None
                held[path, column] = own, so_far and number
            if len(held) > HELD_COLUMNS:
                yield rows_of(held)
                held = {}
        yield rows_of(held)

    typed = values.select("path", "column", "value", F.col("row_no").cast("long").alias("row_no"), to_number(F.col("value")).isNotNull().alias("number"))
    return typed.mapInArrow(run, "path string, column string, value string, first long, number boolean")


def profile(rows: DataFrame) -> DataFrame:
    """(path, column, n_values, is_numeric, is_category, categories): one row for each column.

    categories are in the order of their first row. Values are followed up to MOST_VALUES in each task and in all, so
    n_values is MOST_VALUES + 1 for every column that has more; ``distinct_counts`` has exact numbers.
    """
    columns = rows.select("path", F.explode(F.map_keys("kv")).alias("column")).distinct()
    values = bounded_values(unpivot(rows)).groupBy("path", "column", "value").agg(F.min("first").alias("first"), F.bool_and("number").alias("number"))
    found = F.when(F.bool_or(F.col("value").isNull()), MOST_VALUES + 1).otherwise(F.least(F.count("value"), F.lit(MOST_VALUES + 1)))
    stats = values.groupBy("path", "column").agg(found.alias("n_values"), F.bool_and("number").alias("is_numeric"))
    stats = columns.join(stats, ["path", "column"], "left").select("path", "column", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("is_numeric", F.lit(True)).alias("is_numeric"))
    stats = stats.withColumn("is_category", ~F.col("is_numeric") & F.col("n_values").between(1, MOST_VALUES))
    kept = values.join(stats.where("is_category").select("path", "column"), ["path", "column"], "left_semi")
    listed = kept.groupBy("path", "column").agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("listed"))
    return stats.join(listed.select("path", "column", F.transform("listed", lambda x: x["value"]).alias("categories")), ["path", "column"], "left")


def distinct_counts(rows: DataFrame) -> DataFrame:
    """(path, column, n_values): exact numbers of distinct values; columns of blanks have no row."""
    return unpivot(rows).groupBy("path", "column").agg(F.count_distinct("value").alias("n_values"))


def row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))


def first_seen(keys: DataFrame, most: int) -> DataFrame:
    """(path, row_no, a, b): for each path at least the ``most`` keys (a, b) whose first row is least, with that row.

    keys: (path, row_no, a, b). Each task holds a bounded number of keys for a path and lets those go that ``most`` others precede, so what
    is shuffled doesn't grow with the rows. The order of rows in a task doesn't matter: a key that was let go comes back with an earlier row.
    """

    def pruned(held: dict) -> dict:
        return dict(sorted(held.items(), key=lambda item: item[1])[:most])

    def run(batches):
        held: dict[str, dict[tuple[int, int], int]] = {}
        for batch in batches:
            for path, row, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(path, {})
                if row < own.get(tuple(key), row + 1):
                    own[tuple(key)] = row
                    if len(own) > 4 * most:
                        held[path] = pruned(own)
        for path, own in held.items():
            rows = list(pruned(own).items())
            columns = [[path] * len(rows), [r for _, r in rows], [k[0] for k, _ in rows], [k[1] for k, _ in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["path", "row_no", "a", "b"])

    partial = keys.select("path", "row_no", "a", "b").mapInArrow(run, "path string, row_no long, a long, b long")
    return partial.groupBy("path", "a", "b").agg(F.min("row_no").alias("row_no"))


def observed(rows: DataFrame, profiled: DataFrame) -> DataFrame:
    """(path, rank, combination): combinations of non-numeric values in order of their first row, projected to categories.

    The number kept for each path is a feature: it bounds what names are resolved against. Combinations are told apart by
    two 64-bit hashes, and only first rows are read again for their values, so no row's text is shuffled.
    """
    entries = F.filter(F.map_entries("kv"), lambda e: (F.trim(F.coalesce(e["value"], F.lit(""))) == "") | to_number(e["value"]).isNull())
    key = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("column"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value"))))
    keyed = rows.select("path", F.col("row_no").cast("long").alias("row_no"), key.alias("key"))
    seen = first_seen(keyed.select("path", "row_no", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")), MOST_COMBINATIONS)
    rank = F.row_number().over(Window.partitionBy("path").orderBy("row_no"))
    seen = seen.withColumn("rank", rank).where(F.col("rank") <= MOST_COMBINATIONS).select("path", "row_no", "rank")
    categories = profiled.where("is_category").groupBy("path").agg(F.collect_set("column").alias("columns"))
    found = keyed.join(seen, ["path", "row_no"]).join(categories, "path")
    return found.select("path", "rank", F.filter("key", lambda e: F.array_contains("columns", e["column"])).alias("combination"))


def largest_input(rows: DataFrame) -> DataFrame:
    """(n_rows) of the largest path; zero if there is none."""
    return row_counts(rows).agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"))
