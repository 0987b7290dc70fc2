"""From cells and artifact rows to recipes, results and grades: the whole check as one DAG.

Every step is a relation keyed by (address, path): which files account for all names of a
cell, which filters that gives, which file is best, which column and statistic it reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import names
from veritab.operators import align, grade, harvest, profile
from veritab.sources.staging import staged

PAIR = "array<struct<column:string,value:string>>"


def table_words(cells: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """(table_id, caption, wanted): informative words of caption, headers and citing paragraphs. paragraphs: (label, paragraph)."""
    heads = cells.groupBy("table_id").agg(F.max("caption").alias("caption"), F.array_join(F.flatten(F.collect_set("col_path")), " ").alias("heads"))
    if paragraphs is None:
        return heads.select("table_id", "caption", names.content_tokens(F.col("caption"), F.col("heads")).alias("wanted"))
    prose = paragraphs.groupBy(F.col("label").alias("table_id")).agg(F.array_join(F.collect_set("paragraph"), " ").alias("prose"))
    return heads.join(prose, "table_id", "left").select("table_id", "caption", names.content_tokens(F.col("caption"), F.col("heads"), F.col("prose")).alias("wanted"))


def name_matches(each: DataFrame, values: DataFrame, paths: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(name, path, column, value, by_file): how each name is found in each file, by value, by declared alias, by file name."""
    wanted = each.select("name").distinct()
    by_value = align.by_category(wanted, values)
    if aliases is not None:
        by_value = by_value.unionByName(align.by_alias(wanted, aliases, values).join(by_value.select("name", "path"), ["name", "path"], "left_anti"))
    named = align.by_filename(wanted, paths).withColumn("by_file", F.lit(True))
    return by_value.join(named, ["name", "path"], "full").withColumn("by_file", F.coalesce("by_file", F.lit(False)))


def plan(cells: DataFrame, rows: DataFrame, aliases: DataFrame | None = None, paragraphs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(recipes, failures) of the numeric cells that are not differences.

    cells: as extract_cells gives them. recipes are what harvest() reads; failures are (address, code, evidence).
    """
    profiled = staged(profile.profile(rows))
    values, seen = staged(align.category_values(profiled)), staged(profile.observed(rows, profiled))
    paths = profiled.select("path").distinct()
    words = staged(table_words(cells, paragraphs))
    asked = cells.where(F.col("is_numeric") & ~grade.is_last_header(F.col("col_path"))).select("address", "table_id", "uncertainty_kind", F.filter(F.concat("row_path", "col_path"), lambda n: F.trim(n) != "").alias("names"))
    asked = staged(asked.join(words, "table_id"))
    each = asked.select("address", F.explode(F.array_distinct("names")).alias("name"))
    found = staged(name_matches(each, values, paths, aliases))
    hit = each.join(found, "name")
    claimed = found.where("column is not null and not " + "name in ('" + "','".join(names.DIFFERENCE_MARKERS) + "')").select("column").distinct()

    # Names that a file knows in no way may still name one value of the rows that the others leave.
    pairs = hit.groupBy("address", "path").agg(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("column", "value"))).alias("given"))
    open_ = pairs.join(each, "address").join(hit.select("address", "path", "name"), ["address", "path", "name"], "left_anti")
    keyed = open_.select(F.to_json(F.struct("address", "name")).alias("key"), "address", "name", "path", "given")
    tried = keyed.join(seen, "path").withColumn("ok", F.forall("given", lambda g: F.exists("combination", lambda e: (e["column"] == g["column"]) & (e["value"] == g["value"]))))
    some = tried.groupBy("key", "path").agg(F.bool_or("ok").alias("some"))
    flat = tried.join(some, ["key", "path"]).where("ok or not some").select("key", "address", "name", "path", "given", F.explode("combination").alias("e"))
    flat = flat.where(~F.exists("given", lambda g: g["column"] == F.col("e.column")) & (F.col("e.value") != "") & names.partial_match(F.col("name"), F.col("e.value")))
    options = staged(flat.groupBy("key", "address", "name", "path").agg(F.array_sort(F.collect_set(F.struct("e.column", "e.value"))).alias("options")))
    resolved = options.where(F.size("options") == 1).select("address", "name", "path", F.col("options")[0]["column"].alias("column"), F.col("options")[0]["value"].alias("value"), F.lit(False).alias("by_file"))
    unclear = options.where(F.size("options") > 1).select("address", "path", "name", F.transform("options", lambda o: o["value"]).alias("several"))

    matched = hit.select("address", "name", "path", "column", "value", "by_file").unionByName(resolved)
    summed = matched.groupBy("address", "path").agg(
        F.count_if("by_file").alias("f"), F.count_if(F.col("column").isNotNull()).alias("c"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("column").isNotNull(), F.struct("column", "value")))).alias("filters"),
    )
    whole = summed.join(asked, "address").where(F.col("n") == F.size(F.array_distinct("names")))
    scored = whole.withColumn("score", align.score(F.col("f"), F.col("c"), F.col("path"), F.col("wanted"), F.array_join(F.transform("names", names.normalize), "")))

    # What the caption says about columns that no cell selects in narrows the rows too.
    scope = align.caption_filters(words, values, values.select("path", "column").distinct().join(claimed, "column", "left_semi"))
    scoped = scope.groupBy("table_id", "path").agg(F.collect_list(F.struct("column", "value")).alias("scope"))
    scored = scored.join(scoped, ["table_id", "path"], "left").withColumn("scope", F.coalesce("scope", F.array().cast(PAIR)))
    extra = F.filter("scope", lambda s: ~F.exists("filters", lambda f: f["column"] == s["column"]))
    scored = staged(scored.withColumn("filters", F.array_sort(F.concat("filters", extra))))

    mixed = align.mixed_columns(scored.select("address", "path", "filters"), profiled, claimed)
    numeric = profiled.where("is_numeric").select("path", "column")
    columns = scored.join(numeric, "path").where(~F.exists("filters", lambda f: f["column"] == F.col("column"))).select("address", "path", "column", "wanted")
    picked = align.value_column(columns).withColumnRenamed("column", "value_column")
    judged = scored.join(mixed.withColumnRenamed("columns", "mixed"), ["address", "path"], "left").join(picked, ["address", "path"], "left")
    judged = staged(judged.withColumn("answers", F.col("mixed").isNull() & F.col("value_column").isNotNull()))
    best = staged(align.choose(judged.select("address", "path", "score", "answers")))

    chosen = judged.drop("tied").join(best.where("path is not null").select("address", "path"), ["address", "path"])
    spread = F.when(F.col("uncertainty_kind") != "none", "stdev")
    recipes = staged(chosen.select("address", "path", "value_column", align.statistic(F.col("wanted")).alias("statistic"), spread.alias("uncertainty_statistic"), "filters"))

    tie = best.where("tied is not null").select("address", F.concat(F.array_join("tied", ", "), F.lit(" align to this cell equally well and each can answer it")).alias("tie"))
    vague = unclear.groupBy("address").agg(F.min_by(F.concat("path", F.lit(" aligns to this cell, but "), "name", F.lit(" matches "), F.array_join("several", ", ")), "path").alias("vague"))
    stuck = judged.groupBy("address").agg(F.min_by(F.when(F.col("mixed").isNotNull(), F.concat("path", F.lit(" would mix values of "), F.array_join("mixed", ", "))).otherwise(F.concat("path", F.lit(" has no single column for this quantity: "), F.array_join(F.coalesce("tied", F.array().cast("array<string>")), ", "))), F.struct(-F.col("score"), F.col("path"))).alias("stuck"))
    lost = asked.select("address", "names").join(recipes.select("address"), "address", "left_anti").join(tie, "address", "left").join(vague, "address", "left").join(stuck, "address", "left")
    nothing = F.concat(F.lit("nothing in the repo produces "), F.array_join("names", names.SEPARATOR))
    failures = lost.select("address", F.lit("SCRIPT_NOT_FOUND").alias("code"), F.coalesce("tie", "stuck", "vague", nothing).alias("evidence"))
    return recipes, staged(failures)


def results(cells: DataFrame, rows: DataFrame, aliases: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """(pos, address, value, uncertainty, failure, caveats) of every numeric cell: harvested, derived or failed."""
    recipes, failures = plan(cells, rows, aliases, paragraphs)
    got = staged(harvest.harvest(recipes, rows))
    none = F.array().cast("array<string>")
    failed = lambda code, why: F.when(why.isNotNull(), F.struct(code.alias("code"), why.alias("evidence")))
    direct = got.select("address", "value", "uncertainty", failed(F.lit("OTHER"), F.col("error")).alias("failure"), none.alias("caveats"))
    lost = failures.select("address", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("uncertainty"), F.struct("code", "evidence").alias("failure"), none.alias("caveats"))
    operands = grade.difference_operands(cells)
    made = harvest.differences(operands.where("minuend is not null"), got).select("address", "value", F.lit(None).cast("double").alias("uncertainty"), failed(F.lit("SCRIPT_NOT_FOUND"), F.col("error")).alias("failure"), F.array(F.lit("derived as a difference of two cells")).alias("caveats"))
    undetermined = operands.where("minuend is null").select("address", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("uncertainty"), F.struct(F.lit("SCRIPT_NOT_FOUND").alias("code"), F.lit("its row does not have exactly two other numeric cells").alias("evidence")).alias("failure"), none.alias("caveats"))
    return direct.unionByName(lost).unionByName(made).unionByName(undetermined).withColumn("pos", F.lit(1))


def check(cells: DataFrame, rows: DataFrame, aliases: DataFrame | None = None, tolerances: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """Grades of a paper's cells against what its repository's rows give."""
    cells = staged(cells)
    ordered = cells.withColumn("ord", F.struct("inline", "index", "row", "col"))
    return grade.compare(ordered, results(cells, rows, aliases, paragraphs), tolerances)


def provenance(entry: DataFrame) -> DataFrame:
    """(run, note): the distinct scripts of a run, in order. entry: (run, script)."""
    return entry.groupBy("run").agg(F.concat(F.lit("from "), F.array_join(F.array_sort(F.collect_set("script")), ", ")).alias("note"))


def size_mb(files: DataFrame) -> DataFrame:
    """(mb) of files (path, length)."""
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / (1 << 20)).alias("mb"))
