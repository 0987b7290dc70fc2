"""Alignment of a paper's names with files and their categories, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import names

#: Words of a caption that name a statistic, in order of precedence.
STATISTIC_WORDS = [("median", "median"), ("total", "sum"), ("sum", "sum"), ("count", "count"), ("mean", "mean"), ("average", "mean")]
#: Weights of the score of a file, and of an entry point.
BY_FILENAME, BY_CATEGORY, EXTRA = 3.0, 2.0, 0.5
WRITES, NAME_WORD, TEXT_WORD, MOST_TEXT, FLOOR = 3.0, 0.5, 0.25, 1.5, 1.0
#: Least characters of a name that is looked for inside others.
LEAST_INSIDE = 4


def category_values(profiled: DataFrame) -> DataFrame:
    """(path, column, value, norm, ord): categories as rows; ord is declaration order."""
    order = F.row_number().over(Window.partitionBy("path").orderBy("column"))
    listed = profiled.where("is_category").withColumn("c", order).select("path", "column", "c", F.posexplode("categories").alias("v", "value"))
    return listed.select("path", "column", "value", names.normalize(F.col("value")).alias("norm"), F.struct("c", "v").alias("ord"))


def by_category(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """(name, path, column, value): the first category of each file that equals the name. wanted: (name)."""
    keyed = wanted.select("name", names.normalize(F.col("name")).alias("norm")).where("norm != ''")
    hit = keyed.join(values, "norm").groupBy("name", "path").agg(F.min_by(F.struct("column", "value"), "ord").alias("m"))
    return hit.select("name", "path", "m.column", "m.value")


def by_filename(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, path) of each name that a path names.

    A whole word matches by an equi-join. Names across several words stand inside the joined words.
    """
    keyed = wanted.select("name", names.normalize(F.col("name")).alias("norm")).where("norm != ''")
    words = paths.select("path", F.explode(F.array_distinct(F.transform(names.content_tokens(F.col("path")), names.normalize))).alias("norm"))
    whole = words.join(keyed, "norm").select("name", "path")
    joined = paths.select("path", F.array_join(F.array_sort(names.content_tokens(F.col("path"))), "").alias("text"))
    inside = contained(keyed.select("norm"), joined.select("text"), LEAST_INSIDE).join(joined, "text").join(keyed, "norm")
    return whole.union(inside.select("name", "path")).distinct()


def contained(needles: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(norm, text): the needles (norm) of at least n characters that stand inside texts (text), each pair once.

    The stretches of n characters of all distinct texts are counted first. A needle that has one which no text has is nowhere; the others
    are looked up by their rarest one alone and then compared whole. So what many needles and texts
    have in common brings none of them together.
    """
    held = texts.where(F.length("text") >= n).select("text").distinct().select("text", F.explode(grams(F.col("text"), n)).alias("gram"))
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    parts = needles.where(F.length("norm") >= n).select("norm").distinct().select("norm", F.explode(grams(F.col("norm"), n)).alias("gram"))
    found = parts.join(counts, "gram", "left").groupBy("norm").agg(F.min_by("gram", F.struct("held", "gram")).alias("gram"), F.count_if(F.col("held").isNull()).alias("absent"))
    met = found.where("absent = 0").select("norm", "gram").join(held, "gram")
    return met.where(F.contains("text", F.col("norm"))).select("norm", "text")


def grams(text: Column, n: int) -> Column:
    """The distinct stretches of n characters; none of a shorter text."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda p: F.substring(text, p, F.lit(n)))
    return F.filter(F.array_distinct(every), lambda g: F.length(g) == n)


def by_alias(wanted: DataFrame, aliases: DataFrame, values: DataFrame) -> DataFrame:
    """by_category through declared equivalences, in both directions. aliases: (left, right, path, line)."""
    both = aliases.select("left", "right").union(aliases.select(F.col("right"), F.col("left")))
    other = both.select(names.normalize(F.col("left")).alias("norm"), F.col("right").alias("other")).where(names.normalize(F.col("right")) != F.col("norm"))
    keyed = wanted.select("name", names.normalize(F.col("name")).alias("norm"))
    bridged = keyed.join(other, "norm").select("name", names.normalize(F.col("other")).alias("norm"))
    hit = bridged.join(values, "norm").groupBy("name", "path").agg(F.min_by(F.struct("column", "value"), "ord").alias("m"))
    return hit.select("name", "path", "m.column", "m.value")


def candidates(deferred: DataFrame, combinations: DataFrame) -> DataFrame:
    """(name, path, column, value): values that a name names in part, in rows consistent with what is given.

    deferred: (name, path, given array<struct<column, value>>). If no observed combination is
    consistent, all of them count. Columns already given are left out.
    """
    joined = deferred.join(combinations, "path")
    ok = F.forall("given", lambda g: F.exists("combination", lambda e: (e["column"] == g["column"]) & (e["value"] == g["value"])))
    joined = joined.withColumn("ok", ok)
    some = joined.groupBy("name", "path").agg(F.bool_or("ok").alias("some"))
    rows = joined.join(some, ["name", "path"]).where("ok or not some")
    flat = rows.select("name", "path", "given", F.explode("combination").alias("e"))
    free = ~F.exists("given", lambda g: g["column"] == F.col("e.column"))
    return flat.where(free & (F.col("e.value") != "") & names.partial_match(F.col("name"), F.col("e.value"))).select("name", "path", "e.column", "e.value").distinct()


def score(by_file: Column, by_cat: Column, path: Column, wanted: Column, address_norm: Column) -> Column:
    """Of a file for a cell: names its path has, names its categories have, words shared with the table, less words nothing explains."""
    words = names.content_tokens(path)
    extra = F.filter(F.array_except(words, wanted), lambda t: ~F.contains(address_norm, names.normalize(t)))
    return BY_FILENAME * by_file + BY_CATEGORY * by_cat + F.size(F.array_intersect(words, wanted)) - EXTRA * F.size(extra)


def score_files(cells: DataFrame, category: DataFrame, filename: DataFrame, paths: DataFrame) -> DataFrame:
    """(address, path, score, filters) of each file that accounts for every name of a cell. cells: (address, names, wanted)."""
    each = cells.select("address", F.explode("names").alias("name"))
    need = each.distinct().groupBy("address").agg(F.count(F.lit(1)).alias("need"))
    found = category.withColumn("c", F.lit(1)).join(filename.withColumn("f", F.lit(1)), ["name", "path"], "full")
    matched = each.distinct().join(found, "name").groupBy("address", "path").agg(
        F.count_if(F.col("f") == 1).alias("f"), F.count_if(F.col("c") == 1).alias("c"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("c") == 1, F.struct("column", "value")))).alias("filters"),
    )
    full = matched.join(need, "address").where("n = need").join(cells.select("address", "names", "wanted"), "address")
    norm = F.array_join(F.transform("names", names.normalize), "")
    return full.select("address", "path", score(F.col("f"), F.col("c"), F.col("path"), F.col("wanted"), norm).alias("score"), "filters")


def choose(scored: DataFrame) -> DataFrame:
    """(address, path, tied) : the best file that can answer a cell; null with the tied paths if several at the top can.

    scored: (address, path, score, answers). A tie at the top is refused only between files that answer;
    if one of the tied answers alone, it is taken before any lower file.
    """
    best = F.max("score").over(Window.partitionBy("address"))
    top = scored.withColumn("top", F.col("score") == best).where("answers")
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("address").orderBy(F.desc("score"), "path")))
    out = ranked.groupBy("address").agg(F.array_sort(F.collect_list(F.when(F.col("top"), F.col("path")))).alias("tops"), F.min_by("path", "rank").alias("first"))
    return out.select("address", F.when(F.size("tops") <= 1, F.col("first")).alias("path"), F.when(F.size("tops") > 1, F.col("tops")).alias("tied"))


def value_column(columns: DataFrame) -> DataFrame:
    """(address, path, column, tied): the numeric column that shares most words with the table; null where none or several do.

    columns: (address, path, column, wanted), filtered ones left out.
    """
    overlap = F.size(F.array_intersect(names.expand_synonyms(names.content_tokens(F.col("column"))), names.expand_synonyms(F.col("wanted"))))
    scored = columns.withColumn("overlap", overlap)
    best = F.max("overlap").over(Window.partitionBy("address", "path"))
    tied = F.array_sort(F.collect_list(F.when((F.col("overlap") == F.col("best")) & (F.col("best") > 0), F.col("column"))))
    out = scored.withColumn("best", best).groupBy("address", "path").agg(tied.alias("tied"))
    return out.select("address", "path", F.when(F.size("tied") == 1, F.col("tied")[0]).alias("column"), "tied")


def statistic(wanted: Column) -> Column:
    """The statistic that a table's words name; the mean if none does."""
    out = F.lit("mean")
    for word, name in reversed(STATISTIC_WORDS):
        out = F.when(F.array_contains(wanted, word), name).otherwise(out)
    return out


def caption_filters(tables: DataFrame, values: DataFrame, used: DataFrame) -> DataFrame:
    """(table_id, path, column, value): a column that no cell selects in, with exactly one value in the caption.

    tables: (table_id, caption); used: (path, column) already filtered or claimed.
    """
    said = tables.select("table_id", F.explode(names.phrases(F.col("caption"))).alias("norm"))
    free = values.join(used, ["path", "column"], "left_anti")
    hit = said.join(free, "norm").groupBy("table_id", "path", "column").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"))
    return hit.where("n = 1").select("table_id", "path", "column", "value")


def mixed_columns(chosen: DataFrame, profiled: DataFrame, claimed: DataFrame) -> DataFrame:
    """(address, path, columns): categories that other cells select in and this one doesn't; an aggregate over them would mix values.

    chosen: (address, path, filters); claimed: (column).
    """
    several = profiled.where("is_category and size(categories) > 1").join(claimed.distinct(), "column", "left_semi").select("path", "column")
    open_ = chosen.join(several, "path").where(~F.exists("filters", lambda f: f["column"] == F.col("column")))
    return open_.groupBy("address", "path").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def missing_checkpoint(cells: DataFrame, enumerations: DataFrame, values: DataFrame) -> DataFrame:
    """(address, name, script): names that an enumeration of models lacks while it has a sibling of theirs, and that no data has.

    cells: (table_id, address, level, name); enumerations: (script, model).
    """
    label = cells.select("table_id", "level", "name").distinct().withColumn("norm", names.normalize(F.col("name")))
    model = enumerations.select("script", names.normalize(F.col("model")).alias("model_norm")).distinct()
    n = names.LEAST_CONTAINED
    # A name stands inside a model's, or the other way round.
    shown = contained(model.select(F.col("model_norm").alias("norm")), label.select(F.col("norm").alias("text")), n).select(F.col("text").alias("norm"), F.col("norm").alias("model_norm"))
    hidden = contained(label.select("norm"), model.select(F.col("model_norm").alias("text")), n).select("norm", F.col("text").alias("model_norm"))
    both = shown.union(hidden).distinct().join(model, "model_norm").select("norm", "script").distinct()
    listed = label.join(both, "norm")
    # Labels whose group has a sibling in the script's list, without those that the list has itself.
    siblings = listed.select("table_id", "level", "script").distinct().join(label, ["table_id", "level"])
    absent = siblings.join(listed.select("table_id", "level", "name", "script"), ["table_id", "level", "name", "script"], "left_anti")
    absent = absent.join(values.select("norm").distinct(), "norm", "left_anti")
    first = absent.groupBy("table_id", "level", "name").agg(F.min("script").alias("script"))
    return cells.join(first, ["table_id", "level", "name"]).select("address", "name", "script")


def rank_entry_points(scripts: DataFrame, written: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table_id, script, score, rank): scripts by how plausibly they produce a table.

    scripts: (script, text); written: (script, artifact, table_id) that the table needs; wanted: (table_id, wanted).
    """
    writes = written.distinct().groupBy("table_id", "script").agg(F.count(F.lit(1)).alias("files"))
    words = scripts.select("script", F.explode(names.content_tokens(F.col("script"))).alias("word"), F.lit("name").alias("where_"))
    words = words.union(scripts.select("script", F.explode(names.content_tokens(F.col("text"))).alias("word"), F.lit("text").alias("where_")))
    shared = words.join(wanted.select("table_id", F.explode("wanted").alias("word")).distinct(), "word").groupBy("table_id", "script").agg(
        F.count_if(F.col("where_") == "name").alias("in_name"), F.count_if(F.col("where_") == "text").alias("in_text")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = WRITES * zero("files") + NAME_WORD * zero("in_name") + F.least(TEXT_WORD * zero("in_text"), F.lit(MOST_TEXT))
    out = writes.join(shared, ["table_id", "script"], "full").select("table_id", "script", F.round(total, 3).alias("score")).where(F.col("score") >= FLOOR)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc("score"), "script")))


def shown(items: Column, most: int) -> Column:
    """The first items, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))
