r"""Sources of many files as one document: the closure of ``\input`` and ``\include`` over papers, in Spark.

A file's text is cut at its commands into pieces. Targets meet files by an equi-join on names, then the closure grows a level at a time:
a place in the document is the list of commands that lead to it, and each target stays at the least place found so far. A target
is improved only by what its new place leads to, so rounds end, cycles too; links and places are all that a round
moves, texts move once, to where they stand.

A command whose file is missing, that has no argument, or whose target stands at an earlier place gives nothing. In a file its inputs come
before its includes, whatever their order on the page. A target is told apart by its name as written, so ``a`` and ``a.tex`` may
bring one file twice, and the main file again if something names it. Null texts are empty; files of equal path in a paper are one, with the least text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import latex
from veritab.sources.staging import staged

#: Commands in the order in which a file's are followed.
COMMANDS = ["input", "include"]
_COMMAND = re.compile(r"\\(" + "|".join(COMMANDS) + r")(?![a-zA-Z])\*?")
_ORDER = "array<struct<kind:int,at:int>>"


def _commands(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, kind, target) of a text's commands by place; none inside another's argument."""
    at = 0
    while m := _COMMAND.search(text, at):
        (target,), at = latex.arguments(text, m.end(), 1)
        yield m.start(), at, COMMANDS.index(m[1]), latex.flatten(target)


def links(files: DataFrame) -> DataFrame:
    """(paper_id, path, kind, at, target): what each file of files (paper_id, path, text) asks for; at numbers its commands."""
    some = F.col("text").rlike(r"\\(?:" + "|".join(COMMANDS) + r")(?![a-zA-Z])")

    def run(batches):
        for b in batches:
            rows = []
            for paper, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = enumerate(_commands(latex.strip_comments(text)))
                rows += [(paper, path, kind, at, target) for at, (_, _, kind, target) in found if target]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["paper_id", "path", "kind", "at", "target"])

    return files.where(some).select("paper_id", "path", "text").mapInArrow(run, f"paper_id {_kind(files)}, path string, kind int, at int, target string")


def pieces(files: DataFrame) -> DataFrame:
    """(paper_id, path, at, piece): each file's text between its commands; the piece before command at has its number."""

    def run(batches):
        for b in batches:
            rows = []
            for paper, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, begun = latex.strip_comments(text or ""), 0
                for at, (start, end, *_) in enumerate(_commands(text)):
                    rows.append((paper, path, 2 * at, text[begun:start]))
                    begun = end
                rows.append((paper, path, 1 << 30, text[begun:]))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            types = [b.schema.field(0).type, pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["paper_id", "path", "at", "piece"])

    return files.select("paper_id", "path", "text").mapInArrow(run, f"paper_id {_kind(files)}, path string, at int, piece string")


def _kind(files: DataFrame) -> str:
    return files.schema["paper_id"].dataType.simpleString()


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def resolved(asked: DataFrame, files: DataFrame) -> DataFrame:
    """asked (paper_id, target, …) with ``into``, the path of the file that a target names; targets without one go.

    The name itself wins, then with .tex, then with .ltx, then the first file in a folder whose last part is the target's, with or without .tex.
    """
    suffix, path, last = F.regexp_extract("path", r"(\.tex|\.ltx)$", 1), F.col("path"), _last(F.col("path"))
    cut = lambda x, n: F.expr(f"left({x}, length({x}) - {n})")
    name = lambda whole, text, rank: F.struct(F.lit(whole).alias("whole"), text.alias("name"), F.lit(rank).alias("rank"))
    known = files.select("paper_id", "path").distinct().withColumn("last", last)
    in_folder = F.contains(path, F.lit("/"))
    bare = F.when(suffix == ".tex", name(True, cut("path", 4), 1)).when(suffix == ".ltx", name(True, cut("path", 4), 2))
    tail = F.when(in_folder, name(False, F.col("last"), 3))
    bare_tail = F.when(in_folder & (suffix == ".tex"), name(False, cut("last", 4), 3))
    names = known.select("paper_id", "path", F.explode(F.array_compact(F.array(name(True, path, 0), bare, tail, bare_tail))).alias("n")).select("paper_id", "path", "n.*")
    wanted = asked.select("paper_id", "target").distinct()
    wanted = wanted.select("paper_id", "target", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.col("target").alias("name")), F.struct(F.lit(False).alias("whole"), _last(F.col("target")).alias("name")))).alias("n"))
    met = wanted.select("paper_id", "target", "n.*").join(names, ["paper_id", "whole", "name"]).groupBy("paper_id", "target").agg(F.min(F.struct("rank", "path"))["path"].alias("into"))
    return asked.join(met, ["paper_id", "target"])


def closure(mains: DataFrame, asked: DataFrame) -> DataFrame:
    """(paper_id, target, path, place) of each file's place: of mains (paper_id, main), target null, and of what is reached from it.

    asked: (paper_id, path, kind, at, target, into). place: the commands that lead there; the least in lexicographic order, prefixes first, is
    the one that reading the document from its beginning comes to first.
    """
    asked = staged(asked, "links")
    state = staged(mains.select("paper_id", F.lit(None).cast("string").alias("target"), F.col("main").alias("path"), F.array().cast(_ORDER).alias("place"), F.lit(True).alias("fresh")), "places")
    while not state.where("fresh").isEmpty():
        step = F.concat("s.place", F.array(F.struct(F.col("a.kind").alias("kind"), F.col("a.at").alias("at"))))
        new = state.where("fresh").alias("s").join(asked.alias("a"), ["paper_id", "path"]).select("paper_id", F.col("a.target").alias("target"), F.col("a.into").alias("path"), step.cast(_ORDER).alias("place"), F.lit(True).alias("fresh"))
        best = state.withColumn("fresh", F.lit(False)).unionByName(new).groupBy("paper_id", "target").agg(F.min(F.struct("place", "fresh", "path")).alias("best"))
        state = staged(best.select("paper_id", "target", "best.path", "best.place", "best.fresh"), "places")
    return state.drop("fresh")


def documents(files: DataFrame, mains: DataFrame) -> DataFrame:
    """(paper_id, text): the main file of each paper with what it asks for in place, each target once."""
    files = files.groupBy("paper_id", "path").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    places = closure(mains, resolved(links(files), files))
    where = F.transform("place", lambda c: 2 * c["at"] + 1)
    parts = places.select("paper_id", "path", where.alias("where")).join(pieces(files), ["paper_id", "path"])
    ordered = F.array_sort(F.collect_list(F.struct(F.concat("where", F.array("at")).alias("where"), "piece")))
    return parts.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text"))
