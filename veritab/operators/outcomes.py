"""What became of a table's run: why a run failed, what blocks it first, and which cells may still be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a failed run prints, and the code that it tells.
NO_MODULE = r"""No module named ['"]([\w.]+)['"]"""
GATED = ["GatedRepoError", "is a gated repo", "Access to model", "401 Client Error", "403 Client Error", "authentication", "You must be authenticated"]
UNPUBLISHED = ["RepositoryNotFoundError", "Repository Not Found", "does not appear to have a file named", "is not a local folder and is not a valid model identifier"]
ARGUMENT = r"((?:the following arguments are required|unrecognized arguments|expected one argument)[:\s]*[^\n]*)"
FAILURE = "struct<code:string,evidence:string>"


def tail(stderr: Column, stdout: Column, n: int) -> Column:
    """The last n lines of what a run printed, of its errors if there are any."""
    lines = F.split(F.btrim(F.when(F.length(stderr) > 0, stderr).otherwise(stdout), F.lit(" \t\r\n")), r"\r?\n")
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - n + 1), F.lit(n)), "\n")


def described(kind: Column, path: Column, pinned: Column) -> Column:
    """How evidence names a requirement file; kind is null where a repository has none."""
    known = F.concat(path, F.lit(" ("), pinned.cast("string"), F.lit(" pinned distributions)"))
    return F.when(kind.isNull(), "no requirements.txt, pyproject.toml, or environment.yml").otherwise(known)


def classify(runs: DataFrame) -> DataFrame:
    """(run, code, evidence) of each failed run, by the most specific reason that its output gives.

    runs: (run, script, returncode, stdout, stderr, source); source is how evidence names the requirements. Null output is empty.
    """
    err, out = F.coalesce("stderr", F.lit("")), F.coalesce("stdout", F.lit(""))
    output = F.concat(err, F.lit("\n"), out)
    ended = F.concat("script", F.lit(" exited "), F.col("returncode").cast("string"))
    module, argument = F.regexp_extract(output, NO_MODULE, 1), F.btrim(F.regexp_extract(output, ARGUMENT, 1))
    found = lambda marks: F.coalesce(*[F.when(F.contains(output, F.lit(m)), m) for m in marks])
    gated, unpublished = found(GATED), found(UNPUBLISHED)
    last = tail(err, out, 6)
    reason = lambda code, *parts: F.struct(F.lit(code).alias("code"), F.concat(ended, *[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("evidence"))
    why = (
        F.when(module != "", reason("MISSING_DEPENDENCY", " with ModuleNotFoundError: No module named '", module, "'; ", F.col("source"), " does not provide it"))
        .when(gated.isNotNull(), reason("GATED_DATASET", " on an access-controlled resource (", gated, "): ", tail(err, out, 4)))
        .when(unpublished.isNotNull(), reason("MISSING_CHECKPOINT", " because the checkpoint it needs is not published (", unpublished, "): ", tail(err, out, 4)))
        .when(argument != "", reason("UNDOCUMENTED_FLAG", " needing an argument the paper never specifies: ", argument))
        .otherwise(reason("OTHER", "; last output was: ", F.when(last != "", last).otherwise("(silent)")))
    )
    return runs.where("returncode != 0").select("run", why.alias("why")).select("run", "why.code", "why.evidence")


def missing_dependencies(undeclared: DataFrame, lines: DataFrame, source: Column) -> DataFrame:
    """(script, evidence): the first undeclared import of each script, the line that runs it, and the other modules.

    undeclared: (script, module, line); lines: (script, line, source), numbered from one. source is how evidence names the requirements.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line", "module")))
    listed = undeclared.groupBy("script").agg(ordered.alias("missing")).select("script", F.col("missing")[0]["line"].alias("line"), F.transform("missing", lambda m: m["module"]).alias("modules"))
    at = listed.join(lines.select("script", "line", F.trim("source").alias("shown")), ["script", "line"], "left")
    others = F.when(F.size("modules") > 1, F.concat(F.lit(" (also "), F.array_join(F.slice("modules", 2, F.size("modules")), ", "), F.lit(")"))).otherwise("")
    evidence = F.concat("script", F.lit(":"), F.col("line").cast("string"), F.lit(" runs `"), F.coalesce("shown", F.lit("")), F.lit("`, but '"), F.col("modules")[0], F.lit("' is not provided by "), source, others)
    return at.select("script", evidence.alias("evidence"))


def first_blockers(blockers: DataFrame) -> DataFrame:
    """(table_id, blocker): the first reason that stopped each table's run. blockers: (table_id, ord, code, evidence)."""
    return blockers.groupBy("table_id").agg(F.min_by(F.struct("code", "evidence"), F.struct("ord", "code", "evidence")).alias("blocker"))


def readable(recipes: DataFrame, files: DataFrame, runs: DataFrame, blockers: DataFrame, allow_committed: bool = True) -> DataFrame:
    """(address, path, failure, provenance) of each recipe: what keeps its file from being read, or where the file comes from.

    recipes: (address, table_id, path); files: (path), those that exist after the runs; runs: (table_id, script,
    executed); blockers as for first_blockers. A file that was never written, or one that no run wrote anew where
    committed copies don't count, takes the reason of the table's first blocker.
    """
    there = files.select("path", F.lit(True).alias("there")).distinct()
    full = recipes.join(there, "path", "left").join(runs, "table_id", "left").join(first_blockers(blockers), "table_id", "left")
    ran = F.coalesce("executed", F.lit(False))
    why = F.when(F.col("there").isNull(), "was never written")
    if not allow_committed:
        why = why.when(~ran, "was not re-run, and --no-committed-artifacts forbids reading the copy committed to the repo")
    silent = F.concat("path", F.lit(" "), why, F.lit(", and "), F.coalesce("script", F.lit("the entry point")), F.lit(" reported no reason"))
    told = F.concat("path", F.lit(" "), why, F.lit(": "), F.col("blocker.evidence"))
    blocked = F.struct(F.coalesce("blocker.code", F.lit("OTHER")).alias("code"), F.coalesce(told, silent).alias("evidence"))
    failure = F.when(why.isNotNull(), blocked).cast(FAILURE)
    return full.select("address", "path", failure.alias("failure"), F.when(failure.isNull(), F.when(ran, "executed").otherwise("committed")).alias("provenance"))


def derived_failures(derived: DataFrame, valued: DataFrame, blockers: DataFrame) -> DataFrame:
    """(address, failure) of differences that lack an operand's value. derived: (address, table_id, minuend, subtrahend); valued: (address)."""
    have = valued.select(F.col("address").alias("operand"), F.lit(True).alias("has")).distinct()
    each = derived.select("address", "table_id", F.posexplode(F.array("minuend", "subtrahend")).alias("place", "operand"), F.concat("minuend", F.lit(" - "), "subtrahend").alias("formula"))
    lost = each.join(have, "operand", "left").where("has is null").groupBy("address", "table_id", "formula")
    lost = lost.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "operand"))), lambda x: x["operand"]), ", ").alias("missing"))
    full = lost.join(first_blockers(blockers), "table_id", "left")
    evidence = F.concat(F.lit("derived as "), "formula", F.lit(", and "), "missing", F.lit(" produced no value"), F.coalesce(F.concat(F.lit(": "), F.col("blocker.evidence")), F.lit("")))
    return full.select("address", F.struct(F.coalesce("blocker.code", F.lit("OTHER")).alias("code"), evidence.alias("evidence")).alias("failure"))
