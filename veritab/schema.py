"""Data contracts: versioned, typed, and checked while reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "1.0"
#: A table cell of a paper.
CELL = (
    "address string, row_path array<string>, col_path array<string>, row int, col int, raw string, text string, is_numeric boolean, value double, uncertainty double, "
    "uncertainty_kind string, unit string, emphasis array<string>, markers array<string>"
)
TABLE = f"index int, label string, caption string, environment string, column_headers array<array<string>>, cells array<struct<{CELL.replace(' string', ':string').replace(' array', ':array').replace(' int', ':int').replace(' boolean', ':boolean').replace(' double', ':double')}>>, referencing_paragraphs array<string>"
FAILURE = "struct<code:string,evidence:string>"
#: One entry of a results file.
RESULT = f"struct<address:string,value:double,uncertainty:double,n_seeds:int,failure:{FAILURE},caveats:array<string>>"
RESULTS = f"schema_version string, run map<string,string>, cells array<{RESULT}>"

#: Failure codes and what a reader should understand them to mean.
FAILURE_CODES = {
    "MISSING_CHECKPOINT": "Model weights the table depends on are not published",
    "GATED_DATASET": "Data requires credentials, a licence, or manual approval",
    "MISSING_DEPENDENCY": "A required package or binary could not be installed",
    "UNDOCUMENTED_FLAG": "The script needs an argument the paper never specifies",
    "NONDETERMINISTIC_NO_SEED": "Run is stochastic and no seed is documented",
    "BUDGET_EXCEEDED": "Run exceeded the configured compute budget",
    "ENV_UNRESOLVABLE": "No dependency set satisfies the stated requirements",
    "SCRIPT_NOT_FOUND": "No script in the repo produces this table",
    "OTHER": "Unreproducible for a reason outside the taxonomy",
}
STATUSES = ["GREEN", "YELLOW", "RED", "UNRUNNABLE", "NOT_ATTEMPTED"]
STATISTICS = ["mean", "median", "sum", "count", "stdev"]


def checked_version(version: Column) -> Column:
    """version, or an error where it is missing or of another major."""
    major = F.split(version, r"\.")[0]
    return F.when(major == VERSION.split(".")[0], version).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version: "), F.coalesce(version, F.lit("none")))))


def checked_failure(failure: Column) -> Column:
    """failure with its code trimmed and in capitals; an error for unknown codes, and for OTHER without evidence."""
    code = F.upper(F.trim(failure["code"]))
    evidence = failure["evidence"]
    bare = (code == "OTHER") & (F.trim(F.coalesce(evidence, F.lit(""))) == "")
    good = F.when(~code.isin(list(FAILURE_CODES)), F.raise_error(F.concat(F.lit("unknown failure code: "), code))).when(bare, F.raise_error(F.lit("failure code OTHER requires evidence"))).otherwise(code)
    return F.when(failure["code"].isNotNull(), F.struct(good.alias("code"), evidence.alias("evidence")))


def described(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in FAILURE_CODES.items() for x in pair])
    return F.try_element_at(table, code)
