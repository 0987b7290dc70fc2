"""Typing of a table cell from its markup and its plain text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the notation.
NUMBER = r"[-+−]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
SCIENTIFIC = r"([-+−]?\d+(?:\.\d+)?)\s*\\(?:cdot|times)\s*10\s*\^\s*\{?\s*(-?\d+)\s*\}?"
SUBSCRIPT = rf"({NUMBER})\s*_\s*\{{\s*({NUMBER})\s*\}}"
#: A number, or one with a spread after ± or in parentheses.
WHOLE = rf"^({NUMBER})(?:\s*(±)\s*({NUMBER})|\s*(\()\s*({NUMBER})\s*\))?$"
COMPARATORS = ["<=", ">=", "≤", "≥", "<", ">", "≈", "~"]
MARKERS = "*∗†‡§¶"
NOT_NUMBERS = ["", "-", "--", "–", "—", "n/a", "na", "n.a.", "nan", "none", "?"]
#: The struct that parse_cell returns.
PARSED = "struct<is_numeric:boolean,value:double,uncertainty:double,uncertainty_kind:string,unit:string,markers:array<string>>"


def _double(text: Column) -> Column:
    return F.translate(text, "−", "-").try_cast("double")


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is named."""
    return F.transform(F.array(value), then)[0]


def _unit(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("×")), "times").when(F.contains(text, F.lit("%")), "percent").otherwise("none")


def _lead(core: Column) -> Column:
    """The comparator that a text without its unit begins with."""
    return F.regexp_extract(core, r"^\s*(<=|>=|[≤≥<>≈~])", 1)


def _led(core: Column, lead: Column) -> Column:
    return F.when(lead != "", F.regexp_replace(core, r"^\s*(?:<=|>=|[≤≥<>≈~])", "")).otherwise(core)


def _trail(core: Column) -> Column:
    """The footnote markers at the end; the pattern is tried where a text holds one at all."""
    marked = F.translate(core, MARKERS, "") != core
    return F.when(marked, F.regexp_extract(core, rf"((?:\s*[{MARKERS}])*)\s*$", 1)).otherwise("")


def _bare(core: Column, trail: Column) -> Column:
    return F.when(trail != "", F.regexp_replace(core, rf"(?:\s*[{MARKERS}])*\s*$", "")).otherwise(core)


def _core(bare: Column) -> Column:
    """Without commas that part thousands, white space in one."""
    digits = F.when(F.contains(bare, F.lit(",")) & F.trim(bare).rlike(r"^[\d,]+(?:\.\d+)?$"), F.translate(bare, ",", "")).otherwise(bare)
    return F.trim(F.regexp_replace(digits, r"\s+", " "))


def _form(raw: Column, core: Column) -> Column:
    """Which form a cell has; a pattern of raw is tried where its sign stands."""
    has = lambda sign, pattern: F.contains(raw, F.lit(sign)) & raw.rlike(pattern)
    return F.when(has("\\", SCIENTIFIC), "power").when(F.lower(core).isin(NOT_NUMBERS), "blank").when(has("_", SUBSCRIPT), "subscript").when(core.rlike(WHOLE), "whole").otherwise("words")


def _numbers(raw: Column, core: Column, form: Column) -> Column:
    """The texts of a form's two numbers and the sign between them."""
    both = lambda pattern: F.array(F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2))
    return F.when(form == "whole", F.split(F.regexp_replace(core, WHOLE, "$1|$3$5|$2$4"), r"\|")).when(form == "power", both(SCIENTIFIC)).when(form == "subscript", both(SUBSCRIPT))


def _typed(form: Column, found: Column, unit: Column, lead: Column, trail: Column) -> Column:
    """PARSED; every conversion stands once: repeated in each form's branch they take three times as long."""
    second, sign = F.get(found, F.lit(1)), F.get(found, F.lit(2))
    value = _double(F.get(found, F.lit(0))) * F.when(form == "power", F.pow(F.lit(10.0), second.try_cast("int"))).otherwise(1.0)
    kind = F.when(form == "subscript", "subscript").when(sign == "±", "pm").when(sign == "(", "paren").otherwise("none")
    each = F.when(trail != "", F.split(F.regexp_replace(trail, r"\s+", ""), "")).otherwise(F.array().cast("array<string>"))
    markers = F.when(form == "power", F.array().cast("array<string>")).otherwise(F.array_remove(F.concat(each, F.array(lead)), ""))
    return F.struct(
        value.isNotNull().alias("is_numeric"), value.alias("value"), F.when(form != "power", F.abs(_double(second))).alias("uncertainty"), kind.alias("uncertainty_kind"),
        F.when(form.isin("subscript", "whole"), unit).otherwise("none").alias("unit"), markers.alias("markers"),
    ).cast(PARSED)


def parse_cell(raw: Column, text: Column) -> Column:
    """PARSED of a cell; raw is its markup, text what flatten() makes of it.

    Powers of ten and subscripts are looked for in raw, where the braces still stand; the
    other forms must fill the text once unit, comparator and markers are off. As one expression its steps are interpreted: over
    a whole table ``parse_cells`` is faster.
    """

    def typed(lead: Column, trail: Column, core: Column) -> Column:
        return _let(_form(raw, core), lambda form: _typed(form, _numbers(raw, core, form), _unit(text), lead, trail))

    def ended(lead: Column, core: Column) -> Column:
        return _let(_trail(core), lambda trail: _let(_core(_bare(core, trail)), lambda c: typed(lead, trail, c)))

    return _let(F.translate(text, "%×", ""), lambda core: _let(_lead(core), lambda lead: _let(_led(core, lead), lambda c: ended(lead, c))))


def parse_cells(cells: DataFrame, name: str = "parsed") -> DataFrame:
    """cells (raw, text, …) with PARSED of each: a column for each step, so that every step is compiled and worked out once."""
    c = lambda step: F.col(f"__{step}")
    steps = [
        ("text", F.translate("text", "%×", "")), ("lead", _lead(c("text"))), ("led", _led(c("text"), c("lead"))), ("trail", _trail(c("led"))), ("core", _core(_bare(c("led"), c("trail")))),
        ("form", _form(F.col("raw"), c("core"))), ("found", _numbers(F.col("raw"), c("core"), c("form"))),
    ]
    for step, value in steps:
        cells = cells.withColumn(f"__{step}", value)
    return cells.withColumn(name, _typed(c("form"), c("found"), _unit(F.col("text")), c("lead"), c("trail"))).drop(*(f"__{step}" for step, _ in steps))
