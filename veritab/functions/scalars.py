"""Numeric and formatting functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Absolute tolerance below each magnitude of the published value.
ABSOLUTE_STEPS = [(1.0, 0.01), (10.0, 0.05), (100.0, 0.5)]
ABSOLUTE_ELSE = 1.0
#: Published sizes in MB of checkpoints whose name has no parameter count.
WEIGHTS_MB = {
    "gpt2": 548.0, "gpt2-medium": 1520.0, "gpt2-large": 3130.0, "gpt2-xl": 6430.0, "bert-base-uncased": 440.0, "bert-large-uncased": 1340.0,
    "roberta-base": 500.0, "roberta-large": 1430.0, "distilgpt2": 353.0, "t5-small": 242.0, "t5-base": 892.0, "t5-large": 2950.0,
}
MB_PER_MILLION = 2.0


def default_absolute(value: Column) -> Column:
    size = F.abs(value)
    out = F.lit(ABSOLUTE_ELSE)
    for below, tolerance in reversed(ABSOLUTE_STEPS):
        out = F.when(size < below, tolerance).otherwise(out)
    return out


def band(value: Column, relative: Column, absolute: Column) -> Column:
    """The wider of the absolute tolerance (or its default) and the relative one."""
    return F.greatest(F.coalesce(absolute, default_absolute(value)), F.abs(value) * relative)


def relative_delta(delta: Column, value: Column) -> Column:
    """|delta| / |value|, null for a value of zero."""
    return F.try_divide(F.abs(delta), F.abs(value))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def to_number(text: Column) -> Column:
    """What a decimal, exponent, inf or nan literal reads as (a single _ between digits allowed), else null."""
    plain = F.trim(text)
    joined = F.regexp_replace(plain, r"(?<=[0-9])_(?=[0-9])", "")
    named = F.lower(F.regexp_replace(plain, r"^[+-]", ""))
    sign = F.when(F.startswith(plain, F.lit("-")), -1.0).otherwise(1.0)
    return (
        F.when(named.isin("inf", "infinity"), sign * float("inf"))
        .when(named == "nan", float("nan"))
        .when(plain.rlike(r"^[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?$"), F.expr("0D") + joined.try_cast("double"))
    )


def weight_mb(model: Column) -> Column:
    """Download size of a model id, from the table or from the parameter count in its name; null if neither tells."""
    name = F.lower(F.element_at(F.split(model, "/"), -1))
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS_MB.items() for x in pair])
    count = r"(\d+(?:\.\d+)?)\s*([bm])(?![a-z0-9])"
    number = F.nullif(F.regexp_extract(name, count, 1), F.lit("")).cast("double")
    millions = F.when(F.regexp_extract(name, count, 2) == "b", number * 1000).otherwise(number)
    return F.coalesce(F.try_element_at(table, name), millions * MB_PER_MILLION)


@F.pandas_udf(StringType())
def duration(seconds: pd.Series) -> pd.Series:
    """Seconds below 90, minutes below 5400, else hours; halves go to the even digit. Only reports use it."""

    def shown(s: float) -> str | None:
        if pd.isna(s):
            return None
        return f"{s:.0f} seconds" if s < 90 else f"{s / 60:.0f} minutes" if s < 5400 else f"{s / 3600:.1f} hours"

    return seconds.map(shown)


@F.pandas_udf(StringType())
def general_format(x: pd.Series) -> pd.Series:
    """Six significant digits without trailing zeros; a dash for null. Only reports use it."""
    return x.map(lambda v: "—" if pd.isna(v) else f"{v:g}")


@F.pandas_udf(StringType())
def delta_format(delta: pd.Series, relative: pd.Series) -> pd.Series:
    """Signed delta, with the relative one as a percentage where there is one."""
    return pd.Series(["—" if pd.isna(d) else f"{d:+g}" if pd.isna(r) else f"{d:+g} ({r:.1%})" for d, r in zip(delta, relative, strict=True)])
