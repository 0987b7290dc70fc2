"""Reports: markdown lines of a graded paper, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.names import short_address
from veritab.functions.scalars import delta_format, general_format
from veritab.schema import described


def lines(compared: DataFrame) -> DataFrame:
    """(ord, line): one markdown table row for each compared cell."""
    why = F.when(F.col("failure_code").isNotNull(), F.concat_ws(" — ", F.concat("failure_code", F.lit(": "), described(F.col("failure_code"))), F.when(F.col("evidence") != "", F.col("evidence")))).otherwise(F.array_join("notes", "; "))
    cells = [F.col("status"), short_address(F.col("address")), general_format("paper_value"), general_format("result_value"), delta_format("delta", "relative_delta"), F.replace(why, F.lit("|"), F.lit("\\|"))]
    return compared.select("ord", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(compared: DataFrame, title: str = "Reproduction report") -> str:
    """The report of one paper; a paper's cells are few, so they come to the driver in order."""
    rows = [r.line for r in lines(compared).orderBy("ord").toLocalIterator()]
    head = [f"# {title}", "", "| Status | Cell | Paper | Rerun | Δ | Reason |", "| --- | --- | ---: | ---: | ---: | --- |"]
    return "\n".join([*head, *rows]) + "\n"
