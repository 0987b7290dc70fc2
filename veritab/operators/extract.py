"""Table extraction: markup is cut into fields by tasks, the grid is worked out in Spark.

A field's column, inherited multirow content, header paths, stub columns, section rows,
table numbers and addresses are windows and aggregates over (paper, table).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, NullType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from veritab.functions import latex, names, numbers

TABLE_KEY = ["paper_id", "inline", "place"]
#: Fields that a scan sends on at once; those of one paper stay together.
FIELDS = 4096
#: Part numbers of a paper whose references and floats meet in one task.
PARTS = 1024
_FIELDS = "inline boolean, place int, environment string, label string, caption string, row int, ruled boolean, field int, raw string, colspan int, rowspan int, text string"
_NAMES, _KINDS = zip(*(x.split() for x in _FIELDS.split(", ")), strict=True)
_TYPES = {"boolean": BooleanType(), "int": IntegerType(), "string": StringType()}
_REF = re.compile(r"\\(?:ref|autoref|Cref|cref|tabref|eqref)\b\*?\{([^}]*)\}")


def _described(inner: str) -> tuple[str | None, str]:
    label, caption = latex.first_command(inner, "label", 1), latex.first_command(inner, "caption", 1)
    return (latex.flatten(label[2][0]) if label else None), (latex.flatten(caption[2][0]) if caption else "")


def _fields_of(document: str):
    """Fields of the first tabular of each float, then of tabulars outside floats."""
    text = latex.expand(latex.strip_comments(document))
    spans = []
    for place, (_, start, a, b, end) in enumerate(latex.environments(text, latex.FLOATS)):
        inside = latex.environments(text[a:b], latex.TABULARS)
        if inside:
            spans.append((start, end))
            name, _, i, j, _ = inside[0]
            for f in latex.grid(name, text[a + i : a + j]):
                yield False, place, name, *_described(text[a:b]), *f, latex.flatten(f[3])
    for place, (name, start, a, b, _) in enumerate(latex.environments(text, latex.TABULARS)):
        if not any(s <= start < e for s, e in spans):
            for f in latex.grid(name, text[a:b]):
                yield True, place, name, *_described(text[a:b]), *f, latex.flatten(f[3])


def scan_fields(papers: DataFrame) -> DataFrame:
    """(paper_id, one field of a tabular each) of papers (paper_id, text)."""
    kind = papers.schema["paper_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            types = [b.schema.field(0).type, pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["paper_id", *_NAMES])  # noqa: B023, E731
            rows = []
            for paper, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(paper, *f) for f in _fields_of(text or "")]
                if len(rows) >= FIELDS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return papers.select("paper_id", "text").mapInArrow(run, f"paper_id {kind}, {_FIELDS}")


class TableFields:
    """fields of a text's tables, a row each: ``SELECT p.paper_id, f.* FROM papers p, LATERAL table_fields(p.text) f`` once registered."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType | NullType):
            raise ValueError("table_fields takes the text of a paper")
        return AnalyzeResult(StructType([StructField(*f) for f in zip(_NAMES, map(_TYPES.get, _KINDS), strict=True)]))

    def eval(self, text: str | None):
        yield from _fields_of(text or "")


def register(spark: SparkSession) -> None:
    """Make ``table_fields`` known to SQL; scan_fields(view) and the lateral join above have the same rows."""
    spark.udtf.register("table_fields", udtf(TableFields))


def placed_fields(fields: DataFrame) -> DataFrame:
    """fields with their column, with multirow content in the blank fields below, and with what the grid says of each row."""
    table = Window.partitionBy(*TABLE_KEY)
    in_row = Window.partitionBy(*TABLE_KEY, "row").orderBy("field")
    before = in_row.rowsBetween(Window.unboundedPreceding, -1)
    out = fields.withColumn("col", F.coalesce(F.sum("colspan").over(before), F.lit(0)).cast("int"))
    above = Window.partitionBy(*TABLE_KEY, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    high = F.last(F.when(F.col("rowspan") > 1, F.struct("row", "rowspan", "raw", "text")), ignorenulls=True).over(above)
    out = out.withColumn("high", high)
    inherits = (F.col("text") == "") & (F.col("high.row") + F.col("high.rowspan") > F.col("row"))
    out = out.withColumns({"raw": F.when(inherits, F.col("high.raw")).otherwise(F.col("raw")), "text": F.when(inherits, F.col("high.text")).otherwise(F.col("text"))})
    first_body = F.min(F.when(F.col("ruled") & (F.col("row") > 0), F.col("row"))).over(table)
    out = out.withColumns({"ncols": F.max(F.col("col") + F.col("colspan")).over(table), "body": F.coalesce(first_body, F.when(F.max("row").over(table) > 0, 1).otherwise(0))})
    alone = F.count(F.lit(1)).over(Window.partitionBy(*TABLE_KEY, "row")) == 1
    section = (F.col("row") >= F.col("body")) & alone & (F.col("col") == 0) & (F.col("colspan") >= F.col("ncols")) & (F.col("ncols") > 1) & (F.col("text") != "")
    return out.drop("high").withColumn("is_section", section)


def with_header_paths(placed: DataFrame) -> DataFrame:
    """The fields below the headers with col_path: header texts over their column from top to bottom, without blanks and repeats of the one above.

    Headers meet the fields below them in one pass by column; markup is read once, and nothing is joined or sent through the driver.
    """
    head = F.col("row") < F.col("body")
    covered = F.when(head, F.sequence("col", F.col("col") + F.col("colspan") - 1)).otherwise(F.array("col"))
    by_column = Window.partitionBy(*TABLE_KEY, "col").orderBy("row")
    out = placed.where(~head | (F.col("text") != "")).withColumn("col", F.explode(covered))
    out = out.withColumn("above", F.lag("text").over(by_column))
    named = F.when(head & (F.col("above").isNull() | (F.col("above") != F.col("text"))), F.col("text"))
    whole = by_column.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("col_path", F.collect_list(named).over(whole)).where(~head).drop("above")


def extract_cells(papers: DataFrame) -> DataFrame:
    """One row for each data cell of each table that has any, addressed and typed."""
    return cells_of(scan_fields(papers))


def cells_of(fields: DataFrame) -> DataFrame:
    """The cells of fields, as scan_fields gives them or ``table_fields`` in SQL."""
    body = with_header_paths(placed_fields(fields))
    by_row = Window.partitionBy(*TABLE_KEY).orderBy("row").rangeBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("section", F.last(F.when(F.col("is_section"), F.col("text")), ignorenulls=True).over(by_row))
    body = body.where("not is_section").withColumn("number", F.dense_rank().over(Window.partitionBy(*TABLE_KEY).orderBy("row")))
    body = numbers.parse_cells(body)
    labels_only = F.collect_set(F.when(F.col("wordy"), F.col("col"))).over(Window.partitionBy(*TABLE_KEY))
    wordy = ~F.max(F.col("parsed.is_numeric")).over(Window.partitionBy(*TABLE_KEY, "col"))
    body = body.withColumn("wordy", wordy).withColumn("labels_only", labels_only)
    leading = F.filter(F.sequence(F.lit(0), F.col("ncols")), lambda c: (c >= F.col("ncols") - 1) | ~F.array_contains("labels_only", c))[0]
    body = body.withColumn("stub", F.greatest(F.lit(1), leading))
    own = F.collect_list(F.when((F.col("col") < F.col("stub")) & (F.col("text") != ""), F.struct("col", "text"))).over(Window.partitionBy(*TABLE_KEY, "row"))
    body = body.withColumn("row_path", F.concat(F.filter(F.array("section"), lambda s: s.isNotNull()), F.transform(F.array_sort(own), lambda x: x["text"])))
    cells = body.where("col >= stub").withColumn("col_path", F.when(F.size("col_path") > 0, F.col("col_path")).otherwise(F.array(F.format_string("column %d", F.col("col") + 1))))
    cells = cells.withColumn("index", F.dense_rank().over(Window.partitionBy("paper_id", "inline").orderBy("place")))
    title = F.format_string("%s %d", F.when(F.col("inline"), "Inline table").otherwise("Table"), "index")
    cells = cells.withColumn("plain", names.make_address(title, F.col("row_path"), F.col("col_path")))
    again = F.row_number().over(Window.partitionBy(*TABLE_KEY, "plain").orderBy("number", "col"))
    address = F.when(again > 1, F.concat("plain", F.lit(" #"), again.cast("string"))).otherwise(F.col("plain"))
    return cells.select(
        "paper_id", "inline", "index", F.coalesce("label", F.format_string("table-%d", F.col("index"))).alias("table_id"), "label", "caption", "environment", address.alias("address"),
        "row_path", "col_path", F.col("number").alias("row"), "col", F.trim("raw").alias("raw"), "text", "parsed.*", latex.emphasis(F.col("raw")).alias("emphasis"),
    )


def _cited(text: str) -> dict[tuple[int, int], list[dict]]:
    """The references of each paragraph (start, end) that has any, by place."""
    cited: dict[tuple[int, int], list[dict]] = {}
    for m in _REF.finditer(text):
        start, end = text.rfind("\n\n", 0, m.start()), text.find("\n\n", m.end())
        place = (0 if start < 0 else start + 2, len(text) if end < 0 else end)
        cited.setdefault(place, []).extend({"at": m.start(), "label": x.strip()} for x in m[1].split(","))
    return cited


def _paragraph(text: str) -> str:
    """What a reader sees of a paragraph; its references are marked."""
    return latex.flatten(_REF.sub(lambda r: ", ".join(f"\ue000{x.strip()}\ue001" for x in r[1].split(",")), text))


def scan_citations(papers: DataFrame) -> DataFrame:
    """(paper_id, at, until, label, paragraph): floats with where they end, and references with their paragraph, by offset.

    A paragraph that several references share is cleaned once. A paper is one row and one task's: what grows beyond that comes in parts, to ``cited_in_parts``.
    """
    kind = papers.schema["paper_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for paper, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = latex.expand(latex.strip_comments(text or ""))
                rows += [(paper, start, end, [], None) for _, start, _, _, end in latex.environments(text, latex.FLOATS)]
                rows += [(paper, start, None, found, _paragraph(text[start:end])) for (start, end), found in _cited(text).items()]
            types = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("label", pa.string())])), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["paper_id", "at", "until", "cited", "paragraph"])

    found = papers.select("paper_id", "text").mapInArrow(run, f"paper_id {kind}, at int, until int, cited array<struct<at:int,label:string>>, paragraph string")
    found = found.select("paper_id", "at", "until", "paragraph", F.explode_outer("cited").alias("cited"))
    return found.select("paper_id", F.coalesce("cited.at", "at").alias("at"), "until", "cited.label", "paragraph")


def outside(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of points (keys, at, until) that are no spans (until null) and in none: no span [at, until) of their keys covers them.

    One pass in order of place with the farthest end so far: spans may nest or overlap, and no point meets a span in a join.
    """
    so_far = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return points.withColumn("covered", F.coalesce(F.max("until").over(so_far) > F.col("at"), F.lit(False))).where("until is null and not covered").drop("until", "covered")


def part_macros(parts: DataFrame) -> DataFrame:
    """(paper_id, macros) of parts (paper_id, part, text): the macros that a paper's parts define, as ``latex.macros`` has them of its whole text."""
    kind = parts.schema["paper_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for paper, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = latex.strip_comments(text)
                rows += [(paper, part, k, by_def, *found) for by_def in (False, True) for k, found in enumerate(latex.definitions(text, by_def))]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["paper_id", "part", "k", "by_def", "name", "n", "body"])

    some = parts.where(F.col("text").rlike(r"\\(?:(?:re)?newcommand|def)")).select("paper_id", F.col("part").cast("long").alias("part"), "text")
    found = some.mapInArrow(run, f"paper_id {kind}, part long, k int, by_def boolean, name string, n int, body string")
    macro, place = F.struct("name", "n", "body"), F.struct("part", "k")
    named = found.groupBy("paper_id", "name").agg(F.coalesce(F.max_by(F.when(~F.col("by_def"), macro), F.when(~F.col("by_def"), place)), F.min_by(F.when(F.col("by_def"), macro), F.when(F.col("by_def"), place))).alias("macro"))
    return named.groupBy("paper_id").agg(F.collect_list("macro").alias("macros"))


def cited_in_parts(parts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(paper_id, at, label, paragraph): the references outside floats of papers that are no one's row; at: (part, offset in it).

    parts: (paper_id, part, text), part a whole number; a paper is its parts by number with blank lines between. Commands, macro definitions and paragraphs
    stand whole in a part, floats may go over any number of them (a row for every PARTS numbers, so numbers shouldn't leave wide gaps there). known: ``part_macros(parts)`` where parts
    use macros of others; without it each part's own are replaced. Null texts are empty.

    A float of one part hides its references in the task that reads it. Begins and ends that are left meet over the paper; what they cover is
    cut at every PARTS numbers, and references meet it there in one pass: no task holds a paper.
    """
    kind = parts.schema["paper_id"].dataType.simpleString()
    texts = parts.select("paper_id", F.col("part").cast("long").alias("part"), "text")
    marked, cites = r"\\(?:begin|end)\{", r"\\(?:\w*ref)\b"
    texts = texts.withColumn("macros", F.lit(None).cast("array<struct<name:string,n:int,body:string>>")) if known is None else texts.join(known, "paper_id", "left")
    # A macro may bring what the text itself doesn't show.
    having = lambda pattern: texts.where(F.col("text").rlike(pattern) | (F.size("macros") > 0) | F.col("text").rlike(r"\\(?:(?:re)?newcommand|def)"))
    own = known is None
    read = lambda text, macros: latex.expand(latex.strip_comments(text or ""), known=None if own else {m["name"]: (m["n"], m["body"]) for m in macros or []})

    def references(batches):
        for b in batches:
            rows = []
            for paper, part, text, macros in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, far, k = read(text, macros), 0, 0
                spans = [(start, end) for _, start, _, _, end in latex.environments(text, latex.FLOATS)]
                for (start, end), found in _cited(text).items():
                    open_ = []
                    for x in found:
                        while k < len(spans) and spans[k][0] <= x["at"]:
                            far, k = max(far, spans[k][1]), k + 1
                        if x["at"] >= far:
                            open_.append(x)
                    if open_:
                        paragraph = _paragraph(text[start:end])
                        rows += [(paper, part, x["at"], x["label"], paragraph) for x in open_]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["paper_id", "part", "at", "label", "paragraph"])

    def marks(batches):
        for b in batches:
            rows = []
            for paper, part, text, macros in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(paper, part, *mark) for mark in latex.open_marks(read(text, macros), latex.FLOATS)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["paper_id", "part", "at", "name", "step"])

    bucket = lambda at: F.floor(at / PARTS)
    points = having(cites).mapInArrow(references, f"paper_id {kind}, part long, at int, label string, paragraph string")
    points = points.select("paper_id", bucket(F.col("part")).alias("bucket"), F.struct("part", "at").alias("at"), F.lit(None).cast("struct<part:bigint,at:int>").alias("until"), "label", "paragraph")
    met = _covered(having(marked).mapInArrow(marks, f"paper_id {kind}, part long, at int, name string, step int").select("paper_id", F.struct("part", "at").alias("at"), "name", "step"))
    spans = met.select("paper_id", F.explode(F.sequence(bucket(F.col("at.part")), bucket(F.col("until.part")))).alias("bucket"), "at", "until", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("paragraph"))
    return outside(points.unionByName(spans), ["paper_id", "bucket"]).drop("bucket")


def _covered(marks: DataFrame) -> DataFrame:
    """(paper_id, at, until): stretches between marks (paper_id, at, name, step 1 or -1) that lie in a float: some begin before is still to end.

    An end takes the last begin of its name, one without a begin counts for nothing, and a begin without an end covers nothing: covered is
    where a name's depth is greater than it ever is later.
    """
    forth, back = Window.partitionBy("paper_id", "name").orderBy("at"), Window.partitionBy("paper_id", "name").orderBy(F.desc("at"))
    so_far = forth.rowsBetween(Window.unboundedPreceding, 0)
    out = marks.withColumn("sum", F.sum("step").over(so_far))
    out = out.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    out = out.withColumns({"until": F.lag("at").over(back), "later": F.min("depth").over(back.rowsBetween(Window.unboundedPreceding, -1))})
    return out.where("depth > later").select("paper_id", "at", "until")


def citing_paragraphs(papers: DataFrame, cells: DataFrame) -> DataFrame:
    """(paper_id, label, ord, paragraph): paragraphs outside floats that refer to a table, their references resolved to its number."""
    cited = outside(scan_citations(papers), ["paper_id"]).withColumnRenamed("at", "ord")
    known = cells.where("label is not null").select("paper_id", "label", "index").distinct()
    numbers_of = known.groupBy("paper_id").agg(F.collect_list(F.struct("label", "index")).alias("known"))
    resolved = F.aggregate("known", F.col("paragraph"), lambda text, k: F.replace(text, F.concat(F.lit("\ue000"), k["label"], F.lit("\ue001")), k["index"].cast("string")))
    out = cited.join(known.select("paper_id", "label"), ["paper_id", "label"]).join(numbers_of, "paper_id")
    out = out.withColumn("paragraph", F.translate(resolved, "\ue000\ue001", "")).where("paragraph != ''")
    return out.groupBy("paper_id", "label", "paragraph").agg(F.min("ord").alias("ord")).select("paper_id", "label", "ord", "paragraph")
