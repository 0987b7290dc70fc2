import pytest
from pyspark.sql import functions as F

from veritab.functions import latex, names, numbers, scalars


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        (r"$1.42 \pm 0.21$", "1.42 ± 0.21"),
        (r"\textbf{\texttt{x}} \cite{key}", "x"),
        (r"$n$-gram", "n-gram"),
        (r"$d_{\text{model}}$", "d_model"),
        (r"\resizebox{\textwidth}{!}{x}", "x"),
        (r"\makecell{Total train \\ (flops)}", "Total train (flops)"),
        (r"\{\ldots\} \$5 71.2\%", "{…} $5 71.2%"),
        (r"$\epsilon_{ls}$", "ε_ls"),
        ("", ""),
        (None, ""),
    ],
)
def test_flatten(raw, text):
    assert latex.flatten(raw) == text


CELLS = [
    (r"8.42", 8.42, None, "none", "none", []),
    (r"-0.31", -0.31, None, "none", "none", []),
    (r"+6.3", 6.3, None, "none", "none", []),
    (r"1e-3", 0.001, None, "none", "none", []),
    (r"1,234", 1234.0, None, "none", "none", []),
    (r"-1,234", None, None, "none", "none", []),
    (r"$1.42 \pm -0.21$", 1.42, 0.21, "pm", "none", []),
    (r"78.1 (0.4)", 78.1, 0.4, "paren", "none", []),
    (r"$1.42_{0.21}$", 1.42, 0.21, "subscript", "none", []),
    (r"71.2\%", 71.2, None, "none", "percent", []),
    (r"$1.5\times$", 1.5, None, "none", "times", []),
    (r"1.42*", 1.42, None, "none", "none", ["*"]),
    (r"$<0.01^*$", None, None, "none", "none", ["*", "<"]),
    (r"<0.01", 0.01, None, "none", "none", ["<"]),
    (r"$2.3\cdot10^{19}$", 2.3e19, None, "none", "none", []),
    (r"$1.5\times10^{-3}$", 0.0015, None, "none", "none", []),
    ("--", None, None, "none", "none", []),
    ("n/a", None, None, "none", "none", []),
    ("", None, None, "none", "none", []),
    ("GPT-2-large", None, None, "none", "none", []),
]


def test_parse_cell(spark):
    df = spark.createDataFrame([(i, c[0], latex.flatten(c[0])) for i, c in enumerate(CELLS)], "i int, raw string, text string")
    rows = df.select("i", numbers.parse_cell(F.col("raw"), F.col("text")).alias("p")).orderBy("i").collect()
    for row, (raw, value, uncertainty, kind, unit, markers) in zip(rows, CELLS, strict=True):
        p = row.p
        assert (p.is_numeric, p.uncertainty, p.uncertainty_kind, p.unit, p.markers) == (value is not None, uncertainty, kind, unit, markers), raw
        assert p.value == pytest.approx(value) if value is not None else p.value is None


def test_parse_cells_step_by_step(spark):
    more = ["1|2", "± 3", "1 ± x", "1.5 (2", "< 1,234 *†", "1e999", "3 * 4", "$10^{2}$", r"$2 \cdot 10^{99999999999}$", "x_{1}", "1_{2}*", "−4 ± −1", "≈ 5\\%", "*", "NaN ‡", None]
    cells = spark.createDataFrame([(i, c, latex.flatten(c)) for i, c in enumerate([c[0] for c in CELLS] + more)], "i int, raw string, text string")
    one_by_one = cells.withColumn("parsed", numbers.parse_cell(F.col("raw"), F.col("text")))
    stepwise = numbers.parse_cells(cells)
    assert stepwise.columns == one_by_one.columns and sorted(map(str, stepwise.collect())) == sorted(map(str, one_by_one.collect()))
    got = {r.raw: r.parsed for r in stepwise.collect()}
    assert (got["< 1,234 *†"].value, got["< 1,234 *†"].markers) == (1234.0, ["*", "†", "<"]) and (got["−4 ± −1"].value, got["−4 ± −1"].uncertainty) == (-4.0, 1.0)
    assert got["1|2"].value is None and got["± 3"].value is None and got["1 ± x"].value is None and got["1_{2}*"].uncertainty_kind == "subscript"


def test_names(spark):
    for name, norm in [("GPT-2-large", "gpt2large"), ("Pythia-1.4B", "pythia1.4b"), ("pythia_1_4b", "pythia1.4b"), ("1..-2", "1.2"), ("a.b", "ab"), ("", "")]:
        assert one(spark, names.normalize(F.col("n")), n=name) == norm
    assert "npz" in one(spark, names.phrases(F.col("t")), t="for NP/Z items")
    assert one(spark, names.phrases(F.col("t")), t="") == []
    assert one(spark, names.content_tokens(F.col("t")), t="The results of a model, Model X1") == ["model", "x1"]
    assert one(spark, names.partial_match(F.lit("md"), F.lit("bllip-md-gptbpe")))
    assert not one(spark, names.partial_match(F.lit("sm"), F.lit("bllip-small-md")))
    assert one(spark, names.contained(F.lit("GPT-2-large"), F.lit("surprisal_gpt2-large.csv")))
    assert not one(spark, names.contained(F.lit("np"), F.lit("input")))
    assert one(spark, names.filename_matches(F.lit("bllip-xs"), F.lit("out/bllip_xs.csv")))
    assert not one(spark, names.filename_matches(F.lit("lg"), F.lit("logistic.csv")))
    assert one(spark, names.is_difference_marker(F.lit("Δ")))
    assert one(spark, names.short_address(F.lit("Table 1 › a › b"))) == "a › b"
    assert one(spark, names.make_address(F.lit("Table 1"), F.array(F.lit(""), F.lit("r")), F.array(F.lit("c")))) == "Table 1 › r › c"
    assert one(spark, names.tail_lines(F.lit("a\nb\nc"), 2)) == "b\nc"
    assert one(spark, names.portable_path(F.lit("/home/u/x"), "/home/u")) == "~/x"
    for text, found in [("https://arxiv.org/pdf/2401.12345.pdf", "2401.12345"), ("https://arxiv.org/abs/2401.12345v2", "2401.12345v2"), ("cs.CL/0501001", "cs.CL/0501001"), ("nothing", None)]:
        assert one(spark, names.arxiv_id(F.lit(text))) == found


def test_scalars(spark):
    for text, value in [("1.5", 1.5), (" -2 ", -2.0), ("1_000", 1000.0), ("inf", float("inf")), ("-Infinity", float("-inf")), ("", None), ("1d", None), ("0x1", None), ("1__0", None), (".5", 0.5), ("5.", 5.0)]:
        assert one(spark, scalars.to_number(F.lit(text))) == value, text
    assert one(spark, F.isnan(scalars.to_number(F.lit("NaN"))))
    assert [one(spark, scalars.default_absolute(F.lit(v))) for v in (0.5, -5.0, 50.0, 500.0)] == [0.01, 0.05, 0.5, 1.0]
    assert [one(spark, scalars.weight_mb(F.lit(m))) for m in ("gpt2-large", "EleutherAI/pythia-1.4b", "facebook/opt-350m", "x")] == [3130.0, 2800.0, 700.0, None]
    assert [one(spark, scalars.duration(F.lit(s))) for s in (30.0, 600.0, 7200.0)] == ["30 seconds", "10 minutes", "2.0 hours"]
    assert one(spark, scalars.relative_delta(F.lit(1.0), F.lit(0.0))) is None
    row = spark.createDataFrame([(0.95, None), (None, None)], "a double, b double").select(scalars.general_format("a").alias("x"), scalars.delta_format("a", "b").alias("y")).collect()
    assert [tuple(r) for r in row] == [("0.95", "+0.95"), ("—", "—")]


def test_macros_and_comments():
    text = r"\newcommand{\a}{A} \renewcommand{\a}{B} \def\b{C} \def\b{D} \newcommand{\two}[2]{#2#1} \a\b\two{x}{y} \newcommand{\begin}{no}"
    assert "BCyx" in latex.expand(text)
    assert latex.expand(r"\newcommand{\x}{\x} \x").endswith(r"\x")
    assert latex.strip_comments("a % b\nc \\% d") == "a \nc \\% d"
    assert latex.closing("{a{b}\\}", 0) == -1
