import pytest
from pyspark.sql import functions as F

from veritab.functions import latex
from veritab.operators import align, budget, extract, grade, harvest, outcomes, profile, scripts
from veritab.plans import catalog
from veritab.sources import contracts, files

PAPER = r"""\documentclass{article}
\newcommand{\score}{Score}
% \begin{table} in a comment \end{table}
\begin{table}\begin{tabular}{l} layout only \end{tabular}\end{table}
\begin{table}\caption{\score\ of models}\label{tab:m}
\begin{tabular}{llcc}\toprule
 & & \multicolumn{2}{c}{\score} \\ \cmidrule(lr){3-4}
Model & Size & A & A \\ \midrule
\multicolumn{4}{c}{Small ones} \\
\multirow{2}{*}{X} & s & 1.0 & $2.0 \pm 0.5$ \\
 & m & \textbf{3} & -- \\[2pt]
\multicolumn{4}{l}{Large ones} \\
Y & l & 71\% & 5 \\ \bottomrule
\end{tabular}\end{table}

As Table~\ref{tab:m} shows.

\begin{tabular}{lc} & n \\ \hline a & 1 \\ a & 2 \\ \end{tabular}
"""


@pytest.fixture(scope="module")
def cells(spark):
    papers = spark.createDataFrame([("p", PAPER), ("empty", ""), ("null", None)], "paper_id string, text string")
    return papers, extract.extract_cells(papers).cache()


def test_extraction(cells):
    _, found = cells
    rows = {r.address: r for r in found.collect()}
    assert set(rows) == {
        "Table 1 › Small ones › X › s › Score › A", "Table 1 › Small ones › X › s › Score › A #2", "Table 1 › Small ones › X › m › Score › A", "Table 1 › Small ones › X › m › Score › A #2",
        "Table 1 › Large ones › Y › l › Score › A", "Table 1 › Large ones › Y › l › Score › A #2", "Inline table 1 › a › n", "Inline table 1 › a › n #2",
    }
    r = rows["Table 1 › Small ones › X › s › Score › A #2"]
    assert (r.value, r.uncertainty, r.uncertainty_kind, r.row, r.col, r.table_id, r.caption) == (2.0, 0.5, "pm", 1, 3, "tab:m", "Score of models")
    assert rows["Table 1 › Small ones › X › m › Score › A"].emphasis == ["bold"]
    assert not rows["Table 1 › Small ones › X › m › Score › A #2"].is_numeric
    assert rows["Table 1 › Large ones › Y › l › Score › A"].unit == "percent"
    assert rows["Inline table 1 › a › n #2"].value == 2.0


def test_headers_meet_cells_without_a_join(spark, tmp_path):
    """Headers over each cell, spans and repeats too, in one pass: markup is read once and no header goes through the driver."""
    text = r"\begin{tabular}{lccc} & \multicolumn{2}{c}{P} & Q \\ & P & R & \\ & & R & Q \\ \hline x & 1 & 2 & 3 \\ \multicolumn{4}{c}{S} \\ y & 4 & \multicolumn{2}{c}{5} \\ \end{tabular}"
    found = extract.extract_cells(spark.createDataFrame([(1, text), (2, "\\begin{tabular}{lc} a & 1 \\end{tabular}")], "paper_id int, text string"))
    assert {(r.paper_id, *r.row_path, r.col): r.col_path for r in found.collect()} == {
        (1, "x", 1): ["P"], (1, "x", 2): ["P", "R"], (1, "x", 3): ["Q"], (1, "S", "y", 1): ["P"], (1, "S", "y", 2): ["P", "R"], (2, "a", 1): ["column 2"],
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def _parts(spark, folder, n):
    spark.range(n).selectExpr("id AS p_partkey", "concat('Brand#', id % 7) AS p_brand", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_section_rows_of_a_small_file_are_read_by_several_tasks(spark, tmp_path):
    _parts(spark, tmp_path, 300)
    found = catalog.queries()["section_rows"](spark, str(tmp_path))
    assert {(r.address, r.value, r.row) for r in found.where("paper = 8").collect()} == {
        ("Inline table 1 › Brand#1 › x › B", 1.0, 1), ("Inline table 1 › Brand#1 › y › B", 8.0, 2), ("Inline table 1 › Second › x › B", 3.0, 3), ("Inline table 1 › Second › x › B #2", 4.0, 5),
    }
    assert found.count() == 1200
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" in plan[plan.index("MapInArrow") :]


def test_odd_markup_sends_no_header_through_the_driver(spark, tmp_path):
    _parts(spark, tmp_path, 300)
    found = catalog.queries()["odd_markup"](spark, str(tmp_path))
    assert sorted((r.address, r.value, r.text) for r in found.where("paper = 9").collect()) == [
        ("Inline table 1 › Brand#2 › A", -9.0, "\u22129"), ("Inline table 1 › Brand#2 › B", None, "9 & 2"), ("Inline table 1 › M › A", 1.0, "1"), ("Inline table 1 › M › A #2", 3.0, "3"),
        ("Inline table 1 › M › B", 2.0, "2"), ("Inline table 1 › M › B #2", 9.0, "9"),
    ]
    assert found.count() == 1800
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Repartition" in plan[plan.index("MapInArrow") :]


def test_paragraphs(cells):
    papers, found = cells
    assert [(r.label, r.paragraph) for r in extract.citing_paragraphs(papers, found).collect()] == [("tab:m", "As Table 1 shows.")]


def test_nested_floats_hide_references(spark):
    text = "\\ref{a} one\n\n\\begin{table}\\begin{table*}x\\end{table*} \\ref{a}\\end{table} \\ref{b, a} two \\cref{b}\n\n\n \\ref{a}\ue000"
    papers = spark.createDataFrame([(1, text), (2, None), (3, "\\begin{table} \\ref{a}")], "paper_id int, text string")
    found = extract.outside(extract.scan_citations(papers), ["paper_id"])
    where = [m for m in range(len(text)) if text.startswith(("\\ref", "\\cref"), m)]
    got = sorted((r.paper_id, r.at, r.label) for r in found.collect())
    assert got == [(1, where[0], "a"), (1, where[2], "a"), (1, where[2], "b"), (1, where[3], "b"), (1, where[4], "a"), (3, 14, "a")]  # the last has no float, as none ends


def test_references_of_parts_are_those_of_the_whole_text(spark):
    """Floats within parts and over many, begins and ends that meet nothing, comments, macros of other parts; one part number in ten is left out."""
    import random

    rng = random.Random(3)
    words = [
        "\\begin{table}", "\\end{table}", "\\begin{table*}", "\\end{table*}", "\\begin{table}", "\\end{table}", "\\ref{a}", "\\cref{b, c}", "\\autoref*{a}", "x", "50\\% %\\ref{no} \\begin{table}\n", "\n\n", "\\open", "\\shut", "\\see{d}",
    ]
    rows = []
    for paper in range(12):
        sparse = [1, 1, 40][paper % 3]  # few marks, so that floats are long
        for part in range(150):
            text = " ".join("x" if rng.randrange(sparse) and "table" in w else w for w in rng.choices(words, k=rng.randrange(6)))
            if part in (30, 90) and paper % 2:
                text += " \\newcommand{\\see}[1]{\\emph{see %d} \\ref{#1}}" % part + ("\\renewcommand{\\open}{\\begin{sidewaystable}} \\def\\shut{\\end{sidewaystable}} \\def\\shut{y}" if part == 90 else "")
            rows.append((paper, 100 * part, text))
    rows.append((12, 0, None))
    parts = spark.createDataFrame(rows, "paper_id int, part int, text string").repartition(5)
    whole = spark.createDataFrame([(p, "\n\n".join(t or "" for q, _, t in rows if q == p)) for p in range(13)], "paper_id int, text string")
    want = sorted((r.paper_id, r.label, r.paragraph) for r in extract.outside(extract.scan_citations(whole), ["paper_id"]).collect())
    got = extract.cited_in_parts(parts, extract.part_macros(parts))
    assert sorted((r.paper_id, r.label, r.paragraph) for r in got.collect()) == want
    assert len(want) > 200 and {r[0] for r in want} >= set(range(10)) and len(want) < 0.8 * sum(t.count("ref{") for _, _, t in rows[:-1])
    plain = parts.where("paper_id % 2 = 0")  # without macros nothing need be known
    assert sorted((r.paper_id, r.label, r.paragraph) for r in extract.cited_in_parts(plain).collect()) == [r for r in want if r[0] % 2 == 0]
    assert extract.cited_in_parts(parts.limit(0)).count() == 0


def test_orders_of_a_nation_meet_in_no_row(spark, tmp_path):
    """One nation's orders, cited outside floats or inside: no text holds them all, and none is one task's."""
    spark.range(40).selectExpr("id AS c_custkey", "cast(7 AS int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(6000).selectExpr("id AS o_orderkey", "id % 37 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.queries()["cited_outside_floats"](spark, str(tmp_path))
    got = {(r.paper_id, r.label): (r.n_cited, r.first_order) for r in found.collect()}
    cited = [k for k in range(6000) if k % 3]
    assert got == {(7, f"tab:{c}"): (sum(k % 37 == c for k in cited), min(k for k in cited if k % 37 == c)) for c in range(37)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "bucket" in plan
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_fields_from_sql(spark, cells):
    papers, found = cells
    extract.register(spark)
    fields = spark.sql("SELECT p.paper_id, f.* FROM {papers} p, LATERAL table_fields(p.text) f", papers=papers)
    assert sorted(map(str, fields.collect())) == sorted(map(str, extract.scan_fields(papers).collect()))
    assert sorted(map(str, extract.cells_of(fields).collect())) == sorted(map(str, found.collect()))
    with pytest.raises(Exception, match="takes the text of a paper"):
        spark.sql("SELECT * FROM table_fields(1)").collect()


NO_FAILURE = None
GRADES = [
    # published, uncertainty, rerun, relative, absolute -> status
    (1.0, None, 1.0, None, None, "GREEN"), (10.0, None, 10.4, None, None, "GREEN"), (10.0, None, 11.0, None, None, "YELLOW"), (10.0, None, 25.0, None, None, "RED"),
    (0.05, None, -0.05, None, None, "RED"), (10.0, None, 10.4, 0.001, 0.001, "RED"), (1.42, 0.21, 1.60, None, None, "GREEN"), (1.42, 0.05, 3.0, None, None, "RED"),
    (1.0, None, float("nan"), None, None, "RED"), (1.0, None, float("inf"), None, None, "RED"), (0.001, None, -0.001, None, None, "GREEN"), (0.0, None, 0.005, None, None, "GREEN"),
]


def test_grades(spark):
    cells = spark.createDataFrame([(i, f"t{i}", f"a{i}", "", True, g[0], g[1], "none") for i, g in enumerate(GRADES)], "ord int, table_id string, address string, text string, is_numeric boolean, value double, uncertainty double, unit string")
    results = spark.createDataFrame([(1, f"a{i}", g[2], None, ["c"]) for i, g in enumerate(GRADES)], "pos int, address string, value double, failure struct<code:string,evidence:string>, caveats array<string>")
    own = spark.createDataFrame([(f"t{i}", g[3], g[4], None) for i, g in enumerate(GRADES) if g[3]], "table_id string, relative double, absolute double, multiplier double")
    done = grade.compare(cells, results, own).orderBy("ord").collect()
    assert [r.status for r in done] == [g[5] for g in GRADES]
    assert done[8].delta is None and done[8].band is None and done[8].notes == ["the rerun's value is not finite, so the two cannot be compared"]
    assert "sign differs from the paper" in done[4].notes and done[0].notes == ["c"]


def test_missing_failed_and_repeated_results(spark):
    cells = spark.createDataFrame([(i, "t", a, "", True, 1.0, None, "percent") for i, a in enumerate("abcd")], "ord int, table_id string, address string, text string, is_numeric boolean, value double, uncertainty double, unit string")
    results = spark.createDataFrame(
        [(1, "a", 5.0, None, []), (2, "a", 1.0, None, []), (3, "b", None, ("other", "why"), []), (4, "c", None, (None, "x"), []), (5, "z", 1.0, None, [])], "pos int, address string, value double, failure struct<code:string,evidence:string>, caveats array<string>"
    )
    done = grade.compare(cells, results).orderBy("ord").collect()
    assert [(r.status, r.failure_code) for r in done] == [("GREEN", None), ("UNRUNNABLE", "OTHER"), ("UNRUNNABLE", "OTHER"), ("NOT_ATTEMPTED", None)]
    assert done[0].notes == ["paper reports this in percent; values compared as given"]
    assert [r.address for r in grade.unmatched(cells, results).collect()] == ["z"]
    with pytest.raises(Exception, match="requires evidence"):
        grade.compare(cells, results.withColumn("failure", F.struct(F.lit("OTHER").alias("code"), F.lit(" ").alias("evidence")))).collect()


def test_profile_and_harvest(spark, tmp_path):
    (tmp_path / "results.csv").write_text('model,split,score\ntiny,dev,0.80\ntiny,dev,0.90\ntiny,test,0.60\ntiny,"te""st",nan\n')
    (tmp_path / "other.csv").write_text("k,v\n1,x\n")
    rows = files.read_artifacts(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"[^/]*$", 0)).cache()
    stats = {(r.path, r.column): r for r in profile.profile(rows).collect()}
    assert stats["results.csv", "score"].is_numeric and stats["results.csv", "split"].categories == ["dev", "test", 'te"st']
    assert stats["other.csv", "v"].is_category and len(stats) == 5
    assert profile.largest_input(rows).first().n_rows == 4
    dev = [("split", "dev")]
    recipes = spark.createDataFrame(
        [(s, "results.csv", "score", s, "stdev", dev) for s in ("mean", "median", "sum", "count", "stdev")]
        + [("skip", "results.csv", "score", "mean", None, []), ("both", "results.csv", "score", "mean", None, [("split", "dev"), ("split", "test")]), ("file", "x.csv", "score", "mean", None, []), ("col", "results.csv", "x", "mean", None, []), ("filter", "results.csv", "score", "mean", None, [("x", "y")])],
        "address string, path string, value_column string, statistic string, uncertainty_statistic string, filters array<struct<column:string,value:string>>",
    )
    got = {r.address: r for r in harvest.harvest(recipes, rows).collect()}
    assert [got[s].value for s in ("mean", "median", "sum", "count", "stdev")] == [0.85, 0.85, 1.7, 2.0, 0.071]
    assert (got["skip"].value, got["skip"].skipped, got["skip"].uncertainty) == (0.767, 1, None) and got["mean"].uncertainty == 0.071
    assert all(got[a].value is None and got[a].error for a in ("both", "file", "col", "filter"))


def test_wide_and_odd_files(spark, tmp_path):
    n = 700
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(n)) + "\n" + ",".join(map(str, range(n))) + "\n" + ",".join(["x"] * (n + 5)) + "\n")
    (tmp_path / "two.csv").write_text('"a,b",c\n1,"two\nlines"\n3\n')
    rows = {(r.path.rsplit("/", 1)[1], r.row_no): r.kv for r in files.read_artifacts(spark, str(tmp_path)).collect()}
    assert rows["wide.csv", 1] == {f"c{i}": str(i) for i in range(n)} and len(rows["wide.csv", 2]) == n
    assert rows["two.csv", 1] == {"a,b": "1", "c": "two\nlines"} and rows["two.csv", 2] == {"a,b": "3", "c": ""}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.csv").write_text('"a\nb",c\n1,2\n')
    assert [(r.row_no, r.kv) for r in files.read_artifacts(spark, str(tmp_path / "bad")).collect()] == [(1, {"a\nb": "1", "c": "2"})]


def test_headers_are_each_files_own(spark, tmp_path):
    """Repeated and missing names, empty files, blank lines, an odd quote, columns asked for; as a reader of dictionaries takes them."""
    import csv
    import io

    texts = {"twice.csv": "a,b,a\n1,2,3\n4\n", "gap.csv": "a,,c\n1,2,3\n", "none.csv": "", "head.csv": "a,b\n", "blank.csv": "\n\na,b\n\n1,2\n\n", "inch.csv": 'size 5",b\nx,y\n', "long.csv": "a,b\n" + "x" * 300_000 + ",1\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {}
    for r in files.read_artifacts(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_no, r.kv))
    want = {}
    csv.field_size_limit(1 << 30)
    for name, text in texts.items():
        rows = list(csv.DictReader(io.StringIO(text.lstrip("\n"))))
        if rows:
            want[name] = [(k + 1, {c: v or "" for c, v in row.items() if c}) for k, row in enumerate(rows)]
    assert {name: sorted(rows, key=lambda r: r[0]) for name, rows in got.items()} == want
    few = files.read_artifacts(spark, [str(tmp_path / "twice.csv"), str(tmp_path / "gap.csv")], columns=["c", "a"])
    assert sorted((tuple(sorted(r.kv.items())) for r in few.collect())) == [(("a", ""),), (("a", "1"), ("c", "3")), (("a", "3"),)]


def test_nested_options_and_display_math():
    assert latex.arguments("[t[x]y]{v} rest", 0, 1) == (["v"], 10)
    assert latex.arguments("[open {v}", 0, 1)[0] == [""]
    assert list(latex._cut("a & $$b & c$$ & d", row=False)) == ["a ", " $$b & c$$ ", " d"]
    assert list(latex._cut("$x$ & $$$$ & $y & z$", row=False)) == ["$x$ ", " $$$$ ", " $y & z$"]


def test_observed_keeps_the_first_combinations(spark, monkeypatch):
    """More combinations than are kept, rows out of order and over several tasks."""
    import random

    monkeypatch.setattr(profile, "MOST_COMBINATIONS", 5)
    rng = random.Random(9)
    rows = [(f"p{k % 2}.csv", k // 2, {"model": f"m{rng.randrange(9)}", "split": rng.choice(["dev", "test", ""]), "score": str(k)}) for k in range(600)]
    first = {}
    for path, row, kv in rows:
        first.setdefault(path, {}).setdefault((kv["model"], kv["split"]), row)
    want = {p: [k for k, _ in sorted(own.items(), key=lambda x: x[1])][:5] for p, own in first.items()}
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "path string, row_no long, kv map<string,string>").repartition(7)
    got = {}
    for r in profile.observed(table, profile.profile(table)).orderBy("path", "rank").collect():
        got.setdefault(r.path, []).append(tuple(dict((e.column, e.value) for e in r.combination)[c] for c in ("model", "split")))
    assert got == want


@pytest.mark.parametrize(("few", "cuts"), [(harvest.FEW, harvest.SPLITTERS), (5, 3), (2, 1)])
def test_medians_of_many_numbers(spark, monkeypatch, few, cuts):
    """Ranges are narrowed until few numbers are left; exact however small that bound is."""
    import random
    import statistics

    monkeypatch.setattr(harvest, "FEW", few)
    monkeypatch.setattr(harvest, "SPLITTERS", cuts)
    rng = random.Random(6)
    groups = {f"g{n}": [rng.choice([rng.gauss(0, 9), rng.randrange(5) / 4, -1e300, 7.0]) for _ in range(n)] for n in (1, 2, 40, 173)}
    rows = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "address string, x double")
    assert {r.address: r["median"] for r in harvest.medians(rows).collect()} == {g: statistics.median(xs) for g, xs in groups.items()}


def test_medians_against_sorting(spark):
    import random
    import statistics

    rng = random.Random(3)
    groups = {f"g{n}": [rng.choice([-1.5, 0.0, 2.25, 7.0, 7.5]) for _ in range(n)] for n in (1, 2, 3, 4, 9, 10, 51)}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("g3", None), ("g3", float("nan")), ("none", None)], "address string, x double")
    assert {r.address: r["median"] for r in harvest.medians(rows).collect()} == {g: statistics.median(xs) for g, xs in groups.items()}


def test_outcomes(spark):
    runs = spark.createDataFrame(
        [("gated first", "s.py", 1, "", "403 Client Error\nRepositoryNotFoundError", "x"), ("module first", "s.py", 1, "No module named \"a.b\"", "401 Client Error", "x"), ("null", "s.py", 137, None, None, "x"), ("fine", "s.py", 0, "", "", "x")],
        "run string, script string, returncode int, stdout string, stderr string, source string",
    )
    got = {r.run: (r.code, r.evidence) for r in outcomes.classify(runs).collect()}
    assert {k: v[0] for k, v in got.items()} == {"gated first": "GATED_DATASET", "module first": "MISSING_DEPENDENCY", "null": "OTHER"}
    assert got["null"][1] == "s.py exited 137; last output was: (silent)" and "'a.b'; x does not" in got["module first"][1]
    recipes = spark.createDataFrame([("a", "t", "f.csv"), ("b", "t", "g.csv"), ("c", "u", "f.csv")], "address string, table_id string, path string")
    there = spark.createDataFrame([("f.csv",)], "path string")
    tables = spark.createDataFrame([("t", "s.py", False)], "table_id string, script string, executed boolean")
    none = spark.createDataFrame([], "table_id string, ord int, code string, evidence string")
    got = {r.address: (r.failure and r.failure.code, r.provenance) for r in outcomes.readable(recipes, there, tables, none).collect()}
    assert got == {"a": (None, "committed"), "b": ("OTHER", None), "c": (None, "committed")}


def test_differences(spark):
    cells = spark.createDataFrame([("p", "t", ["r"], [c], i, c, True) for i, c in enumerate(["A", "B", "Δ"])] + [("p", "t", ["q"], ["Δ"], 2, "q", True)], "paper_id string, table_id string, row_path array<string>, col_path array<string>, col int, address string, is_numeric boolean")
    ops = grade.difference_operands(cells)
    rows = {r.address: (r.minuend, r.subtrahend) for r in ops.collect()}
    assert rows == {"Δ": ("A", "B"), "q": (None, None)}
    values = spark.createDataFrame([("A", 16.879), ("B", 10.765)], "address string, value double")
    assert harvest.differences(ops.where("minuend is not null"), values).first().value == 6.114


def test_scripts(spark):
    text = 'import numpy as np, os.path\nfrom torch.nn import x\nmodels = ["gpt2-large", "org/m-7b"]\nnames = {"tiny": "Tiny One", "huge": "Huge One", "a": "*"}\npath = f"data/scores_{n}.csv"\ndf.to_csv(path)\npd.read_csv("data/scores_tiny.csv")\n'
    s = spark.createDataFrame([("run.py", text), ("none.py", None)], "script string, text string")
    assert {(r.module, r.line) for r in scripts.imports(s).collect()} == {("numpy", 1), ("os", 1), ("torch", 2)}
    assert {r.model for r in scripts.model_lists(s).collect()} == {"gpt2-large", "org/m-7b"}
    known = spark.createDataFrame([("tiny",), ("huge",)], "value string")
    assert {(r.left, r.right) for r in scripts.aliases(s, known).collect()} == {("tiny", "Tiny One"), ("huge", "Huge One")}
    art = spark.createDataFrame([("data/scores_tiny.csv",), ("data/x.csv",)], "artifact string")
    assert [(r.artifact, r.fragment) for r in scripts.writes(s, art).collect()] == [("data/scores_tiny.csv", "data/scores_")]
    # Anywhere in a literal; not where more of the same name follows; not what is read.
    some = [("a.py", 'df.to_csv("./out/scores.csv")'), ("b.py", 'df.to_csv(f"{root}/out/scores_all.csv")'), ("c.py", 'pd.read_csv("out/scores.csv")'), ("d.py", 'p = "out/scores.{x}"\n\nwith open(p, "w") as f:'), ("e.py", 'to_csv("out/scor" + x)')]
    got = scripts.writes(spark.createDataFrame(some, "script string, text string"), spark.createDataFrame([("out/scores.csv",)], "artifact string"))
    assert {(r.script, r.fragment) for r in got.collect()} == {("a.py", "out/scores.csv"), ("d.py", "out/scores."), ("e.py", "out/scor")}
    req = spark.createDataFrame([("r", "# c\nNum_Py>=1\n-e git+x#egg=My.Pkg\n-r other\n")], "path string, text string")
    assert {r.distribution for r in scripts.requirements(req).collect()} == {"num-py", "my-pkg"}
    assert files.pyproject_names('[project]\ndependencies = ["A_b>1", "c"]') == ["a-b", "c"] and files.pyproject_names("[") == []


def test_budget(spark):
    steps = spark.createDataFrame([("r", 1, 300.0, 0.0, 0.0), ("r", 2, 300.0, 0.0, 0.0), ("r", 3, 200.0, 0.5, 3.0), ("r", 4, 200.0, 0.0, 0.0)], "run string, ord int, download_mb double, gpu_hours double, wall_hours double")
    assert [(r.ord, r.refused) for r in budget.ledger(steps).orderBy("ord").collect()] == [(1, None), (2, "download_mb"), (3, "wall_hours"), (4, None)]


def test_choose(spark):
    scored = spark.createDataFrame([("one", "a", 5.0, True), ("one", "b", 4.0, True), ("tie", "a", 5.0, True), ("tie", "b", 5.0, True), ("half", "a", 5.0, False), ("half", "b", 5.0, True), ("half", "c", 1.0, True)], "address string, path string, score double, answers boolean")
    assert {r.address: (r.path, r.tied) for r in align.choose(scored).collect()} == {"one": ("a", None), "tie": (None, ["a", "b"]), "half": ("b", None)}


def test_sources(spark, tmp_path):
    import gzip
    import io
    import tarfile

    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w") as tar:
        for name, data in [("main.tex", b"\\documentclass{a} \\input{part} \\input{part}"), ("part.tex", b"P % x"), ("../bad.tex", b"no"), ("b.bin", b"\x00\x01")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "one.tar.gz").write_bytes(gzip.compress(plain.getvalue()))
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"\\documentclass{b} x"))
    unpacked = files.read_archives(spark, str(tmp_path))
    assert {r.path for r in unpacked.collect()} == {"main.tex", "part.tex"}
    assert {r.text.split("{")[1][0]: r.text for r in files.papers(unpacked).collect()}["a"].count("P") == 1
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "main.tex").write_text("\\documentclass{a} M \\include{sub/p}")
    (tmp_path / "src" / "sub").mkdir()
    (tmp_path / "src" / "sub" / "p.tex").write_text("inner")
    assert files.read_papers(spark, str(tmp_path / "src")).first().text.split() == ["\\documentclass{a}", "M", "inner"]
    assert files.read_papers(spark, str(tmp_path / "src" / "main.tex")).first().text.startswith("\\documentclass")
    assert contracts.parse_tolerance("0.1") == {"relative": 0.1} and contracts.parse_tolerance("rel=0.1, abs=2 yellow=4") == {"relative": 0.1, "absolute": 2.0, "multiplier": 4.0}
    with pytest.raises(ValueError):
        contracts.parse_tolerance("x=1")
    default, own = contracts.read_config("[default]\nrel = 0.2\n[tables.\"t\"]\nabs = 1.0\n")
    assert default["relative"] == 0.2 and own["t"] == {"relative": 0.2, "absolute": 1.0, "multiplier": 3.0}
    with pytest.raises(ValueError):
        contracts.read_config("[default]\nrel = true\n")
    (tmp_path / "r.json").write_text('{"schema_version": "1.2", "cells": [{"address": "a", "value": 1.0}, {"address": "b", "failure": {"code": "gated_dataset", "evidence": "e"}}]}')
    rows = contracts.read_results(spark, str(tmp_path / "r.json")).orderBy("pos")
    assert [(r.address, r.value, r.failure and r.failure.code) for r in rows.collect()] == [("a", 1.0, None), ("b", None, "GATED_DATASET")]
    texts = [r.value for r in contracts.result_json(rows.withColumn("value", F.lit(None).cast("double"))).collect()]
    assert texts == ['{"address":"a","value":null}', '{"address":"b","failure":{"code":"GATED_DATASET","evidence":"e"}}']
    (tmp_path / "r2.json").write_text('{"schema_version": "2.0", "cells": []}')
    with pytest.raises(Exception, match="unsupported schema version"):
        spark.read.schema("schema_version string").json(str(tmp_path / "r2.json")).select(contracts.checked_version(F.col("schema_version"))).collect()


def test_values_of_a_column_are_followed_up_to_a_bound(spark):
    def rows(path, values):
        return [(path, i, {"c": v, "blank": " "}) for i, v in enumerate(values)]

    many = [f"v{i % 65}" for i in range(650)]
    late = [str(i) for i in range(200)] + ["x"]
    data = rows("most", [f"v{63 - i % 64}" for i in range(640)]) + rows("more", many) + rows("late", late) + rows("unique", map(str, range(500))) + rows("none", [])
    for parts in (1, 7, 40):  # where no task sees more than 64 values too
        table = spark.createDataFrame(data, "path string, row_no int, kv map<string,string>").repartition(parts)
        done = {(r.path, r.column): (r.n_values, r.is_numeric, r.is_category, r.categories) for r in profile.profile(table).collect()}
        assert done["most", "c"] == (64, False, True, [f"v{63 - i}" for i in range(64)])
        assert done["more", "c"] == done["late", "c"] == (65, False, False, None)
        assert done["unique", "c"] == (65, True, False, None)
        assert done["most", "blank"] == (0, True, False, None)
        assert {(r.path, r.column): r.n_values for r in profile.distinct_counts(table).collect()} == {("most", "c"): 64, ("more", "c"): 65, ("late", "c"): 201, ("unique", "c"): 500}
        sent = profile.bounded_values(profile.unpivot(table)).groupBy("path").count().collect()
        assert all(r["count"] <= 64 * parts for r in sent)


def test_held_columns_are_given_on(spark, monkeypatch):
    monkeypatch.setattr(profile, "HELD_COLUMNS", 0)
    spark_rows = spark.createDataFrame([("p", i, {f"c{j}": f"v{i % 3}" for j in range(3)}) for i in range(30)], "path string, row_no int, kv map<string,string>")
    assert [r.categories for r in profile.profile(spark_rows).collect()] == [["v0", "v1", "v2"]] * 3
    assert profile.profile(spark_rows.where("false")).count() == 0
