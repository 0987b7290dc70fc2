import pytest
from pyspark.sql import functions as F

from veritab.operators import extract
from veritab.plans import mapper

TABLE = r"""\begin{table}\caption{Mean score of models}\label{tab:s}\begin{tabular}{lccc}\toprule
Model & dev & test & $\Delta$ \\ \midrule
tiny & 0.85 & $0.65 \pm 0.07$ & 0.2 \\
huge & 0.91 & 0.72 & 0.19 \\ \bottomrule
\end{tabular}\end{table}"""
ROWS = [("tiny", "dev", "0.80"), ("tiny", "dev", "0.90"), ("tiny", "test", "0.60"), ("tiny", "test", "0.70")]


def artifact(spark, path, rows, columns=("model", "split", "score")):
    data = [(path, i, dict(zip(columns, r, strict=True))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "path string, row_no long, kv map<string,string>")


@pytest.fixture(scope="module")
def cells(spark):
    return extract.extract_cells(spark.createDataFrame([("p", TABLE)], "paper_id string, text string")).cache()


def test_the_whole_check(spark, cells):
    done = {r.address.split(" › ", 1)[1]: r for r in mapper.check(cells, artifact(spark, "results.csv", ROWS)).collect()}
    assert {a: r.status for a, r in done.items()} == {"tiny › dev": "GREEN", "tiny › test": "GREEN", "tiny › Δ": "GREEN", "huge › dev": "UNRUNNABLE", "huge › test": "UNRUNNABLE", "huge › Δ": "UNRUNNABLE"}
    assert done["tiny › dev"].result_value == 0.85 and done["tiny › Δ"].result_value == 0.2
    assert done["huge › dev"].failure_code == "SCRIPT_NOT_FOUND" and "huge › dev" in done["huge › dev"].evidence


def test_aliases_and_ties(spark, cells):
    rows = artifact(spark, "results.csv", [(r[0].replace("tiny", "vanilla"), *r[1:]) for r in ROWS])
    alias = spark.createDataFrame([("vanilla", "tiny", "plot.py", 3)], "left string, right string, path string, line int")
    recipes, _ = mapper.plan(cells, rows, alias)
    assert sorted(r.address.split(" › ", 1)[1] for r in recipes.collect()) == ["tiny › dev", "tiny › test"]
    assert [r.uncertainty_statistic for r in recipes.orderBy("address").collect()] == [None, "stdev"]
    both = artifact(spark, "a.csv", ROWS).unionByName(artifact(spark, "b.csv", ROWS))
    recipes, failures = mapper.plan(cells, both)
    assert recipes.count() == 0 and "a.csv, b.csv" in failures.where(F.col("address").contains("tiny › dev")).first().evidence


def test_partial_names_and_mixing(spark):
    text = TABLE.replace("tiny", "vanilla").replace("huge", "gpt-2").replace("dev", "md").replace("& test", "& xs")
    cells = extract.extract_cells(spark.createDataFrame([("p", text)], "paper_id string, text string"))
    rows = artifact(spark, "r.csv", [("vanilla", "bllip-md", "0.85"), ("vanilla", "bllip-xs", "0.65"), ("gpt-2", "bllip-md", "1"), ("gpt-2", "bllip-md-gptbpe", "2"), ("gpt-2", "bllip-xs", "0.72")])
    recipes, failures = mapper.plan(cells, rows)
    assert sorted(r.address.split(" › ", 1)[1] for r in recipes.collect()) == ["gpt-2 › xs", "vanilla › md", "vanilla › xs"]
    assert "bllip-md, bllip-md-gptbpe" in failures.first().evidence


def test_notes_and_sizes(spark):
    entry = spark.createDataFrame([("r", "b.py"), ("r", "a.py"), ("r", "b.py")], "run string, script string")
    assert mapper.provenance(entry).first().note == "from a.py, b.py"
    assert mapper.size_mb(spark.createDataFrame([("x", 1 << 20), ("y", 1 << 19)], "path string, length long")).first().mb == 1.5
