"""Documents with a commit protocol, plans that replace themselves, tries and rarest stretches."""

import json

import pytest
from pyspark.sql import functions as F

from veritab.operators import align, scripts
from veritab.sources import contracts, documents, plan_cache

RESULT = "run_id string, pos int, address string, value double, uncertainty double, n_seeds int, failure struct<code:string,evidence:string>, caveats array<string>"


def test_results_come_back_as_they_were(spark, tmp_path):
    folder = f"file://{tmp_path}/runs"
    rows = [
        ("a", 0, "t › x", 1.5, 0.25, 3, None, ["c1", "c2"]),
        ("a", 1, 't › "y"\n', None, None, None, None, []),
        ("a", 2, "t › z", None, None, None, ("OTHER", "says why"), []),
        ("12e4", 0, "t › x", 0.1 + 0.2, None, None, None, []),
    ]
    sent = spark.createDataFrame(rows, RESULT)
    contracts.write_results(sent, folder, spark.createDataFrame([("a", {"k": "v"}), ("bare", {})], "run_id string, run map<string,string>"))
    back = contracts.read_runs(spark, folder).orderBy("run_id", "pos").collect()
    assert [r.run_id for r in back] == ["12e4", "a", "a", "a", "bare"]
    assert sorted(tuple(r)[0:1] + tuple(r)[2:] for r in back if r.address) == sorted(tuple(r) for r in sent.collect())
    assert {r.run_id: r.run for r in back} == {"a": {"k": "v"}, "12e4": {}, "bare": {}}


def test_a_document_written_again_replaces_itself(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    made = lambda *pairs: spark.createDataFrame(pairs, "id string, document string").repartition(3)
    documents.write_documents(made(("a", "1"), ("b", "2\n ")), folder)
    documents.write_documents(made(("a", "3")), folder)
    got = documents.read_documents(spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "1"), ("a", 2, "3"), ("b", 1, "2\n ")]
    assert sorted(tuple(r) for r in documents.latest(got).collect()) == [("a", "3"), ("b", "2\n ")]
    documents.write_documents(made(("c", "4")), folder, mode="overwrite")
    assert [tuple(r) for r in documents.read_documents(spark, folder).collect()] == [("c", 3, "4")]
    assert len(list((tmp_path / "docs").glob("part-*"))) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    good = spark.createDataFrame([("a", "1")], "id string, document string")
    documents.write_documents(good, folder)
    bad = spark.range(4, numPartitions=2).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise("x").alias("document"))
    with pytest.raises(Exception, match="stop"):
        documents.write_documents(bad, folder)
    assert [tuple(r) for r in documents.read_documents(spark, folder).collect()] == [("a", 1, "1")]
    assert documents.read_documents(spark, f"file://{tmp_path}/nothing").count() == 0


def test_other_versions_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    documents.write_documents(spark.createDataFrame([("a", '{"schema_version":"2.0","cells":[]}')], "id string, document string"), folder)
    with pytest.raises(Exception, match="unsupported schema version: 2.0"):
        contracts.read_runs(spark, folder).collect()
    manifest = tmp_path / "docs" / documents.MANIFEST
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"schema_version": "7.1"}))
    with pytest.raises(Exception, match="unsupported schema version: 7.1"):
        documents.read_documents(spark, folder).collect()


def test_plans_replace_themselves(spark, tmp_path, monkeypatch):
    folder, schema = f"file://{tmp_path}/plans", "address string, n int"
    load = lambda *key: (lambda p: p and sorted(tuple(r) for r in p.select("address", "n").collect()))(plan_cache.load_plan(spark, folder, *key, schema))
    assert load("12e4", "m", "p") is None
    plan = spark.createDataFrame([("x", 1, "p"), ("y", 2, "p"), ("z", 3, "000012")], f"{schema}, paper_key string")
    for commit in ("12e4", "120000", "12e4"):
        plan_cache.store_plan(plan, folder, commit, "m")
    assert load("12e4", "m", "p") == load("120000", "m", "p") == [("x", 1), ("y", 2)]
    assert load("12e4", "m", "000012") == [("z", 3)]
    assert load("12e4", "m", "12") is load("120000.0", "m", "p") is load("12e4", "other", "p") is None
    plan_cache.store_plan(plan.where("n = 2"), folder, "12e4", "m", papers=plan.select("paper_key"))
    assert load("12e4", "m", "p") == [("y", 2)] and load("12e4", "m", "000012") == []
    assert load("120000", "m", "p") == [("x", 1), ("y", 2)]
    monkeypatch.setattr(plan_cache, "VERSION", "1.1")
    assert load("12e4", "m", "p") is None


def test_scripts_meet_only_what_they_write(spark):
    """Files below one folder share their first characters; pairs stay those of the result."""
    n = 300
    text = spark.range(n).select(F.format_string("s%d.py", "id").alias("script"), F.format_string('x.to_csv("results/run_%03d.csv")\nopen("results/")\n', "id").alias("text"))
    art = spark.range(n).select(F.format_string("results/run_%03d.csv", "id").alias("artifact"))
    trie = scripts.fragment_trie(art)
    found = scripts.written_fragments(text, trie)
    assert found.join(trie, "node").count() <= 2 * n
    got = scripts.writes(text, art).collect()
    assert sorted((r.script, r.artifact, r.fragment) for r in got) == sorted((f"s{k}.py", f"results/run_{k:03d}.csv", f"results/run_{k:03d}.csv") for k in range(n))


def test_writes_against_scanning(spark):
    import re

    text = 'df.to_csv(f"out/scores_{n}.csv")\nwriter = open("out/other.txt", "w")\ny = pd.read_csv("out/other_more.csv")\nnp.save(xout/scores_all-b)\nsavefig("plots/a")'
    paths = ["out/scores_a.csv", "out/scores_all-b.npy", "out/other.txt.gz", "out/other_more.csv", "plots/abc.png", "plots/a", "scores_of_all.csv", "out/sc"]

    def brute(path):
        floor = max(8, path.rfind("/") + 5)
        for m in range(len(path), floor - 1, -1):
            for line in text.split("\n"):
                if "read_csv" not in line and any(not re.match(r"[\w-]", line[k + m : k + m + 1] or ".") for k in range(len(line)) if line.startswith(path[:m], k)):
                    return path[:m]

    got = scripts.writes(spark.createDataFrame([("s.py", text)], "script string, text string"), spark.createDataFrame([(p,) for p in paths], "artifact string"))
    assert {r.artifact: r.fragment for r in got.collect()} == {p: f for p in paths if (f := brute(p))}


def test_contained_looks_names_up_by_their_rarest_stretch(spark):
    needles, texts = [f"commonbeginning{k}z" for k in range(400)] + ["abc", "nowhere", "beginning399"], [f"xcommonbeginning{k}z" for k in range(400)] + ["ab", "zzabczz"]
    got = align.contained(spark.createDataFrame([(x,) for x in needles], "norm string"), spark.createDataFrame([(x,) for x in texts * 2], "text string"), 3)
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n in needles for t in texts if n in t)
