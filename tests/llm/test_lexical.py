"""Ranked search against brute force and against its SQL."""

import collections
import math
import random
import re

import duckdb
import pytest

from veritab.llm import lexical, queries

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=20):
    counted = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    N, L = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for name, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(name, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


def tables(seed=1):
    rng = random.Random(seed)
    pool = ["Alpha", "BETA", "gamma", "Größe", "ÄRA", "x1", "zwölf", "the", "the", "the", "of", "of"] + [f"t{k}" for k in range(60)]
    docs = [(k, rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(pool, k=rng.randrange(1, 60)))) for k in range(400)]
    docs += [(1000 + k, "Alpha of the t1 t2 t3") for k in range(60)]  # ties
    docs += [(1, "Alpha"), (1, "Alpha"), (500, None), (501, ""), (502, " .,;"), (503, "the " * 5000)]
    items = [(f"i{k}", " ".join(rng.choices(pool, k=rng.randrange(1, 12)))) for k in range(30)]
    items += [("same", "Alpha t1 t1"), ("same", "Alpha t1 t1"), ("same", "t2"), ("none", None), ("empty", "!"), ("absent", "nowhere"), (None, "gamma")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK, 200])
def test_against_brute_force(spark, block_bytes):
    docs, items = tables()
    docs.append((None, "Alpha t1 t2"))
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_query_against_its_sql(spark, tmp_path):
    docs, items = tables(2)
    spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS item_id", "1 AS n").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.sql(queries.oracle_sql()["op12_lexical_search"]).fetchall()
    got = queries.queries()["op12_lexical_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) == brute(docs, items)


@pytest.mark.parametrize("n_docs, n_items", [(0, 3), (3, 0), (0, 0)])
def test_empty_tables(spark, n_docs, n_items):
    docs, items = tables()
    got = lexical.search(spark.createDataFrame(docs[:n_docs], DOCS), spark.createDataFrame(items[:n_items], ITEMS))
    assert got.count() == 0


def test_heaps_keep_the_least_ids_of_ties(spark):
    docs = [(k, "alpha beta") for k in reversed(range(3000))] + [(9999, None)]
    docs += [(5000 + k, "gamma") for k in range(3000)]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([("i", "alpha")], ITEMS), k=7).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == [(k + 1, k) for k in range(7)]


def test_item_ids_keep_their_type(spark):
    items = spark.createDataFrame([(7, "alpha"), (None, "beta")], "item_id long, text string")
    got = lexical.search(spark.createDataFrame([(1, "alpha beta")], DOCS), items)
    assert got.schema["item_id"].dataType.simpleString() == "bigint"
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == [(7, 1, 1), (None, 1, 1)]
