"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from veritab.llm import periodic, queries
from veritab.llm.periodic import Grammar

SCHEMA = "doc_id long, text string"


def brute_runs(words, least=12):
    """Every maximal stretch of every period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), best[0], best[1], best[2], milli, sha(listed), sha(" ".join(brute_collapsed(words, runs))))


def texts(seed=3):
    rng = random.Random(seed)
    for k in range(300):
        alphabet = rng.choice([1, 2, 3, 50])
        words = [f"w{rng.randrange(alphabet)}" for _ in range(rng.randrange(80))]
        if k % 3 == 0:
            unit = [f"u{rng.randrange(4)}" for _ in range(rng.randrange(1, 15))]
            words[5:5] = (unit * 12)[: rng.randrange(60)]
        yield rng.choice([" ", "\n", "  \t"]).join(words)
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:  # Fibonacci words: many runs
        a, b = b, b + a
    yield " ".join(b)
    yield "x " * 3000
    yield "x y " * 20 + "x y " * 20
    yield ""
    yield None
    yield " \t\r\n\x0b\f "


def test_query_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts())) + [(7, "again " * 13), (7, "again " * 13)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.queries()["op11_periodic_runs"](spark, str(tmp_path))
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted((expected(*r) for r in rows), key=lambda r: r)


def test_extensions_against_scanning():
    rng = np.random.default_rng(5)
    for sizes in ([40], [1, 60, 3, 200], [500, 2, 2, 2]):
        symbols = np.concatenate([np.append(rng.integers(0, rng.integers(1, 4), n), -1 - k) for k, n in enumerate(sizes)])
        grammar = Grammar(symbols)
        a, b = rng.integers(0, len(symbols), (2, 4000))
        a, b = a[a != b], b[a != b]
        ahead = [next(k for k in range(len(symbols)) if max(x, y) + k >= len(symbols) or symbols[x + k] != symbols[y + k]) for x, y in zip(a, b, strict=True)]
        behind = [next(k for k in range(len(symbols) + 1) if min(x, y) - k == 0 or symbols[x - k - 1] != symbols[y - k - 1]) for x, y in zip(a, b, strict=True)]
        assert grammar.extend(a, b).tolist() == ahead
        assert grammar.extend_back(a, b).tolist() == behind


def test_grammar_shrinks_to_one_symbol_a_text():
    symbols = np.append(np.tile([1, 2, 3, 3, 2], 4000), -1)
    grammar = Grammar(symbols)
    assert len(grammar.forward[-1].symbols) == 3
    assert len(grammar.forward) < 60


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "a b " * 9)]])
def test_nulls_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS runs", "'x' AS collapsed")
    got = periodic.periodic_runs(periodic.with_planted_runs(docs)).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs]) for r in got] == [(d, [(0, 18, 2)] if t else []) for d, t in rows]


def test_long_text(spark):
    text = " ".join(f"w{k * k % 1009}" for k in range(300_000))
    got = periodic.periodic_runs(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert [tuple(r) for r in got.runs] == [(0, 300_000, 1009)]
    assert got.collapsed == " ".join(text.split()[:1009])
