import random
import re

import pytest

from veritab.llm import decontam

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, names in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    vocabulary = ["the", "of", "é", "日本", "x1", "Foo", "bar", "baz"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(None, "only Short"), (3, "the of"), (50, None), (51, " -- ")]
    docs = [(i, make(rng.randrange(80))) for i in range(40)] + [(40, None), (41, ""), (42, "--"), (None, "only-short!"), (42, items[4][1] + " . " + items[5][1])]
    docs += [(60 + i, make(20) + "\n" + items[i][1].upper() + "," + items[i][1]) for i in range(8)]
    return docs, items


@pytest.mark.parametrize(("segment", "block"), [(decontam.SEGMENT, decontam.BLOCK), (60, 400)])
def test_against_brute_force(spark, data, monkeypatch, segment, block):
    monkeypatch.setattr(decontam, "SEGMENT", segment)
    docs, items = data
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, spans string").repartition(2)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, terms int")
    found = decontam.search(decontam.build_index(d), b, block_bytes=block)
    got = [(r.doc_id, r.n_words, r.n, r.items) for r in found.select("doc_id", "n_words", decontam.n_hit().alias("n"), "items").collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables(spark, data):
    docs, items = data
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    assert all(not r.spans for r in decontam.decontaminate(d, b.limit(0)).collect())


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha x x x x x x x beta gamma"), (3, "beta alpha"), (4, "gamma beta alpha")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "gamma alpha beta")], "item_id string, text string")
    found = decontam.search(decontam.build_index(d), b, within=5)
    assert sorted(r.doc_id for r in found.collect() if r["items"]) == [1, 4]


def test_equal_segments_stay_apart(spark, data, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT", 60)  # each of these documents is a segment
    _, items = data
    docs = [(7, "x1 " * 30 + items[4][1])] * 3 + [(8, "x1 " * 30)] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.search(decontam.build_index(d.union(d)), b, block_bytes=400)
    got = [(r.doc_id, r.n_words, r.n, r.items) for r in found.select("doc_id", "n_words", decontam.n_hit().alias("n"), "items").collect()]
    assert sorted(got) == sorted(brute(docs + docs, items))


def test_words_that_share_a_hash(spark):
    """Two words of 1,024 letters with one polynomial hash are two words, in documents and in items."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = [(1, a), (2, b), (3, f"{a} {b} x"), (4, f"{b} {a} x"), (5, f"x {b}")]
    items = [("p", a), ("q", f"{a} {b}"), ("r", f"x {b}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    found = decontam.decontaminate(d, spark.createDataFrame(items, "item_id string, text string"))
    got = [(r.doc_id, r.n_words, r.n, r["items"]) for r in found.select("doc_id", "n_words", decontam.n_hit().alias("n"), "items").collect()]
    assert sorted(got) == sorted(brute(docs, items))


def test_texts_of_megabytes(spark):
    words_ = [f"w{i % 997}" for i in range(700_000)]
    item = "needle one two three four five six seven eight nine ten"
    text = " ".join(words_[:400_000]) + " " + item.upper() + " " + " ".join(words_[400_000:])
    d = spark.createDataFrame([(1, text), (2, "z" * 5_000_000)], "doc_id long, text string")
    found = decontam.decontaminate(d, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: (r.n_words, [list(s) for s in r.spans]) for r in found.collect()} == {1: (700_011, [[400_000, 400_010]]), 2: (1, [])}


def test_digest_columns(spark):
    """The registered query against the brute-force rule on the smallest tables."""
    import hashlib

    from veritab.llm import queries

    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    index = {}
    for name, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else ():
            index.setdefault(tuple(w[s : s + 10]), set()).add(str(name))
    want = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in index}:
            for s in range(len(w) - size + 1):
                if (names := index.get(tuple(w[s : s + size]))) is not None:
                    hit |= set(range(s, s + size))
                    found |= names
        want.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = queries.op6_decontaminate(spark, path).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[-1] for r in want)


def test_repeated_items_make_no_large_block(spark, monkeypatch):
    """3,000 copies of one item are one; different items spread over blocks of bounded size."""
    from veritab.llm import decontam
    from veritab.llm.common import read_block, write_blocks

    text = " ".join(f"w{k}" for k in range(800))
    items = [("same", text)] * 3000 + [(f"i{k}", f"{text} {k}") for k in range(60)]
    blocks: list[list[str]] = []
    monkeypatch.setattr(decontam, "write_blocks", lambda df, make, most: blocks.extend(paths := write_blocks(df, make, most)) or paths)
    docs = spark.createDataFrame([(1, f"x {text} y"), (2, "w1 w2 w3")], "doc_id long, text string")
    got = decontam.search(decontam.build_index(docs), spark.createDataFrame(items, "item_id string, text string").repartition(6), block_bytes=1 << 16)
    assert sorted((r.doc_id, len(r["items"])) for r in got.collect()) == [(1, 61), (2, 0)]
    names = [read_block(p).names for p in blocks]
    assert max(len(n) for n in names) * len(text) <= 2 << 16 and sorted(sum(names, [])) == sorted({i for i, _ in items})
