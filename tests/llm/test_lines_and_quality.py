import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import line_dedup, quality


def brute_lines(rows, min_sites=5):
    """Equal texts count once, on the least of their sites; every line on min_sites sites goes from every row."""
    least, sites = {}, {}
    for _, site, text in rows:
        if text is not None:
            least[text] = min(least.get(text, site or "\0"), site or "\0")
    for text, site in least.items():
        for line in text.split("\n"):
            if t := line.strip(line_dedup.BLANK):
                sites.setdefault(t, set()).add(site)
    bad = {t for t, s in sites.items() if len(s) >= min_sites}
    return [(i, text if text is None else "\n".join(x for x in text.split("\n") if x.strip(line_dedup.BLANK) not in bad)) for i, _, text in rows]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(2)
    common = [f"common line number {i} here" for i in range(8)] + ["two words", "  padded common line of text \t"]
    rows = []
    for i in range(120):
        own = [f"own line {i} {k} " + "x" * rng.randrange(40) for k in range(rng.randrange(1, 6))]
        picked = [c for k, c in enumerate(common) if rng.random() < 0.05 * (k + 1)]
        body = own + picked
        rng.shuffle(body)
        rows.append((i, f"site{rng.randrange(9)}", "\n".join(body)))
    rows += [(200 + i, f"site{i}", "a copy of a document\nwith two lines in it") for i in range(8)]
    return [*rows, (300, None, common[0] + "\nown text of the null site, rather long"), (301, "s", None), (302, "s", ""), (303, "s", "\n\n"), (0, "site1", rows[0][2])]


@pytest.mark.parametrize("small", [line_dedup.SMALL, 0])
def test_lines_against_brute_force(spark, lines, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    docs = spark.createDataFrame([(i, s, t, "c", 1) for i, s, t in lines], "doc_id long, source string, text string, hash string, line int").repartition(3)
    got = line_dedup.remove_boilerplate(docs)
    assert got.columns == docs.columns
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute_lines(lines), key=key)
    counts = line_dedup.remove_boilerplate(docs.withColumnRenamed("line", "n"), count_col="line").collect()
    before = {(i, s): t for i, s, t in lines}
    assert all(r.line == (0 if r.text is None else len(before[r.doc_id, r.source].split("\n")) - (len(r.text.split("\n")) if r.text or not r.line else 0)) for r in counts)
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


def test_no_document_is_exempt(spark):
    """Short lines, documents that are boilerplate for the most part, and copies, which keep what only they share."""
    rows = [(i, f"s{i}", f"Menu\na footer on every site\nown text {i}") for i in range(6)] + [(10 + i, f"s{i}", "copied line one\ncopied line two\nMenu") for i in range(7)]
    rows += [(20, "s0", "Menu"), (21, "s1", "Menu\n\n" + "x" * 3_000_000)]
    docs = spark.createDataFrame([(i, t, s) for i, s, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got == {i: f"own text {i}" for i in range(6)} | {10 + i: "copied line one\ncopied line two" for i in range(7)} | {20: "", 21: "\n" + "x" * 3_000_000}


def test_kth_largest(spark):
    values = [5, -3, 7, 7, 0, -(1 << 62), 1 << 62, 12, None]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    ordered = sorted((v for v in values if v is not None), reverse=True)
    assert [quality.kth_largest(df, "key", k) for k in range(1, 9)] == ordered
    assert quality.kth_largest(df, "key", 9) is None and quality.kth_largest(df.limit(0), "key", 1) is None


def brute_selection(docs, labels, evidence=5.0):
    """(id, log weight, key, selected) of each document by plain loops; docs: (id, text), labels: (id, quality, toxic)."""
    from struct import pack

    import pyarrow as pa
    import xxhash
    from veritab.llm.common import text_bytes

    def grams(text):
        words, pairs, follows, _ = quality.features(*text_bytes(pa.array([text or ""])))
        return words.tolist(), [p for p, f in zip(pairs.tolist(), follows.tolist(), strict=True) if f]

    hashed = lambda i, salt: xxhash.xxh64_intdigest(salt, 42 if i is None else xxhash.xxh64_intdigest(pack("<q", i), 42))
    signed = lambda h: h - (h >> 63 << 64)
    seen = {}
    for i, q, t in labels:
        if None not in (i, q, t):
            seen.setdefault(i, set()).add(q == 1 and t == 0)
    good = {i: v.pop() for i, v in seen.items() if len(v) == 1}
    held = {i for i in good if signed(hashed(i, b"fold")) % 4 == 0}
    counts = [({}, {}), ({}, {})]
    for i, text in docs:
        for kind, own in enumerate(grams(text)):
            for f in own:
                counts[kind][0][f] = counts[kind][0].get(f, 0) + 1
                if good.get(i) and i not in held:
                    counts[kind][1][f] = counts[kind][1].get(f, 0) + 1
    ratio = ({}, {})
    for kind, (raw, target) in enumerate(counts):
        share = sum(target.values()) / max(1, sum(raw.values()))
        for f, n in raw.items():
            t, e = target.get(f, 0), n * share
            if share and abs(t - e) > evidence * math.sqrt(e + 1):
                ratio[kind][f] = round(math.log((t + 1) / (e + 1)) * 1e6)
    weight = [sum(ratio[k].get(f, 0) for k, own in enumerate(grams(t)) for f in own) / 1e6 for _, t in docs]
    tried = {i: (w, good[i]) for (i, _), w in zip(docs, weight, strict=True) if i in held}
    bad, fine = [w for w, g in tried.values() if not g], [w for w, g in tried.values() if g]
    cuts = sorted(w for w, _ in tried.values())
    gain = lambda c: sum(w < c for w in bad) / len(bad) - 5.0 * sum(w < c for w in fine) / len(fine)
    cut = max([(0.0, -math.inf), *((gain(c), -k) for k, c in enumerate(cuts))])[1]
    k = len(docs) if cut == -math.inf else sum(w >= cuts[int(-cut)] for w in weight)
    noise = lambda i: -math.log(-math.log((signed(hashed(i, b"gumbel")) % (1 << 53) + 0.5) / (1 << 53)))
    keys = [round((w + noise(i)) * 1e6) for (i, _), w in zip(docs, weight, strict=True)]
    threshold = sorted(keys, reverse=True)[k - 1]
    return [(i, w, x, x >= threshold) for (i, _), w, x in zip(docs, weight, keys, strict=True)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        bad = i % 10 == 0
        if bad:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(["scumbag", "dolt"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "null id " * 3), (3, rows[3][1])], "doc_id long, text string").withColumn("selected", F.lit("clash"))
    return docs, spark.createDataFrame([*labels, (2, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    scored, classifier = quality.resample(docs, labels)
    rows = scored.collect()
    assert len(rows) == docs.count() and math.isfinite(classifier.cut)
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 2 == 1]
    assert np.mean([r.selected for r in unseen]) > 0.98  # none of these is bad
    bad = [r for r in rows if r.doc_id is not None and r.doc_id < 1500 and r.doc_id % 10 == 0]
    assert np.mean([not r.selected for r in bad]) > 0.95
    kept = classifier.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.selected)
    # k keys are selected, and no key below them.
    k = sum(r.log_weight >= classifier.cut for r in rows)
    assert sum(r.selected for r in rows) >= k and min(r.gumbel_key for r in rows if r.selected) >= max((r.gumbel_key for r in rows if not r.selected), default=-math.inf)


def test_whole_selection_against_brute_force(spark, corpus):
    docs, labels = corpus
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_selection(rows, [tuple(r) for r in labels.collect()])
    got = quality.resample(docs, labels)[0].collect()
    form = lambda rows_: sorted((str(i), round(w, 6), bool(s)) for i, w, s in rows_)
    assert form((r.doc_id, r.log_weight, r.selected) for r in got) == form((i, w, s) for i, w, _, s in want)
    keys = lambda rows_: sorted(rows_, key=str)
    assert all(i == j and abs(x - y) < 3e-6 for (i, x), (j, y) in zip(keys((str(r.doc_id), r.gumbel_key) for r in got), keys((str(i), x / 1e6) for i, _, x, _ in want), strict=True))
    assert 0 < sum(not s for *_, s in want) < len(want)


def test_ties_and_long_texts(spark, corpus):
    """Equal weights differ by their ids' noise alone; a text of megabytes has the weight of its parts."""
    docs, labels = corpus
    text = "scumbag " * 400_000
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(9100, text), (9101, "scumbag " * 4), (9102, "scumbag " * 4), (9101, "scumbag " * 4)], "doc_id long, text string"))
    rows = {}
    for r in quality.resample(more, labels)[0].collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[9100][0].log_weight < 50_000 * rows[9101][0].log_weight < 0 and not rows[9100][0].selected
    assert rows[9101][0] == rows[9101][1] and rows[9101][0].log_weight == rows[9102][0].log_weight and rows[9101][0].gumbel_key != rows[9102][0].gumbel_key


def test_without_labels(spark, corpus):
    docs, labels = corpus
    scored, classifier = quality.resample(docs, labels.limit(0))
    assert all(r.selected and r.log_weight == 0 for r in scored.collect())
    assert classifier.keep(docs).count() == docs.count()
    assert quality.resample(docs.limit(0), labels)[0].count() == 0
