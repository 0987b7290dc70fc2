"""The string kernel against brute force, the machine by held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from veritab.llm import queries, toxicity
from veritab.llm.toxicity import Landmarks, cut_sentences

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def brute_kernel(s, t, decay):
    def weights(p):
        p, out = f"\x02{p}\x03", {}
        for i, j, k in itertools.combinations(range(len(p)), 3):
            if k - i <= 4:
                out[p[i] + p[j] + p[k]] = out.get(p[i] + p[j] + p[k], 0) + decay ** (k - i - 2)
        return out

    a, b = weights(s), weights(t)
    dot = lambda x, y: sum(v * y.get(f, 0) for f, v in x.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0


def test_kernel_against_brute_force():
    rng = random.Random(4)
    pieces = ["".join(rng.choices("abcé😀", k=rng.randrange(1, 9))) for _ in range(60)] + ["idiot", "idixot", "i", "aaaaaaaaaa"]
    landmarks = pieces[::3] + ["idiot"]
    want = [[brute_kernel(s, t, 0.8) for t in landmarks] for s in pieces]
    assert np.allclose(Landmarks(landmarks, 0.8).likeness(pieces), want)


def test_gaps_and_insertions_stay_alike():
    like = dict(zip(["idiot", "idixot", "xidiot", "thereat"], Landmarks(["idiot"], 0.8).likeness(["idiot", "idixot", "xidiot", "thereat"])[:, 0], strict=True))
    assert like["idiot"] == pytest.approx(1) and min(like["idixot"], like["xidiot"]) > 0.5 > 0.1 > like["thereat"]


def test_sentences_and_pieces():
    assert cut_sentences("You I-D_I.OT! Go a b\nm o r o n, x") == [["you", "idiot"], ["go", "a", "b"], ["moronx"]]
    assert cut_sentences(" .\n\n!? ") == []


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    syllables = ["the", "an", "er", "ing", "on", "re", "at", "is", "or", "ti", "hes", "nd"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    docs, labels = [], []
    for k in range(n):
        lines = [[word() for _ in range(rng.randrange(3, 15))] for _ in range(rng.randrange(1, 12))]
        toxic = k % 6 == 0
        if toxic:
            for w in rng.choices(["blockhead", "nincompoop", "scoundrel"], k=3):
                own = rng.choice(lines)
                if zlib.crc32(str(k).encode()) % 5 == 0 and rng.random() < 0.5:  # held out: gapped and with insertions
                    at = rng.randrange(2, len(w) - 1)
                    w = rng.choice([" ".join(w), ".".join(w), w[:at] + rng.choice("xz") + w[at:]])
                own.insert(rng.randrange(len(own)), w)
        docs.append((k, "\n".join(" ".join(w) + "." for w in lines)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_query_on_held_out_rows(spark, tmp_path):
    docs, labels = corpus()
    docs += [(9001, None), (9002, ""), (None, "blockhead and scoundrel."), (3, docs[3][1]), (9003, "what a b.l.o.c.k.h.e.a.d and s c o u n d r e l ." + " the ering." * 30_000)]
    labels += [(9002, None, None), (12, 1, 0), (None, 1, 1)]  # a null, a contradiction of document 12, a null id
    spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS toxic", "0.5 AS score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.queries()["op13_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted for r in held if r.doc_id % 6 == 0]) >= 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 6]) <= 0.02
    assert [r.predicted for r in got if r.doc_id in (9001, 9002)] == [0, 0]
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_given_documents(spark):
    """Held-out rows of the given tables."""
    sf = "/root/testdata/sf0.1"
    got = queries.queries()["op13_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    bad, good = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(bad) >= 0.8 and np.mean(good) <= 0.02


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1], [0, 1]])
def test_too_few_labels(spark, toxic):
    docs = spark.createDataFrame([(k, f"some words {k}") for k in (1, 2)], DOCS)
    labels = spark.createDataFrame([(k + 1, 1, t) for k, t in enumerate(toxic)], LABELS)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
