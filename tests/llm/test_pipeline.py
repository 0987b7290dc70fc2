import random

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from veritab.llm import simhash

from .test_decontam import brute as brute_hits
from .test_lines_and_quality import brute_lines
from .test_simhash import brute_labels

VOCABULARY = [f"word{i}" for i in range(2000)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with abuse, common lines, exact and near copies, and a benchmark passage."""
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(15) for _ in range(5)]
    docs = []
    for i in range(400):
        body = text(rng.randrange(30, 90)) + "\n" + text(20)
        if i % 8 == 0:
            body = body.replace(" ", " scumbag ", 4)
        if i % 5 == 0:
            body = "a common line on every single site\n" + body
        docs.append(body)
    docs += [docs[1]] * 6 + [docs[2].replace("word", "WORD", 3)] + [docs[3] + " tail"] + [text(60) + "\n" + items[0]] + [items[1] + " " + text(70)] + [None, "", "short one"]
    rows = [(i, t, "en", f"site{i % 7}", None if t is None else len(t)) for i, t in enumerate(docs)] + [(None, text(40), "en", "site1", 1), (11, text(40), "en", "site1", 1)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 16 != 8), int(i % 8 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=repr)


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]
    kept = stages["quality classifier"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rows, before = rows_of(kept), rows_of(docs)
    assert set(rows) <= set(before) and len(rows) == len(set(rows))
    abusive = [r for r in before if "scumbag" in (r[1] or "")]
    assert not [r for r in rows if "scumbag" in (r[1] or "")] and len(rows) >= 0.98 * (len(before) - len(abusive))

    done = stages["line dedup"](spark, kept, sf_dir)
    assert done.columns == docs.columns
    want = brute_lines([((r[0], r[2]), r[3], r[1]) for r in rows])
    assert sorted(((r.doc_id, r.lang), r.text) for r in done.where("text is not null and doc_id is not null").collect()) == sorted((k, t) for k, t in want if t is not None and k[0] is not None)
    rows = rows_of(done)
    assert all(r[4] == len(r[1]) for r in rows if r[1] is not None) and len(rows) == kept.count()

    single = stages["SimHash near-dedup"](spark, done, sf_dir)
    fps = np.array([simhash.fingerprint(simhash.shingle_hashes(r[1], 5), 4) for r in rows])
    label = brute_labels(fps, np.zeros(len(rows), int), 44)
    groups = {}
    for r, g in zip(rows, label, strict=True):
        groups.setdefault(g, []).append(r)
    assert len(groups) < len(rows) - 6
    kept_rows = rows_of(single)
    assert len(kept_rows) == len(groups) and all(sum(r in kept_rows for r in g) == 1 for g in groups.values())

    clean = stages["benchmark decontamination"](spark, single, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = brute_hits([(k, r[1]) for k, r in enumerate(kept_rows)], items)
    assert rows_of(clean) == sorted((r for r, h in zip(kept_rows, hits, strict=True) if not h[2]), key=repr)
    assert clean.count() < single.count()

    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(r[0]), t.encode(r[1] or "", add_special_tokens=False).ids) for r in rows_of(clean))
    assert sorted((str(r.doc_id), list(r.ids)) for r in stages["BPE encoding"](spark, clean, sf_dir).collect()) == want
    assert sorted((str(r.doc_id), list(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_every_boilerplate_line_goes(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    footer, notice, passage = text(6), text(7), [text(30), text(40)]
    # Two of three lines are boilerplate; boilerplate is most of the characters; copies; copies with a word of their own.
    rows = [(i, f"site{i}", f"{text(60)}\n{footer}\n{notice}") for i in range(6)] + [(10 + i, f"site{i}", f"own {i} words\n{footer}") for i in range(2)]
    rows += [(20 + i, f"site{i}", "\n".join([*passage, footer])) for i in range(6)] + [(30 + i, f"site{i}", "\n".join([*passage, f"edited {i} " + text(3)])) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, s, t in rows], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    want = {i: "\n".join(x for x in t.split("\n") if x not in (footer, notice)) for i, _, t in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}


@pytest.mark.parametrize(("split", "held"), [(simhash.SPLIT_SETS, simhash.HELD), (3, 0)])
def test_near_dedup_against_brute_force_similarity(spark, monkeypatch, split, held):
    monkeypatch.setattr(simhash, "SPLIT_SETS", split)
    monkeypatch.setattr(simhash, "HELD", held)
    rng = random.Random(9)
    texts = [None, "", " \t", "two words", "Two  words"]
    for k in range(40):
        words = [rng.choice(VOCABULARY) for _ in range(200)]
        texts.append(" ".join(words))
        # 196 shingles; each changed word replaces five, so similarities go from 0.95 to 0.60 across 0.8.
        for at in range(10, 10 + 10 * (1 + k % 10), 10):
            words[at] = f"new{k}x{at}"
        texts.append(" ".join(words))
    texts += [texts[5] + " " + " ".join(f"tail{k}x{j}" for j in range(8 * k)) for k in range(12)]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (not x and not y) or (x | y and len(x & y) >= 0.8 * len(x | y)):
                label = [min(label[i], label[j]) if v in (label[i], label[j]) else v for v in label]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0)], COLUMNS).repartition(3)
    kept = corpus_pipeline.dedup_near(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_empty_documents(spark, sf_dir, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.limit(0) if name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
