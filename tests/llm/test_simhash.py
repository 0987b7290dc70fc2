import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veritab.llm import graph, simhash
from veritab.llm.common import staged

rng = np.random.default_rng(5)


def brute_labels(fps, group, radius):
    d = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(-1)
    near = (d <= radius) & (group[:, None] == group[None, :])
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))], dtype=np.int64)
        new = new[new] if len(new) else new
        if np.array_equal(new, label):
            return label
        label = new


@pytest.mark.parametrize(("n", "width", "radius"), [(1, 1, 4), (2, 1, 4), (64, 1, 4), (65, 1, 3), (300, 1, 4), (200, 4, 44), (130, 1, 0), (500, 1, 9)])
def test_linked_against_brute_force(n, width, radius):
    fps = rng.integers(0, 2**63, size=(n, width), dtype=np.uint64)
    for _ in range(n // 2):
        f = fps[rng.integers(0, n)].copy()
        for b in rng.choice(64 * width, rng.integers(0, radius + 3), replace=False):
            f[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        fps[rng.integers(0, n)] = f
    group = np.sort(rng.integers(0, 4, n))
    assert np.array_equal(simhash.linked(fps, group, radius), brute_labels(fps, group, radius))


def reference(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    out = [None, "", "  \t", "one two", "ONE  two", "é x y z"]
    for b in base:
        out += [b, b.upper(), b.replace(" ", "\n"), b + " extra"]
        words = b.split()
        words[60] = "changed"
        out.append(" ".join(words))
    return out


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 4)  # every bucket with a few nodes is dealt into chunks
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: (r.word, r.component_id) for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_word("fp").alias("word"), "component_id").collect()}
    prints = [reference(t) for _, t, _ in rows]
    label = brute_labels(np.array(prints, np.uint64)[:, None], np.zeros(len(rows), int), 4)
    assert [got[i][0] for i in range(len(rows))] == [f"{p:016x}" for p in prints]
    assert [got[i][1] for i in range(len(rows))] == label.tolist()
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "alone with a null id here"), (7, "another text under the same id as one"), (3, "one two"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    kept = simhash.keep_one(docs, shingle=5, radius=44, width=4, smallest=8)
    assert kept.columns == ["doc_id", "text", "row"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # The wordless, the two-word and the accented text, one of each of twelve groups, the null id and the repeated id.
    assert len(got) == len(set(got)) == 3 + 12 + 2
    assert {i for i, _ in got} >= {0, 3, 5, None, 6, 7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 200), (200, 100), (5, 5), (None, 3)]
    hub = [(1000, 2000 + i) for i in range(200)]
    roots = graph.components(spark.createDataFrame(edges + hub, "a long, b long"))
    groups = {}
    for r in roots.collect():
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 10, 10, 10, 10, 201]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_take_logarithmic_rounds(spark, monkeypatch):
    """A path of 1,000 ascending nodes is one component; each round writes its edges once."""
    rounds = []

    def counted(df, name="table"):
        rounds.append(name)
        return staged(df, name)

    monkeypatch.setattr(graph, "staged", counted)
    edges = spark.range(999).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(5000, 5001), (7, 7), (None, 3)], "a long, b long"))
    found = graph.components(edges).collect()
    assert len(found) == 1002 and len({r.root for r in found if r.node < 1000}) == 1 and len({r.root for r in found}) == 2
    assert rounds.count("points") <= 12


def test_one_template_is_joined_without_chunks(spark, monkeypatch):
    """Texts of one template: one link each confirms them, and no set is sent to a chunk."""
    template = [f"word{k}" for k in range(400)]
    rows = [(n, " ".join([*template[:200], f"name{n}", *template[200:]])) for n in range(3000)] + [(5000, "unlike all of the others in the whole table")]
    monkeypatch.setattr(simhash, "confirmed_chunks", lambda *args: pytest.fail("sets were dealt into chunks"))
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 0.8, shingle=5, radius=70, width=4, smallest=8)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(n, 0) for n in range(3000)} | {(5000, 5000)}


def test_a_common_passage_sends_no_set_to_every_chunk(spark, monkeypatch):
    """Texts that share a passage and little else are one component of candidates; a set is sent only where it may be similar."""
    monkeypatch.setattr(simhash, "SPLIT_SETS", 16)
    sent, whole = [], simhash.confirmed_chunks

    def counted(sets, *args):
        sent.append(sets.count())
        return whole(sets, *args)

    monkeypatch.setattr(simhash, "confirmed_chunks", counted)
    own = np.random.default_rng(3)
    passage = [f"common{k}" for k in range(30)]
    rows = []
    for n in range(400):
        words = [*passage, *[f"w{x}" for x in own.integers(0, 10**9, 40)]]
        rows.append((n, " ".join(words)))
        if n % 20 == 0:  # a text with a similar one
            words[50] = "changed"
            rows.append((1000 + n, " ".join(words)))
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 0.5, shingle=5, radius=100, width=4, smallest=8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {n: n % 1000 for n, _ in rows}
    assert sum(sent) <= 2 * len(rows)


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_groups_part_nothing_similar(spark, least):
    """All pairs of a component that are similar and in two parts are in one group; texts of two components never are."""
    own = np.random.default_rng(6)
    sets, common = [], own.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(60):
        base = np.concatenate([own.choice(common, own.integers(0, 30), replace=False), own.integers(0, 2**63, own.integers(1, 30), dtype=np.uint64)])
        for _ in range(own.integers(1, 5)):
            kept = base[own.random(len(base)) < own.choice([0.7, 0.85, 0.95, 1.0])]
            sets.append(np.unique(kept))
    names = [f"{i:04d}".encode() for i in range(len(sets))]
    root = [int(x) for x in own.integers(0, 3, len(sets))]
    part = [i if own.random() < 0.8 else max(k for k in range(i + 1) if root[k] == root[i] and (k == i or own.random() < 0.2)) for i in range(len(sets))]
    part = [p if part[p] == p else i for i, p in enumerate(part)]
    rows = [(names[i], names[part[i]], f"root{root[i]}".encode(), 2, len(s)) for i, s in enumerate(sets)]
    several = spark.createDataFrame(rows, "fp binary, part binary, root binary, chunks int, size bigint")
    held = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(names, sets, strict=True)], "fp binary, set binary")
    group = {bytes(r.fp): bytes(r.root) for r in simhash._sharing(several, held, least).collect()}
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j] and part[i] != part[j] and len(sets[i]) and simhash.shares(sets[i], sets[j], least)]
    assert len(similar) > 20 and all(group[names[i]] == group[names[j]] for i, j in similar)
    assert all(root[i] == root[j] for i in range(len(sets)) for j in range(i) if group.get(names[i], 0) == group.get(names[j], 1))
    assert len(group) < len(sets)
