import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from veritab.llm import bpe, token_store  # noqa: E402
from veritab.llm.common import Store  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", "   \n", "It's HERE, they'Re I'LL 12.5!!", "ΣΑΣ İstanbul ﬁ ½ ² 漢字 é é", "<|endoftext|> x<|startoftext|>y <| no |>", "a\x1cb\x85c d​e",
    "word " * 200, "x" * 5000, "a  b\t c\n\n d \n", " lead", "trail ", "a\x00b", "don't 's 've", "--==++", "\U0001f600 smile",
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_words_as_the_library(spark):
    t = library(WORD)
    rows = spark.createDataFrame([(i, x, i) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids int")
    for r in bpe.round_trip(rows, WORD).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids, TEXTS[r.doc_id]
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    again = bpe.decode_documents(bpe.encode_documents(rows, WORD), WORD)
    assert {r.doc_id: r.decoded for r in again.collect()}[3] == t.decode(t.encode(TEXTS[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(rows.limit(0), WORD).count() == 0


def brute(symbols, ranks, merged):
    symbols = list(symbols)
    while True:
        found = [(ranks[k], i) for i in range(len(symbols) - 1) if (k := symbols[i] << bpe.SIDE | symbols[i + 1]) in ranks]
        if not found:
            return symbols
        rank, i = min(found)
        symbols[i : i + 2] = [merged[rank]]


def test_merges_against_brute_force():
    rng = random.Random(3)
    for n in [0, 1, 2, 3, 31, 32, 33, 64, 65, 200] * 6:
        ranks, merged, top = {}, [], 6
        for _ in range(40):
            a, b = rng.randrange(top), rng.randrange(top)
            if (a << bpe.SIDE | b) not in ranks:
                ranks[a << bpe.SIDE | b] = len(merged)
                merged.append(top)
                top += 1
        words = [[rng.randrange(6) for _ in range(rng.randrange(n + 1))] for _ in range(20)]
        want = [brute(w, ranks, merged) for w in words]
        assert [bpe.merge(list(w), ranks, merged) for w in words] == want
        grid = np.full((20, 1 << max(0, n - 1).bit_length()), -1, np.int64)
        for row, w in zip(grid, words, strict=True):
            row[: len(w)] = w
        done = bpe.merge_side_by_side(grid, bpe.PairRanks(ranks, merged))
        assert [[int(x) for x in row if x >= 0] for row in done] == want


def test_store_keeps_results_when_full():
    rng = random.Random(1)
    store = Store(lambda keys: [k * 2 for k in keys], 5, {"x": 1})
    for _ in range(200):
        wanted = {str(rng.randrange(9)) for _ in range(rng.randrange(5))} | {"x"}
        have = store.learned(wanted)
        assert {k: have[k] for k in wanted} == {k: 1 if k == "x" else k * 2 for k in wanted}
        assert len(store.new) <= 6


def test_whole_documents_as_the_library(spark):
    """Every document of the smallest tables, each word of which goes through the tree; a store that overflows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = library(WORD)
    got = {r.doc_id: r for r in bpe.round_trip(docs, WORD).collect()}
    for d in docs.collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids
        assert list(got[d.doc_id].ids) == ids
        assert got[d.doc_id].decoded == t.decode(ids, skip_special_tokens=False)


def test_words_of_megabytes(spark):
    """A word's cost grows with n log n; the library checks a shorter one."""
    t = library(WORD)
    rng = random.Random(5)
    for text in ["".join(rng.choice("abc") for _ in range(20_000)), "ab" * 10_000]:
        assert np.frombuffer(bpe.load(WORD).encode([text])[0], np.int32).tolist() == t.encode(text, add_special_tokens=False).ids
    rows = spark.createDataFrame([(1, "a" * 1_000_000), (2, "word " * 400_000)], "doc_id long, text string")
    sizes = {r.doc_id: len(r.ids) for r in bpe.encode_documents(rows, WORD).collect()}
    assert sizes[2] == 400_000 and sizes[1] > 0


@pytest.mark.parametrize("file_bytes", [token_store.FILE, 40])
def test_shards(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(token_store, "FILE", file_bytes)
    t = library(BYTE)
    rows = [(i * 3 % 50, x, "clash") for i, x in enumerate(TEXTS * 2)] + [(None, "null id", "c"), (None, None, "c"), (-5, "minus", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    manifest = token_store.write_shards(docs, BYTE, shards=3)
    assert manifest.count() > 3 or file_bytes > 40
    back = token_store.read_shards(manifest).collect()
    assert len(back) == len(rows)
    back.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in back]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and ids[:2] == [None, None]
    total = 0
    for r in back:
        assert r.start == total and r.n_tokens == len(r.ids) // 4
        total += r.n_tokens
    want = sorted(tuple([*t.encode(x or "", add_special_tokens=False).ids, 0]) for _, x, _ in rows)
    assert sorted(tuple(np.frombuffer(r.ids, np.uint32).tolist()) for r in back) == want
    wanted = spark.createDataFrame([(3,), (-5,), (None,), (9999,), (3,)], "doc_id long")
    found = token_store.look_up(manifest, wanted).collect()
    assert sorted((str(r.doc_id) for r in found)) == sorted(str(i) for i in ids if i in (3, -5, None))
    assert token_store.read_shards(token_store.write_shards(docs.limit(0), BYTE, shards=2)).count() == 0


def swapped(n):
    """Two words of 2 ** n letters that no polynomial modulo 2 ** 64 tells apart, once n is 10 or so."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_pieces_as_the_library(spark):
    """Whole documents and hard texts; words whose hashes may collide; a store that overflows."""
    t = library(BYTE)
    a, b = swapped(10)
    texts = [*TEXTS, a, b, f"{a} {b}", "é\u2028x", "x\n", "\nx", "x \ny", "\n", " ", "a\u00a0b", "tab\tx", "'s\n's", "<|endoftext|>", "x <|endoftext|>\n y"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = token_store.PieceEncoder(BYTE)
    encoder.store.most = 500
    for at in range(0, len(texts), 17):
        part = texts[at : at + 17]
        for text, got in zip(part, encoder.encode(part), strict=True):
            assert np.frombuffer(got, np.uint32).tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_digest_columns(spark):
    """The registered query against the library and zlib on the smallest tables."""
    import zlib

    from veritab.llm import queries

    t = library(BYTE)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    start, want = 0, []
    for d in sorted(docs, key=lambda d: d.doc_id):
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], np.uint32)
        want.append((d.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op7_token_store(spark, "/root/testdata/sf0.001").collect())) == want


def test_blocks_share_prefixes_and_detect_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 64)
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = token_store.Writer(f)
        for i in range(100):
            w.add(token_store.key_of(i * 2), bytes(4 * (i % 5)))
        size = w.finish()
    assert size == path.stat().st_size
    with path.open("rb") as f:
        r = token_store.Reader(f, size)
        assert len(r.index) > 3 and [token_store.doc_of(k) for k, _ in r.scan()] == [i * 2 for i in range(100)]
        assert r.get(14) == [bytes(8)] and r.get(15) == [] and r.get(None) == []
    data = bytearray(path.read_bytes())
    data[size - 80] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(ValueError):
        token_store.Reader(f, size)


def test_a_full_store_costs_a_look_up_nothing():
    """What is asked for decides the work, not how much the store holds."""
    hashed = []

    class Key:
        def __init__(self, n):
            self.n = n

        def __hash__(self):
            hashed.append(self.n)
            return hash(self.n)

        def __eq__(self, other):
            return self.n == other.n

    store = Store(lambda keys: [k.n for k in keys], 3000)
    store.learned({Key(n) for n in range(2000)})
    store.learned({Key(n) for n in range(2000, 4000)})
    assert len(store.old) == len(store.new) == 2000
    wanted = {Key(5), Key(2500), Key(9000)}
    hashed.clear()
    found = store.learned(wanted)
    assert [found[k] for k in sorted(wanted, key=lambda k: k.n)] == [5, 2500, 9000]
    assert len(hashed) < 50
