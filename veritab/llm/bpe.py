"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary file names merges in order of rank. A word starts as its byte
symbols (the last one carries the end-of-word suffix). A segment tree has a leaf for
each symbol: the rank of the pair that it forms with the next live symbol, or none.
Its root yields the leftmost pair of the lowest rank; a merge changes at most
three leaves, each a logarithmic update, and encoding ends when the root is
empty. A word of n symbols costs O(n log n), however long it is.

Every word takes this way. Words of about one length that a batch of texts brings for the first
time have their trees side by side in one array, so that numpy takes one step of all of them at a
time (``merge_side_by_side``); a word without company of its length is
merged by itself (``merge``). Both follow the same tree, step by step.

Defined results: null text is the empty text; it and text of white space alone
give no ids. Rows are independent, so repeated rows give repeated results.
Columns other than the two named are not read.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veritab.llm.common import Store, list_array, slices, text_bytes, tidied

#: Characters that str.split() takes for white space and the pattern doesn't.
CONTROL = regex.compile("[\x1c-\x1f]").search
#: Entries that a store of a Python worker may reach; then its older half goes.
STORE = 80_000
#: Text bytes that are encoded at once; a longer document is encoded alone.
PIECE = 1 << 20
#: Words of one length from which their trees stand side by side, and leaves of all trees of one step.
COMPANY, LEAVES = 32, 1 << 19
#: Bits of a symbol in a pair, and of a position below a rank; no pair.
SIDE, PLACE = 20, 40
POSITION = (1 << PLACE) - 1
NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, the usual alphabet of byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Apply merges until none is left, always the leftmost pair of the lowest rank.

    ranks: left << SIDE | right -> rank; merged: rank -> the new symbol. Node 1 of the tree is
    the root, a node holds the least (rank, position) below it; removed symbols are linked over.
    """
    n = len(symbols)
    size = 1 << max(0, n - 2).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get

    def leaf(i: int, a: int, b: int) -> int:
        rank = get(a << SIDE | b)
        return NONE if rank is None else rank << PLACE | i

    for i in range(n - 1):
        tree[size + i] = leaf(i, symbols[i], symbols[i + 1])
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                return
            tree[node] = low

    while (top := tree[1]) < NONE:
        i = top & POSITION
        j = after[i]
        k = after[i] = after[j]
        new = symbols[i] = merged[top >> PLACE]
        symbols[j] = -1
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
        put(i, leaf(i, new, symbols[k]) if k < n else NONE)
        if (h := before[i]) >= 0:
            put(h, leaf(h, symbols[h], new))
    return [s for s in symbols if s >= 0]


class PairRanks:
    """rank of each pair of symbols, for many pairs at a time."""

    def __init__(self, ranks: dict[int, int], merged: list[int]):
        pairs = np.fromiter(ranks.keys(), np.int64, len(ranks))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], NONE)
        self.ranks = np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], 0)
        self.merged = np.array(merged, np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where there is none; a negative symbol has no pairs."""
        pair = left << SIDE | right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.ranks[at], -1)


def merge_side_by_side(symbols: np.ndarray, known: PairRanks) -> np.ndarray:
    """merge for each row of symbols [words, a power of two columns]; -1 stands behind a word's end.

    Returns the rows with -1 for each removed symbol. Every step takes the root of each tree that
    still has a pair, and climbs from the three changed leaves level by level.
    """
    words, size = symbols.shape
    wide, deep = size + 1, 2 * size
    bits = size.bit_length() - 1
    sym = np.full((words, wide), -1, np.int64)
    sym[:, :size] = symbols
    tree = np.full((words, deep), NONE, np.int64)
    column = np.arange(size)
    rank = known.of(sym[:, :size].reshape(-1), sym[:, 1:].reshape(-1)).reshape(words, size)
    tree[:, size:] = np.where(rank >= 0, rank << bits | column, NONE)
    for level in range(bits - 1, -1, -1):
        low = tree[:, 2 << level : 4 << level]
        tree[:, 1 << level : 2 << level] = np.minimum(low[:, ::2], low[:, 1::2])
    after = np.tile(np.arange(1, wide + 1), (words, 1)).reshape(-1)
    before = np.tile(np.arange(-1, wide - 1), (words, 1)).reshape(-1)
    sym, tree = sym.reshape(-1), tree.reshape(-1)
    row = np.arange(words)
    while True:
        top = tree[row * deep + 1]
        live = top < NONE
        if not live.all():
            row, top = row[live], top[live]
        if not len(row):
            return sym.reshape(words, wide)[:, :size]
        base, root = row * wide, row * deep
        i = top & size - 1
        at = base + i
        j = after[at]
        k = after[base + j]
        new = known.merged[top >> bits]
        sym[at] = new
        sym[base + j] = -1
        after[at] = k
        before[base + k] = i
        h = before[at]
        left = np.where(h >= 0, sym[base + h], -1)
        rank = known.of(np.concatenate([new, left]), np.concatenate([sym[base + k], new]))
        place = np.concatenate([i, np.maximum(h, 0)])
        value = np.where(rank >= 0, rank << bits | place, NONE)
        # The left neighbour's leaf comes first: a word's first symbol has none, and its own leaf then overwrites it.
        twice = np.concatenate([root, root])
        tree[root + size + j] = NONE
        own = len(row)
        has = h >= 0
        tree[root[has] + size + h[has]] = value[own:][has]
        tree[root + size + i] = value[:own]
        node = np.concatenate([place + size, j + size])
        tops = np.concatenate([twice, root])
        for _ in range(bits):
            node >>= 1
            below = tops + 2 * node
            tree[tops + node] = np.minimum(tree[below], tree[below + 1])


class WordBpe:
    """A tokenizer file of the word kind: NFC and lower case, words cut by a pattern,
    white space dropped, byte symbols, an end-of-word suffix, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks: dict[int, int] = {}
        self.merged = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << SIDE | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.known = PairRanks(self.ranks, self.merged)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # Chunks are cut together, with a line end between two of them.
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") + "|\n").findall
        self.chunks = regex.compile(r"\P{White_Space}+").findall
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        symbols = byte_symbols()
        self.first = np.array([self.vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([self.vocab.get(s + self.suffix, -1) for s in symbols], np.int64)
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        # No chunk has a space, so these keys are the special tokens' own.
        fixed = {f" {token}": np.int32(i).tobytes() for token, i in self.special.items()}
        self.word_store = Store(self.encode_words, STORE)
        self.store = Store(self.encode_chunks, STORE, fixed)

    def forget(self) -> None:
        """Empty the stores: an idle worker would hold them through the stages that follow."""
        self.word_store.clear()
        self.store.clear()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word by the segment tree."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        symbols = self.first[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        if (symbols < 0).any():  # bytes that the vocabulary lacks are left out
            owner = np.repeat(np.arange(len(raw)), lengths)[symbols >= 0]
            symbols, lengths = symbols[symbols >= 0], np.bincount(owner, minlength=len(raw))
            ends = np.cumsum(lengths)
        out: list[bytes] = [b""] * len(raw)
        width = np.maximum(1, lengths) - 1
        classes = np.zeros(len(raw), np.int64)
        while width.any():
            classes += width > 0
            width >>= 1
        for c in np.unique(classes).tolist():
            own, size = np.flatnonzero(classes == c), 1 << c
            if len(own) < COMPANY:
                for w in own.tolist():
                    ids = merge(symbols[ends[w] - lengths[w] : ends[w]].tolist(), self.ranks, self.merged)
                    out[w] = np.array(ids, np.int32).tobytes()
                continue
            step = max(1, LEAVES // size)
            for some in (own[at : at + step] for at in range(0, len(own), step)):
                place = np.arange(size)
                inside = place < lengths[some][:, None]
                grid = np.full((len(some), size), -1, np.int64)
                grid[inside] = symbols[((ends - lengths)[some][:, None] + place)[inside]]
                done = merge_side_by_side(grid, self.known)
                kept = done >= 0
                flat, stops = done[kept].astype(np.int32).tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
                for w, a, b in zip(some.tolist(), [0, *stops], stops, strict=False):
                    out[w] = flat[a:b]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each text without white space, whose words are stored too."""
        words = self.words("\n".join(chunks))
        get = self.word_store.learned({w for w in words if w != "\n"}).__getitem__
        out, own = [], []
        for w in words:
            if w == "\n":
                out.append(b"".join(own))
                own = []
            else:
                own.append(get(w))
        return [*out, b"".join(own)]

    def chunked(self, text: str | None) -> list[str]:
        """The keys in the chunk store that a text's ids are made of."""
        if not text:
            return []
        out = []
        for part in self.cut(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(f" {part}")
                continue
            # Lower case goes letter by letter: a final capital sigma is no exception.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            # No word spans white space, so what stands between is stored as a whole.
            out += self.chunks(part) if CONTROL(part) else part.split()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit little-endian integers."""
        chunked = [self.chunked(t) for t in texts]
        get = self.store.learned(set().union(*chunked)).__getitem__
        return [b"".join(map(get, c)) for c in chunked]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """encode in pieces of bounded size."""
        out: list[bytes] = []
        for at, to in slices(text_bytes(column)[1], PIECE):
            out += self.encode(column.slice(at, to - at).to_pylist())
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as files without a decoder define it."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The model of a tokenizer file, once in each Python worker."""
    return WordBpe(path)


def _forgetting(run, path: str):
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            load(path).forget()

    return tidied(wrapped)


def _ids_column(encoded: list[bytes]) -> pa.ListArray:
    return list_array(np.frombuffer(b"".join(encoded), np.int32), np.array([len(x) // 4 for x in encoded], np.int64))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row; no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load(path)
        for b in batches:
            ids = _ids_column(model.encode_column(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(_forgetting(run, path), f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) of each row of ids; null ids give the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load(path)
        for b in batches:
            out = [model.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(_forgetting(run, path), f"`{id_col}` {kind}, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass over the texts; ids are decoded from the ids
    themselves, not from the words that they came from."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                encoded = model.encode_column(b.column(1))
                decoded = [model.decode(np.frombuffer(x, np.int32).tolist()) for x in encoded]
                yield pa.RecordBatch.from_arrays([b.column(0), _ids_column(encoded), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(_forgetting(run, path), f"`{id_col}` {kind}, ids array<int>, decoded string")
