"""Runs of repeated words by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least ``least`` words and 2 q long, that no neighbouring word extends. Every run holds a
multiple of q, counted from the start of its text, from which the stretch of words equal to
the word q later is at least half of ``least`` words long. So the pairs (i, i + q) of the harmonic
grid, n / q of them for each q, are its candidates: about n ln n in all, of which those stay whose four-word
windows at i, before or after, look equal.

Candidates are extended both ways by longest common extensions. For these the words are recompressed:
rounds of block compression (repetitions of one symbol become one symbol with a
count) and pair compression (symbols fall into left and right ones by a hash; a left one before a right
one becomes a symbol) alternate until each text is one symbol. Equal stretches are cut alike but for
their ends, so an extension goes up the levels while symbols agree and down again
to the difference, a step or two a level. Many extensions go side by side.

A task works on about half a MB of text at a time; a longer text stands alone. Nothing is shuffled.

Defined results: null texts have no words; texts shorter than ``least`` have no
runs. Equal rows get equal results. Extra columns are not read. Empty tables give no rows. Of stretches
that several periods describe, the smallest period counts.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import list_array, mix, slices, text_bytes, tidied

#: Text bytes worked on at once, and pairs of the harmonic grid looked at at once.
PIECE, PAIRS = 1 << 19, 1 << 20
#: Words of the windows that tell candidates from the rest of the grid.
WINDOW = 4
#: Rounds after which texts that are not one symbol yet stay as they are.
ROUNDS = 200


class Level:
    """One level of a grammar as seen from one side: its symbols, and how the next level cuts them.

    kind: "block" or "pair" compression, None at the top. parent: the symbol above each symbol; child: the
    first symbol below each symbol of the next level. moves: for pairs, whether a symbol may be the second of
    one; for blocks, how many equal symbols are left from each on.
    """

    __slots__ = ("child", "kind", "moves", "parent", "symbols")

    def __init__(self, symbols, kind=None, parent=None, child=None, moves=None):
        self.symbols, self.kind, self.parent, self.child, self.moves = symbols, kind, parent, child, moves


def _named(keys: np.ndarray, following: int) -> tuple[np.ndarray, int]:
    """New symbols, equal ones for equal keys, from ``following`` on."""
    names, at = np.unique(keys, return_inverse=True)
    return at + following, following + len(names)


class Grammar:
    """A run-length grammar of texts laid end to end; negative symbols end texts and occur once each."""

    def __init__(self, symbols: np.ndarray):
        self.forward: list[Level] = []
        self.backward: list[Level] = []
        symbols = np.append(np.int64(-1) << np.int64(40), symbols)  # an end in front too, for going back
        following = int(symbols.max(initial=0)) + 1
        texts = int(np.count_nonzero(symbols < 0))
        for k in range(ROUNDS):
            n = len(symbols)
            if n < 2 * texts:
                break
            if k % 2 == 0:
                begins = np.append(True, symbols[1:] != symbols[:-1])
                second_forward = second_backward = None
            else:
                left = (mix(symbols.astype(np.uint64) + np.uint64(k << 40)) & np.uint64(1)).astype(bool)
                joined = lambda x: x[:-1] & ~x[1:] & (symbols[:-1] >= 0) & (symbols[1:] >= 0)
                if np.count_nonzero(joined(left)) < np.count_nonzero(joined(~left)):
                    left = ~left
                begins = np.append(True, ~joined(left))
                second_forward, second_backward = ~left & (symbols >= 0), left & (symbols >= 0)
            first = np.flatnonzero(begins)
            if k % 2 and len(first) == n:
                continue
            parent = np.cumsum(begins) - 1
            sizes = np.diff(first, append=n)
            last = first + sizes - 1
            above = symbols[first]
            grown = sizes > 1
            if grown.any():
                held = above[grown]
                keys = held * np.int64(n + 1) + sizes[grown] if k % 2 == 0 else held * np.int64(following) + symbols[last[grown]]
                above = above.copy()
                above[grown], following = _named(keys, following)
            if k % 2 == 0:
                place = np.arange(n)
                second_forward, second_backward = last[parent] - place + 1, place - first[parent] + 1
            kind = "pair" if k % 2 else "block"
            self.forward.append(Level(symbols, kind, parent, first, second_forward))
            self.backward.append(Level(symbols[::-1], kind, len(first) - 1 - parent[::-1], n - 1 - last[::-1], second_backward[::-1]))
            symbols = above
        self.forward.append(Level(symbols))
        self.backward.append(Level(symbols[::-1]))
        self.n = len(self.forward[0].symbols)

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from each a on equal those from each b on; a and b differ."""
        return _extensions(self.forward, a + 1, b + 1)

    def extend_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before each a, going back, equal those before each b."""
        return _extensions(self.backward, self.n - 1 - a, self.n - 1 - b)


def _extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    begin = a
    who = np.arange(len(a))
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(mask):
        return a[mask], b[mask], who[mask]

    for level in levels:  # up, while the symbols agree
        same = level.symbols[a] == level.symbols[b]
        halted = [keep(~same)]
        a, b, who = keep(same)
        if level.kind == "pair":
            step = level.moves[a]  # a possible second symbol: whatever follows begins one above
            a, b = a + step, b + step
        elif level.kind == "block":
            own, other = level.moves[a], level.moves[b]
            begins = (level.child[level.parent[a]] == a) & (level.child[level.parent[b]] == b)
            step = np.where(begins, 0, np.minimum(own, other))
            a, b = a + step, b + step
            cut = ~begins & (own != other)
            halted.append(keep(cut))
            a, b, who = keep(~cut)
        else:
            while len(a):  # texts that weren't reduced to one symbol
                a, b = a + 1, b + 1
                same = level.symbols[a] == level.symbols[b]
                halted.append(keep(~same))
                a, b, who = keep(same)
        stopped.append(tuple(map(np.concatenate, zip(*halted, strict=True))))
        if level.kind:
            a, b = level.parent[a], level.parent[b]
    a, b, who = stopped.pop()
    for level in reversed(levels[:-1]):  # down, to the first difference
        a, b = level.child[a], level.child[b]
        same = level.symbols[a] == level.symbols[b]
        step = same.astype(np.int64) if level.kind == "pair" else np.where(same, np.minimum(level.moves[a], level.moves[b]), 0)
        more = stopped.pop()
        a, b, who = np.append(a + step, more[0]), np.append(b + step, more[1]), np.append(who, more[2])
    out = np.empty(len(begin), np.int64)
    out[who] = a
    return out - begin


def windows(symbols: np.ndarray) -> np.ndarray:
    """A hash of the symbols from each place on, as many as a window has."""
    out = np.zeros(len(symbols), np.uint64)
    padded = np.append(symbols, -np.arange(WINDOW) - (1 << 40)).astype(np.uint64)
    for k in range(WINDOW):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(symbols)])
    return out


def grid(symbols: np.ndarray, begins: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) of the harmonic grid of each text whose windows at i or before i equal those q later."""
    hashes = windows(symbols)
    texts = np.flatnonzero(counts >= least)
    periods = counts[texts] // 2
    text = np.repeat(texts, periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = -(-(counts[text] - period) // period)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x, y in slices(np.append(0, np.cumsum(places)), PAIRS):
        own = np.repeat(np.arange(x, y), places[x:y])
        k = np.arange(len(own)) - np.repeat(np.cumsum(places[x:y]) - places[x:y], places[x:y])
        q = period[own]
        i = begins[text[own]] + k * q
        alike = hashes[i] == hashes[i + q]
        back = i - (WINDOW - 1)
        inside = back >= begins[text[own]]
        alike |= inside & (hashes[np.where(inside, back, 0)] == hashes[np.where(inside, back + q, 0)])
        found.append((i[alike], q[alike]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def find_runs(symbols: np.ndarray, begins: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs by start, then period, in places of the whole sequence.

    symbols: the words of the texts as numbers, with a negative number of its own after each text.
    """
    i, q = grid(symbols, begins, counts, least)
    if not len(i):
        return i, i, q
    # Only texts with candidates are recompressed.
    owner = np.searchsorted(begins, i, side="right") - 1
    texts = np.unique(owner)
    sizes = counts[texts] + 1
    moved = np.cumsum(sizes) - sizes
    shift = np.zeros(len(begins), np.int64)
    shift[texts] = begins[texts] - moved
    grammar = Grammar(symbols[np.repeat(begins[texts] - moved, sizes) + np.arange(int(sizes.sum()))])
    at = i - shift[owner]
    start = at - grammar.extend_back(at, at + q)
    end = at + q + grammar.extend(at, at + q)
    long = end - start >= np.maximum(least, 2 * q)
    start, end, q = (start + shift[owner])[long], (end + shift[owner])[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _piece(texts: list[bytes], least: int):
    """(number of words, number of runs) of each text; (start, length, period) of the runs; the texts without repetitions."""
    words = [t.split() for t in texts]  # bytes are cut at ASCII white space
    counts = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(counts + 1) - counts - 1
    number: dict[bytes, int] = {}
    symbols = np.zeros(int(counts.sum()) + len(words), np.int64)
    symbols[begins + counts] = -1 - np.arange(len(words))
    symbols[symbols == 0] = [number.setdefault(w, len(number)) for w in itertools.chain.from_iterable(words)]
    start, end, q = find_runs(symbols, begins, counts, least)
    owner = np.searchsorted(begins, start, side="right") - 1
    marks = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(marks, start + q, 1)
    np.add.at(marks, end, -1)
    dropped = np.cumsum(marks)[:-1] > 0
    collapsed = []
    touched = set(owner.tolist())
    for d, own in enumerate(words):
        if d in touched:
            gone = dropped[begins[d] : begins[d] + counts[d]]
            own = [own[k] for k in np.flatnonzero(~gone).tolist()]
        collapsed.append(b" ".join(own))
    return counts, np.bincount(owner, minlength=len(words)), np.stack([start - begins[owner], end - start, q]), collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row.

    runs: array of struct(start, length, period) in words, by start, then period. collapsed: the words
    joined by one space, without those that lie in a run after its first period.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["start", "length", "period"]

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            whole = data.tobytes()
            for i, j in slices(offsets, PIECE):
                cut = offsets[i : j + 1].tolist()
                counts, n_runs, runs, collapsed = _piece([whole[x:y] for x, y in itertools.pairwise(cut)], least)
                listed = list_array(pa.StructArray.from_arrays([pa.array(r) for r in runs], fields), n_runs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which texts of some ids end in a repetition of known place and period.

    With h the CRC-32 of the id's decimal digits, g = h div 10 and n words: where h is divisible by 10, words from a = g mod n
    on repeat the p = 1 + (n - a) div (3 + g mod 8) words there. Null ids and wordless texts stay.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    trimmed = F.btrim(F.col(text_col), F.lit(" \t\n\x0b\f\r"))
    words = F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1)
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    as_int = lambda c: c.cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, as_int(a + 1), as_int(p)), as_int(F.ceil((n - a) / p))))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), as_int(a)), F.slice(tail, F.lit(1), as_int(n - a))), " ")
    return docs.withColumn(text_col, F.when((h % 10 == 0) & (trimmed != ""), planted).otherwise(F.col(text_col)))
