"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: a segment holds the postings of every token of
about a quarter MB of text, small enough that no part of it is a large object to the JVM. Its rows are

    doc_ids, first_positions, n_words   one entry for each document
    words, word_lengths                 the words in the order of their 64-bit hashes, end to end
    counts, postings                    how many positions each word has, the positions

Positions run through the segment with a gap between documents, so a phrase
can't cross from one into the next. Segments are made by each task from
its own rows; nothing is shuffled, and a document's words stay together, however
common a term is.

A search reads the index once. The benchmark is cut into blocks of bounded size in the shared
folder, and a task lays each block in turn against the segments that it holds. A window's
terms are ordered by the length of their lists; starting from the
rarest, offset-adjusted lists are intersected until none or all are done.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in
lower case. Hashes only find them: words are equal when their bytes are.

Defined results: null or wordless texts have no words and no hits; wordless items
have no windows. Repeated documents and items each count as rows, an item id
counts once in a document. A null item id is listed as the empty string. Empty tables give no
rows (documents) or no hits (benchmark). Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import Words, equal_runs, list_array, read_block, run_hashes, slices, staged, text_bytes, tidied, write_blocks

#: Text bytes of a segment, and of a block of benchmark items.
SEGMENT, BLOCK = 1 << 18, 1 << 22
_SEGMENT = "doc_ids array<{kind}>, first_positions array<int>, n_words array<int>, words binary, word_lengths binary, counts binary, postings binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each segment, stored in the shared folder. Every row of docs is in exactly one segment."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in slices(offsets, SEGMENT):
                terms = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n_words = np.bincount(terms.row, minlength=j - i)
                firsts = np.append(0, np.cumsum(n_words + 1)[:-1])
                binary = lambda a, t: pa.array([a.astype(t).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        list_array(b.column(0).slice(i, j - i), np.array([j - i])),
                        list_array(firsts.astype(np.int32), np.array([j - i])),
                        list_array(n_words.astype(np.int32), np.array([j - i])),
                        binary(terms.bytes, np.uint8),
                        binary(np.diff(terms.ends, prepend=0), np.int32),
                        binary(np.diff(terms.begins, append=len(terms.order)), np.int32),
                        binary(terms.order + terms.row[terms.order], np.int32),
                    ],
                    ["doc_ids", "first_positions", "n_words", "words", "word_lengths", "counts", "postings"],
                )

    return staged(docs.select(id_col, text_col).mapInArrow(tidied(run), _SEGMENT.format(kind=kind)), "postings")


class Segment:
    """One row of the index, for searching; the spans and items found so far."""

    def __init__(self, b: pa.RecordBatch):
        view = lambda k, kind: np.frombuffer(b.column(k)[0].as_buffer(), kind)
        self.doc_ids = b.column(0).flatten()
        self.firsts = b.column(1).flatten().to_numpy().astype(np.int64)
        self.n_words = b.column(2).flatten().to_numpy().astype(np.int64)
        self.words, lengths, counts, self.postings = view(3, np.uint8), view(4, np.int32), view(5, np.int32), view(6, np.int32)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.word_ends = np.cumsum(lengths, dtype=np.int64)
        self.word_starts = self.word_ends - lengths
        self.terms = run_hashes(self.words, self.word_starts, self.word_ends)
        total = int(self.firsts[-1] + self.n_words[-1] + 1) if len(self.firsts) else 0
        self.marks = np.zeros(total + 1, np.int32)
        self.items: dict[int, set[str]] = {}

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The document of each position."""
        return np.searchsorted(self.firsts, positions, side="right") - 1

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(place, length of the list) of each word of the block; length 0 if it is absent."""
        n = len(block.hashes)
        place, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left, at = np.arange(n), np.searchsorted(self.terms, block.hashes)
        while True:  # more than once only where different words share a hash
            inside = at < len(self.terms)
            left, at = left[inside], at[inside]
            alike = self.terms[at] == block.hashes[left]
            left, at = left[alike], at[alike]
            if not len(left):
                return place, count
            starts = block.word_starts[left]
            equal = equal_runs(self.words, self.word_starts[at], self.word_ends[at] - self.word_starts[at], block.words, starts, block.word_ends[left] - starts)
            place[left[equal]] = at[equal]
            count[left[equal]] = (self.ends - self.starts)[at[equal]]
            left, at = left[~equal], at[~equal] + 1

    def positions(self, place: int) -> np.ndarray:
        return self.postings[self.starts[place] : self.ends[place]]

    def phrase(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where a phrase starts; places and list lengths of its terms in order."""
        order = np.argsort(counts, kind="stable")
        found = self.positions(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            there, want = self.positions(places[k]), found + k
            at = np.minimum(np.searchsorted(there, want), len(there) - 1)
            found = found[there[at] == want]
        return found

    def near(self, places: np.ndarray, counts: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``within`` words away in the same document."""
        order = np.argsort(counts, kind="stable")
        found = self.positions(places[order[0]])
        for k in order[1:]:
            if not len(found):
                break
            there = self.positions(places[k])
            after = np.minimum(np.searchsorted(there, found), len(there) - 1)
            before = np.maximum(after - 1, 0)
            ok = np.zeros(len(found), bool)
            for at in (after, before):
                ok |= (np.abs(there[at] - found) <= within) & (self.owner(there[at]) == self.owner(found))
            found = found[ok]
        return found

    def search(self, block: Block, within: int | None) -> None:
        """Mark what the block's windows hit."""
        for w, places, counts in block.present(self):
            starts, size = (self.phrase(places, counts), int(block.size[w])) if within is None else (self.near(places, counts, within), 1)
            if len(starts):
                np.add.at(self.marks, starts, 1)
                np.add.at(self.marks, starts + size, -1)
                for d in np.unique(self.owner(starts)).tolist():
                    self.items.setdefault(d, set()).add(block.names[block.item[w]])

    def result(self) -> pa.RecordBatch:
        hit = np.cumsum(self.marks)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        begin, stop = edge[::2], edge[1::2]
        doc = self.owner(begin) if len(begin) else np.zeros(0, np.int64)
        spans = np.stack([begin - self.firsts[doc], stop - 1 - self.firsts[doc]], axis=1).astype(np.int32) if len(begin) else np.zeros((0, 2), np.int32)
        pairs = list_array(spans.reshape(-1), np.full(len(spans), 2))
        n = len(self.firsts)
        named = [sorted(self.items.get(d, ())) for d in range(n)]
        return pa.RecordBatch.from_arrays([self.doc_ids, pa.array(self.n_words), list_array(pairs, np.bincount(doc, minlength=n)), pa.array(named, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])


class Block:
    """Some benchmark items, cut into windows; with no window size an item is one window."""

    def __init__(self, names: list[str], texts: list[str | None], window: int | None):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        terms = Words(data, offsets)
        self.names, self.hashes, self.words, self.word_starts, self.word_ends = names, terms.hashes, terms.bytes, terms.starts, terms.ends
        self.term_of = terms.of_tokens()
        counts = np.bincount(terms.row, minlength=len(names))
        size = np.minimum(window, counts) if window else counts
        windows = np.where(counts > 0, counts - size + 1, 0)
        self.item = np.repeat(np.arange(len(names)), windows)
        self.size = size[self.item]
        self.start = np.repeat(np.cumsum(counts) - counts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))

    def present(self, segment: Segment) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, places, list lengths) of windows all of whose terms the segment has."""
        place, count = segment.find(self)
        held = np.append(0, np.cumsum(count[self.term_of] > 0))
        for w in np.flatnonzero(held[self.start + self.size] - held[self.start] == self.size).tolist():
            own = self.term_of[self.start[w] : self.start[w] + self.size[w]]
            yield w, place[own], count[own]


@functools.lru_cache(maxsize=1)
def _block(path: str) -> Block:
    """A block of items; a worker holds one."""
    return read_block(path)


def search(index: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text", within: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """One row for each document: (doc_id, n_words, spans, items).

    spans: array of (first, last) word numbers that lie in an occurrence of a window,
    in order and not touching. items: the sorted ids of the items that occur. With
    ``within``, items match by proximity instead: all words of the item within so many
    words of its rarest one, at which the span stands.
    """
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    size = None if within is not None else window
    # An item's id counts once in a document, so repeated items change nothing.
    paths = write_blocks(items.dropDuplicates(), lambda names, texts: Block(names, texts, size), block_bytes)

    def run(batches):
        for b in batches:
            segments = [Segment(b.slice(k, 1)) for k in range(b.num_rows)]
            for path in paths:
                for segment in segments:
                    segment.search(_block(path), within)
            for segment in segments:
                yield segment.result()

    return index.mapInArrow(tidied(run), f"doc_id {kind}, n_words long, spans array<array<int>>, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """search over an index of docs that is stored in the shared folder."""
    return search(build_index(docs, id_col, text_col), benchmark, window, item_col, text_col)


def n_hit(spans: str = "spans") -> F.Column:
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0] + 1)
