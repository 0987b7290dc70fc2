"""Ranked lexical search turned round: the items' index is sent out, the documents stream through it.

Items (the queries) are cut into blocks of bounded size; a block is the inverted index over the terms of its
items: for each term the items that hold it and how often. Every document's terms are
counted against the block's terms once and stored in the shared folder, with the number of all its terms. From these
counts come the document frequencies. Then each task streams its documents through the index, adds up the scores of the
items that a document shares terms with, and holds a heap of the ``k`` best documents for each item. The
tasks' heaps are merged by parts of the documents first and then by item, so no group holds more than a
few thousand rows an item.

With N documents that have a term, L terms in all, n terms in a document, df documents with a term and tf of it in
this one: w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, and the score is the sum over the
item's terms, repeats included, of w * ((10^9 tf) div (1000 tf + 12 m)), in whole numbers.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. Hashes
only find them: terms are equal when their bytes are.

Defined results: null or termless texts are no documents, null or termless items find none. Every row is a document or item of
its own, repeated or not. Equal scores go by ascending id, nulls last (the largest long stands for a null id). Scores of 0 are not
listed. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import LOWER, WORD, Words, byte_spans, list_array, read_block, slices, staged, text_bytes, tidied, write_blocks

#: Text bytes of a block of items, and of documents worked on at once; score additions, and scores, held at once.
BLOCK, PIECE, ADDED, SCORES = 1 << 22, 1 << 19, 1 << 20, 1 << 21
#: Parts of the documents by which heaps are merged first.
PARTS = 256
NO_ID = np.iinfo(np.int64).max


class Items:
    """The inverted index over the terms of some items."""

    def __init__(self, names: list[str], texts: list[str | None]):
        self.names = names
        self.words = Words(*text_bytes(pa.array(texts, pa.string())))
        term = self.words.of_tokens()
        pairs, self.times = np.unique(term * len(names) + self.words.row if len(term) else term, return_counts=True)
        self.item = pairs % max(1, len(names))
        held = np.bincount(pairs // max(1, len(names)), minlength=len(self.words.hashes))
        self.begins = np.append(0, np.cumsum(held))
        self.words.forget_tokens()


@functools.lru_cache(maxsize=1)
def _items(path: str) -> Items:
    return read_block(path)


def count_terms(docs: DataFrame, block: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times) of each document with a term: how often it has each of the block's terms."""

    def run(batches):
        words = _items(block).words
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in slices(offsets, PIECE):
                text = LOWER[data[offsets[i] : offsets[j]]]
                h, row, starts, ends = byte_spans(text, offsets[i : j + 1] - offsets[i], WORD)
                n = np.bincount(row, minlength=j - i)
                term = words.find(text, h, starts, ends)
                known = term >= 0
                pairs, times = np.unique(row[known] * max(1, len(words.hashes)) + term[known], return_counts=True)
                held = np.bincount(pairs // max(1, len(words.hashes)), minlength=j - i)
                terms = list_array((pairs % max(1, len(words.hashes))).astype(np.int32), held)
                whole = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), terms, list_array(times, held)], ["doc_id", "n", "terms", "times"])
                yield whole.filter(pa.array(n > 0))

    counted = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidied(run), "doc_id long, n long, terms array<int>, times array<long>")
    return staged(counted, "terms")


class Heaps:
    """The k best documents of each item so far; a heap's least entry is what a document must beat."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.score = np.zeros(items, np.int64)  # the least score of a full heap, and minus its id
        self.minus_id = np.full(items, -NO_ID - 1, np.int64)

    def offer(self, scores: np.ndarray, minus_ids: np.ndarray) -> None:
        """scores: documents by items."""
        docs, items = np.nonzero((scores > self.score) | ((scores == self.score) & (scores > 0) & (minus_ids[:, None] > self.minus_id)))
        for d, i, s in zip(minus_ids[docs].tolist(), items.tolist(), scores[docs, items].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, d))
            elif (s, d) > heap[0]:
                heapq.heapreplace(heap, (s, d))
            if len(heap) == self.k:
                self.score[i], self.minus_id[i] = heap[0]


def score_documents(counted: DataFrame, block: str, weights, N: int, L: int, k: int) -> DataFrame:
    """(item, item_id, score, doc_id): the heaps of each task. weights: a broadcast of the weight of each of the block's terms."""

    def run(batches):
        index = _items(block)
        many = len(index.names)
        heaps = Heaps(many, k)
        lengths = np.diff(index.begins)
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy()
            held = np.diff(b.column(2).offsets.to_numpy())
            term, tf = b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), held)
            m = 75 + 25 * n * N // L
            part = weights.value[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            cost = np.maximum(np.bincount(doc, lengths[term], len(n)).astype(np.int64), -(-ADDED * many // SCORES))
            first = np.append(0, np.cumsum(held))
            for i, j in slices(np.append(0, np.cumsum(cost)), ADDED):
                own = slice(first[i], first[j])
                reps = lengths[term[own]]
                at = np.repeat(index.begins[term[own]] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
                scores = np.zeros((j - i) * many, np.int64)
                np.add.at(scores, np.repeat((doc[own] - i) * many, reps) + index.item[at], np.repeat(part[own], reps) * index.times[at])
                heaps.offer(scores.reshape(j - i, many), -ids[i:j])
        rows = [(i, s, -d) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        for x in range(0, len(rows), 1 << 16):
            item, score, doc_id = map(list, zip(*rows[x : x + (1 << 16)], strict=True))
            found = pa.array([None if d == NO_ID else d for d in doc_id], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([index.names[i] for i in item], pa.string()), pa.array(score, pa.int64()), found], ["item", "item_id", "score", "doc_id"])

    return counted.mapInArrow(tidied(run), "item long, item_id string, score long, doc_id long")


def merge_heaps(heaps: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): by parts of the documents first, then by item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    some = heaps.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, from rank 1; item ids keep their type."""
    spark = docs.sparkSession
    named = items.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out, N, L = None, 0, 0
    for block in write_blocks(named, Items, block_bytes):
        counted = count_terms(docs, block, id_col, text_col)
        if out is None:
            N, L = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # No more rows than the block has terms, whose bytes are bounded.
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        term, count = df.column(0).to_pylist(), df.column(1).to_pylist()
        weights = np.zeros(max(term, default=-1) + 1, np.int64)
        weights[term] = [math.floor(1000 * math.log((2 * N + 2) / (2 * c + 1))) for c in count]
        best = merge_heaps(score_documents(counted, block, spark.sparkContext.broadcast(weights), N, max(1, L), k), k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        out = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    return out.withColumn("item_id", F.col("item_id").cast(items.schema[item_col].dataType))


def duckdb_sql(k: int = 20) -> str:
    """The same search as DuckDB SQL over ``documents`` and ``benchmark``."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
m AS (SELECT n.r, n.doc_id, 75 + (25 * n.n * g.N) // g.L AS m FROM n, g),
w AS (SELECT term, floor(1000 * ln((2 * g.N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
i AS (SELECT row_number() OVER () AS q, item_id, {terms} AS ts FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
s AS (SELECT q, item_id, doc_id, tf.r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM it JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= {k}
"""
