"""SimHash near-duplicates: bit-sliced comparison of fingerprints within buckets.

A fingerprint bit is set when more than half of a text's shingle hashes set it.
Two texts are linked when their fingerprints differ in at most ``radius`` bits.

Candidates. For a small radius the bits are cut into radius + 2 blocks: two
fingerprints within the radius agree on at least two whole blocks, so each
pair of blocks is one table of buckets and no link is lost. A radius too wide for that
(the pipeline's) takes the smallest shingle hashes of a text as its buckets: texts with a
similarity s miss each other in all m buckets with a chance of about (1 - s) ** m.

Exact similarity (``similar``, the pipeline's). Fingerprints of distinct shingles only propose candidates
there, with a radius so wide that a pair at the wanted similarity passes it but for a chance
of 1e-7, and the shingle sets decide. Sets are made once, where the texts are; texts are never shuffled for it. First
the candidates' own links are confirmed, one for each text and then those between texts that are still apart: where a template
or copies make a component, that joins it with work linear in its texts. Only components that are still in several parts
go on: their sets meet each other, but for pairs in one part already. A component of more than a chunk is cut first into groups of
texts that share one of their rarest shingles, as similar texts must; only a group beyond a chunk meets itself in chunks.

Comparison. The fingerprints of a bucket are stored vertically: plane b holds bit
b of 64 of them to a word. For each fingerprint of a word, its bits are spread over all
lanes, XORed with the planes of another word, and counted by carry-save adders
into bit-sliced counters which start so that passing the radius overflows. After every few
planes the words whose lanes have all overflowed are abandoned.

Scale. Equal fingerprints are one node. A bucket of more than SPLIT nodes is dealt into
chunks, and each two chunks of it are compared in a group of their own, so that no
task holds a whole hot bucket. A task returns a spanning forest of the links it found,
not the pairs. Components are found by contraction in Spark.

Defined results: null text is empty; texts without words have fingerprint zero and link
like any others. Repeated rows give repeated results; a null id is never a component's name unless all ids
of the component are null. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import BASE, mapped, mix, staged, tidied
from veritab.llm.graph import components

#: Nodes of a bucket from which it is dealt into chunks of this size.
SPLIT = 8192
#: Nodes and bytes of shingle sets of a candidate component from which it is dealt into chunks of about this size.
SPLIT_SETS, SPLIT_BYTES = 1024, 1 << 23
#: Bytes of shingle sets that a confirming task works on at once, besides its last group.
HELD = 1 << 24
#: Rows to drop up to which they are sent to every task.
SMALL = 200_000
#: Rows that a comparing task works on at once, and word pairs of a step.
ROWS, STEP = 1 << 17, 4096
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 with seed 42 of each k-word shingle, repeats included; a shorter text that has words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(whole, 42)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends]
    return np.array([h(whole[s : e - 1], 42) for s, e in zip(starts, ends[k - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` words of 64 bits, least significant first; the words after the first count the bits of re-mixed hashes."""
    out = np.zeros(width, np.uint64)
    n = len(hashes)
    for w in range(width if n else 0):
        h = hashes if w == 0 else mix(hashes + np.uint64(w * BASE & (1 << 64) - 1))
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint32)
        out[w] = np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1, smallest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp binary of 8 * width bytes, keys array<bigint>): keys are the ``smallest`` least distinct re-mixed shingle hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps, keys = [], []
        for t in b.column(1):
            h = shingle_hashes(t.as_py(), shingle)
            fps.append(fingerprint(h, width).tobytes())
            keys.append(np.unique(mix(h ^ np.uint64(BASE)))[:smallest].view(np.int64) if smallest else [])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [id_col, "fp", "keys"])

    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp binary, keys array<bigint>")


def block_keys(radius: int) -> F.Column:
    """The buckets of a 64-bit fingerprint in ``word``: one for each pair of radius + 2 blocks."""
    m = radius + 2
    cuts = [64 * i // m for i in range(m + 1)]
    block = lambda i: F.shiftrightunsigned(F.col("word"), cuts[i]).bitwiseAND(F.lit((1 << cuts[i + 1] - cuts[i]) - 1))
    keys = []
    for no, (i, j) in enumerate(combinations(range(m), 2)):
        wide = cuts[j + 1] - cuts[j]
        keys.append(F.shiftleft(block(i), wide).bitwiseOR(block(j)) * F.lit(64) + F.lit(no))
    return F.array(*keys)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical storage: [bits, words], lane l of word w is fingerprint 64 * w + l."""
    n, width = fps.shape
    words = -(-n // 64)
    full = np.zeros((words * 64, width), np.uint64)
    full[:n] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(words * 64, width * 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes_within(planes: np.ndarray, w1: np.ndarray, w2: np.ndarray, lane: int, mask: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprint ``lane`` of each word w1: (index into w1, lanes of w2) within the
    radius, of the lanes in mask. Words whose lanes have all passed it are abandoned."""
    depth = max(1, int(radius + 1).bit_length())
    start = (1 << depth) - 1 - radius
    index = np.flatnonzero(mask)
    alive = mask[index]
    a, b = w1[index], w2[index]
    counters = [np.full(len(index), ALL if start >> k & 1 else 0, np.uint64) for k in range(depth)]
    total = len(planes)
    shift = np.uint64(lane)

    def differ(p: int) -> np.ndarray:
        return planes[p][b] ^ (np.uint64(0) - (planes[p][a] >> shift & ONE))

    def add(bit: np.ndarray, level: int) -> None:
        nonlocal alive
        for k in range(level, depth):
            carry = counters[k] & bit
            counters[k] ^= bit
            bit = carry
        alive &= ~bit

    for p in range(0, total, 3):
        x = differ(p)
        if p + 2 < total:
            y, z = differ(p + 1), differ(p + 2)
            both = x ^ y
            add(both ^ z, 0)
            add(x & y | both & z, 1) if depth > 1 else add(x & y | both & z, 0)
        else:
            for q in range(p, total):
                add(differ(q), 0)
        if p % 12 == 9 or p % 12 == 0:
            live = alive != 0
            if not live.all():
                if not live.any():
                    return index[:0], alive[:0]
                index, alive, a, b = index[live], alive[live], a[live], b[live]
                counters = [c[live] for c in counters]
    live = alive != 0
    return index[live], alive[live]


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j; label stays the least row of each component."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _confirmed(label: np.ndarray, i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the candidate pairs (i, j) whose sets have a Jaccard similarity of ``least`` or more; pairs that are joined already are left out."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    open_ = (label[i] != label[j]) & (small >= least * large)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    keep = []
    for k in np.flatnonzero(open_):
        a, b = root(int(label[i[k]])), root(int(label[j[k]]))
        if a == b:
            continue
        x, y = sets[i[k]], sets[j[k]]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
        if common >= least * (len(x) + len(y) - common):
            keep.append(k)
            up[max(a, b)] = min(a, b)
    return i[keep], j[keep]


def linked(fps: np.ndarray, group: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, least: float = 0.0, parts: np.ndarray | None = None) -> np.ndarray:
    """The least linked row of each row; rows are sorted by group and linked only within one.

    With ``sets``, the sorted shingle hashes of each row, a link is confirmed by their similarity. Rows of a group with equal
    ``parts`` are joined from the start.
    """
    sizes = np.array([len(x) for x in sets], np.int64) if sets is not None else None
    n = len(fps)
    label = np.arange(n)
    if parts is not None and n:
        _, first, which = np.unique(np.stack([group, parts]), axis=1, return_index=True, return_inverse=True)
        label = first[which.reshape(-1)]
    if n < 2:
        return label
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    planes = planes_of(fps)
    words = planes.shape[1]
    last = (end[np.minimum(np.arange(words) * 64 + 63, n - 1)] - 1) // 64
    spans = last - np.arange(words) + 1
    w1_all = np.repeat(np.arange(words), spans)
    w2_all = w1_all + np.arange(len(w1_all)) - np.repeat(np.cumsum(spans) - spans, spans)
    padded = np.full(words * 64, -1)
    for at in range(0, len(w1_all), STEP):
        w1, w2 = w1_all[at : at + STEP], w2_all[at : at + STEP]
        if spans.max() > 2:  # words that are one component already need no comparison
            padded[:n] = label
            padded[n:] = label[-1]
            lanes = padded.reshape(words, 64)
            low, high = lanes.min(axis=1), lanes.max(axis=1)
            open_ = ~((low[w1] == high[w1]) & (low[w2] == high[w2]) & (low[w1] == low[w2]))
            w1, w2 = w1[open_], w2[open_]
        for lane in range(64):
            i = w1 * 64 + lane
            stop = np.where(i < n, end[np.minimum(i, n - 1)], 0)
            lo = np.clip(np.maximum(i + 1, w2 * 64) - w2 * 64, 0, 64)
            hi = np.clip(stop - w2 * 64, 0, 64)
            wide = np.maximum(hi - lo, 0)
            mask = np.where(wide >= 64, ALL, (ONE << np.minimum(wide, 63).astype(np.uint64)) - ONE) << np.minimum(lo, 63).astype(np.uint64)
            mask[wide == 0] = 0
            index, alive = lanes_within(planes, w1, w2, lane, mask, radius)
            if len(index):
                row, bit = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                x, y = i[index[row]], w2[index[row]] * 64 + bit
                _roots(label, *((x, y) if sets is None else _confirmed(label, x, y, sets, sizes, least)))
    return label


def links(nodes: DataFrame, radius: int, width: int) -> DataFrame:
    """(a, b) fingerprints: a spanning forest of the links inside each bucket.

    nodes: (fp, key), one row for each bucket of each distinct fingerprint. Words of fp after the first ``width`` only tell nodes apart.
    """
    sizes = nodes.groupBy("key").count().where(F.col("count") > SPLIT)
    hot = staged(sizes.select(F.col("key"), F.ceil(F.col("count") / SPLIT).cast("int").alias("chunks")), "hot")
    most = hot.count()
    if most:
        hot = F.broadcast(hot) if most <= 100_000 else hot
        dealt = nodes.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = dealt.select("fp", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    else:
        dealt = nodes.select("fp", "key", F.lit(0).alias("x"), F.lit(0).alias("y"))
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def found(fps: list[bytes], group: np.ndarray):
        values = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)[:, :width]
        label = linked(values, group, radius)
        rows = np.flatnonzero(label != np.arange(len(label)))
        pick = lambda at: pa.array([fps[i] for i in at], pa.binary())
        return pa.RecordBatch.from_arrays([pick(label[rows]), pick(rows)], ["a", "b"])

    def run(batches):
        fps, keys = [], []  # rows not yet compared: whole groups, but for the last
        held = 0
        for b in batches:
            fps.extend(b.column(0).to_pylist())
            keys.append(np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)], axis=1))
            held += b.num_rows
            if held >= ROWS:
                all_keys = np.concatenate(keys)
                new = np.append(True, (all_keys[1:] != all_keys[:-1]).any(axis=1))
                cut = int(np.flatnonzero(new)[-1])
                if cut:
                    yield found(fps[:cut], np.cumsum(new)[:cut])
                    fps, keys, held = fps[cut:], [all_keys[cut:]], held - cut
        if held:
            all_keys = np.concatenate(keys)
            yield found(fps, np.cumsum(np.append(True, (all_keys[1:] != all_keys[:-1]).any(axis=1))))

    return dealt.mapInArrow(tidied(run), "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, width: int = 1, smallest: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): one row for each row of docs; component_id is the least id of its component.

    smallest: 0 for blocks of bits (64 bits), else the number of least shingle hashes used as buckets.
    """
    if not smallest and (width != 1 or radius > 9):
        raise ValueError("blocks of bits serve 64-bit fingerprints and a radius up to 9")
    prints = staged(fingerprints(docs, shingle, width, smallest, id_col, text_col), "fingerprints")
    if smallest:
        # Texts without words have no shingles; they are equal, so their fingerprint is one node and needs no bucket.
        nodes = prints.select("fp", F.explode("keys").alias("key")).distinct()
    else:
        nodes = prints.select("fp").distinct().withColumn("word", _as_long("fp"))
        nodes = nodes.select("fp", F.explode(block_keys(radius)).alias("key"))
    roots = components(links(nodes, radius, width))
    named = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    return prints.select(id_col, "fp").join(_named(named, roots), "fp")


def _named(named: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id): the least ``least`` of each component. named: (fp, least); roots: (node, root).

    The names of components are written first, so that the join on root is one that
    Spark may split: a component may hold a third of all fingerprints.
    """
    named = named.select("fp", "least").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(named, "named")
    least = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return named.join(least, "root").select("fp", "component_id")


def shingle_sets(docs: DataFrame, shingle: int, width: int, smallest: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, keys, size): as fingerprints, but of distinct shingles, and fp goes on with 16 bytes that name the set of shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps, keys, sizes = [], [], []
        for t in b.column(1):
            h = np.unique(shingle_hashes(t.as_py(), shingle))
            fps.append(fingerprint(h, width).tobytes() + xxhash.xxh3_128_digest(h.tobytes()))
            keys.append(np.sort(mix(h ^ np.uint64(BASE)))[:smallest].view(np.int64))
            sizes.append(len(h))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], [id_col, "fp", "keys", "size"])

    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp binary, keys array<bigint>, size bigint")


def shares(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more; two empty ones do."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. sets: (fp, set), each fp once."""
    of = lambda end: sets.select(F.col("fp").alias(end), F.col("set").alias(f"{end}_set"))
    laid = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "a_set", "b_set")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(b.column(2), b.column(3), strict=True)
        good = [shares(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in both]
        return b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return mapped(laid, run, "a binary, b binary")


def confirmed_chunks(sets: DataFrame, radius: int, width: int, least: float) -> DataFrame:
    """(a, b): a spanning forest of the links inside each chunk pair (root, x, y), what is one part already included. sets: (set, fp, part, root, x, y)."""
    dealt = sets.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def found(fps: list[bytes], sets: list[np.ndarray], parts: list[bytes], group: np.ndarray):
        values = np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)[:, :width]
        named = np.unique(np.array(parts, object), return_inverse=True)[1].reshape(-1)
        label = linked(values, group, radius, sets, least, named)
        rows = np.flatnonzero(label != np.arange(len(label)))
        pick = lambda at: pa.array([fps[i] for i in at], pa.binary())
        return pa.RecordBatch.from_arrays([pick(label[rows]), pick(rows)], ["a", "b"])

    def run(batches):
        fps, sets, parts, group, last, no, held = [], [], [], [], None, 0, 0
        for b in batches:
            for own, fp, part, *at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != last:
                    if fps and held >= HELD:
                        yield found(fps, sets, parts, np.array(group))
                        fps, sets, parts, group, held = [], [], [], [], 0
                    last, no = at, no + 1
                fps.append(fp)
                sets.append(np.frombuffer(own, np.uint64))
                parts.append(part)
                group.append(no)
                held += len(own)
        if fps:
            yield found(fps, sets, parts, np.array(group))

    return dealt.mapInArrow(tidied(run), "a binary, b binary")


def _sets(docs: DataFrame, near: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, set): the sorted shingle hashes of each text with a candidate, once. near: (id, fp)."""
    few = F.broadcast(near) if near.count() <= SMALL else near
    own = docs.select(id_col, text_col).join(few, id_col).select("fp", text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["fp", "set"])

    return staged(mapped(own, run, "fp binary, set binary").dropDuplicates(["fp"]), "sets")


def similar(docs: DataFrame, least: float, shingle: int, radius: int, width: int, smallest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): one row for each row of docs; links are pairs of texts that share ``least`` of their distinct shingles or more.

    Equal ids must have equal texts. Only texts with a candidate are read again.
    """
    prints = staged(shingle_sets(docs, shingle, width, smallest, id_col, text_col), "fingerprints")
    nodes = prints.select("fp", F.explode("keys").alias("key")).distinct()
    forest = staged(links(nodes, radius, width).distinct(), "links")
    named = prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.first("size").alias("size"))
    near = staged(named.join(components(forest).select(F.col("node").alias("fp"), "root"), "fp"), "candidates")
    sets = _sets(docs, near.select(F.col("least").alias(id_col), "fp"), shingle, id_col, text_col)
    # A link for each text, then the links between texts that these leave apart.
    one = forest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    good = staged(confirmed(one, sets, least), "confirmed")
    at = components(good)
    apart = _crossing(forest.join(one, ["a", "b"], "left_anti"), at)
    good = staged(good.union(confirmed(apart, sets, least)), "confirmed")
    parts = near.join(components(good).select(F.col("node").alias("fp"), F.col("root").alias("part")), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    parts = staged(parts, "parts")
    # What is still in several parts meets in groups, the texts of large components only with those that they may be linked to.
    spread = parts.groupBy("root").agg(F.min("part").alias("least_part"), F.max("part").alias("most_part"), _chunks())
    open_ = staged(spread.where("least_part != most_part").select("root", "chunks"), "open")
    left = open_.count()
    if left:
        several = parts.join(F.broadcast(open_) if left <= SMALL else open_, "root").select("fp", "part", "root", "chunks", "size")
        if not open_.where("chunks > 1").isEmpty():
            several = several.where("chunks = 1").unionByName(_sharing(several.where("chunks > 1"), sets, least))
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        dealt = several.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = sets.join(dealt, "fp").select("set", "fp", "part", "root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        good = good.union(confirmed_chunks(dealt, radius, width, least))
    return prints.select(id_col, "fp").join(_named(named, components(good)), "fp").select(id_col, "component_id")


def _chunks() -> F.Column:
    """The chunks of a component of texts, each with its size."""
    of = F.greatest(F.count(F.lit(1)) / SPLIT_SETS, F.sum("size") * 8 / SPLIT_BYTES)
    return F.greatest(F.ceil(of).cast("int"), F.lit(1)).alias("chunks")


def _sharing(several: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(fp, part, root, chunks, size): several, in groups outside which no text is similar to one of another part of its component.

    A shingle counts if texts of two parts hold it. A text of n shingles needs t = ceil(least * n) that count to be similar to any text of
    another part. Of m that count, rarest first, two similar texts share one among the first m - t + 1 of each. Texts
    that share such a shingle are a group, in chains too; all others go. Nothing similar is lost, and each shingle moves a fixed number of times.
    """
    # Numbers stand for texts and parts; a part has the name of one of its texts.
    own = staged(several.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = own.select(F.col("fp").alias("part"), F.col("node").alias("part_node"))
    own = staged(own.join(named, "part").select("fp", "part", "part_node", "node", "size", F.xxhash64("root").alias("salt")), "nodes")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lengths = np.array([len(x.as_buffer()) // 8 for x in b.column(0)], np.int64)
        salt = mix(np.repeat(b.column(3).to_numpy().view(np.uint64), lengths))
        keys = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) ^ salt
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(k).to_numpy(), lengths)) for k in (1, 2)] + [pa.array(keys.view(np.int64))], ["node", "part", "key"])

    held = mapped(sets.join(own, "fp").select("set", "node", "part_node", "salt"), run, "node bigint, part bigint, key bigint")
    across = [F.min("part").alias("low"), F.max("part").alias("high")]
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), *across).where("low != high").select("key", "texts")
    met = held.join(counts, "key").join(own.select("node", "size"), "node")
    of_text = Window.partitionBy("node")
    met = met.withColumn("m", F.count(F.lit(1)).over(of_text)).withColumn("place", F.row_number().over(of_text.orderBy("texts", "key")))
    first = staged(met.where(F.col("place") <= F.col("m") - F.ceil(F.lit(least) * F.col("size")) + 1).select("key", "node", "part"), "first")
    hubs = first.groupBy("key").agg(F.min("node").alias("hub"), *across).where("low != high").select("key", "hub")
    groups = components(first.join(hubs, "key").select("hub", "node"), "hub", "node")
    groups = staged(own.join(groups, "node").select("fp", "part", F.encode(F.col("root").cast("string"), "UTF-8").alias("root"), "size"), "groups")
    chunks = groups.groupBy("root").agg(_chunks())
    return groups.join(chunks, "root").select("fp", "part", "root", "chunks", "size")


def _crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different parts. parts: (node, root); a node that isn't there is a part of its own."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("root").alias(f"{end}_part"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")


def keep_one(docs: DataFrame, shingle: int, radius: int, width: int, smallest: int, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with one row of each component: of the least id, and of its least text hash where ids repeat.

    With ``least``, links are pairs of that shingle similarity or more, else pairs of fingerprints within the radius.

    Only ids and hashes are compared; the rows to drop are sent to every task
    if there are at most SMALL of them, and joined otherwise.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), text_hash.alias("hash")).alias("row"), F.col(text_col).alias("text"))
    rows = rows.select(F.struct(F.col("row.id").isNull().alias("none"), "row.id", "row.hash").alias("row"), "text")
    if least is None:
        found = near_duplicates(rows, shingle, radius, width, smallest, "row", "text").select("row", "component_id")
    else:
        found = similar(rows, least, shingle, radius, width, smallest, "row", "text")
    found = staged(found, "components")
    dropped = found.where("row != component_id").select("row").distinct()
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_hash.alias("hash"))
    if dropped.count() <= SMALL:
        dropped = F.broadcast(dropped)
    kept = docs.withColumn("__row", key).join(dropped.withColumnRenamed("row", "__row"), "__row", "left_anti")
    repeated = found.where("row = component_id").groupBy("row").count().where("count > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["__row"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _as_long(fp: str) -> F.Column:
    """The signed long of 8 bytes, least significant first."""
    text = F.hex(F.col(fp))
    out = F.lit(0).cast("long")
    for i in range(8):
        byte = F.conv(F.substring(text, 2 * i + 1, 2), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    return out


def hex_word(fp: str = "fp") -> F.Column:
    """16 lowercase hex digits of an 8-byte fingerprint."""
    text = F.hex(F.col(fp))
    return F.lower(F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(7, -1, -1)]))
