"""What several operators share: the shared folder, staged tables and byte tokens."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.sources import staging

#: XOR and multiply constants of the splitmix64 finaliser (fixed values).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd base for polynomial hashes modulo 2**64 and its inverse there.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


#: Bytes of an Arrow batch between Spark and Python, where the session leaves the setting at its default.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of long texts takes several times its size in the
    executor's JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(key, BATCH)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; Arrow batches are small from then on."""
    small_batches(spark)
    return staging.shared_folder(spark)


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again, with small Arrow batches."""
    small_batches(df.sparkSession)
    return staging.staged(df, name)


def file_system(uri: str):
    """(file system, path) for tasks that write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def tidied(run):
    """A task function that gives freed memory back when it ends: Python workers live on, and
    what the allocators keep would add to the memory of the next stage's tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


class Store:
    """key -> value by ``make``, which takes many keys at a time; values are kept in two halves.

    What is asked for again outlives what isn't: when the new half has ``most`` entries it
    becomes the older half, from which entries are taken back. ``fixed`` entries are always there.
    """

    def __init__(self, make: Callable[[list], list], most: int, fixed: dict | None = None):
        self.make, self.most, self.fixed = make, most, fixed or {}
        self.clear()

    def clear(self) -> None:
        self.new, self.old = dict(self.fixed), {}

    def learned(self, wanted: set) -> dict:
        """A dictionary that has every wanted key."""
        # difference() asks for each wanted key; ``-`` with keys() would walk the whole store.
        missing = wanted.difference(self.new)
        if missing and len(self.new) + len(missing) > self.most:
            self.old, self.new = self.new, dict(self.fixed)
            missing = wanted.difference(self.new)
        back = missing & self.old.keys()
        self.new.update({k: self.old[k] for k in back})
        unknown = list(missing - back)
        if unknown:
            self.new.update(zip(unknown, self.make(unknown), strict=True))
        return self.new


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with f called on each batch."""

    def run(batches):
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(tidied(run), schema)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over all 64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _powers(cache: dict[str, np.ndarray], name: str, base: int, n: int) -> np.ndarray:
    have = cache.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 18), base, np.uint64)
        step[0] = 1
        have = cache[name] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


_CACHE: dict[str, np.ndarray] = {}
#: One pseudo-random 64-bit number for each byte value.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


#: Bytes of text that byte_spans works on at once; a longer token is not cut.
PIECE = 1 << 20


def _in_pieces(data, offsets, kinds):
    """byte_spans over a long stretch, cut where a separator stands, to bound memory."""
    at, found = 0, []
    while at < len(data):
        end = min(at + PIECE // 2, len(data))
        while end < len(data):
            gaps = np.flatnonzero(kinds[data[end : end + PIECE // 2]] == 0)
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + PIECE // 2, len(data))
        if end - at > PIECE:  # one token of many MB, or a run without separators
            return _plain_spans(data, offsets, kinds)
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, end, side="left"))
        h, r, starts, ends = _plain_spans(data[at:end], np.clip(offsets[first : last + 1] - at, 0, end - at), kinds)
        found.append((h, r + first, starts + at, ends + at))
        at = end
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def byte_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts laid end to end: (64-bit hash, row, start, end) of each, in order.

    kinds maps a byte to 0 (separator) or the kind of token that it belongs to; a
    token is a run of one kind inside one row. Different tokens may share a hash, and some
    long ones are known to: who needs to be sure compares the bytes (``grouped``).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return (_in_pieces if len(data) > PIECE else _plain_spans)(data, offsets, kinds)


def byte_tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of byte_spans."""
    return byte_spans(data, offsets, kinds)[:2]


def _plain_spans(data, offsets, kinds):
    n = len(data)
    kind = kinds[data]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    inner = offsets[1:-1]
    change[inner[inner < n]] = True
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    keep = kind[runs] > 0
    starts, ends = runs[keep], ends[keep]
    return run_hashes(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def run_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of some stretches, end to end."""
    return data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def equal_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_lengths: np.ndarray) -> np.ndarray:
    """Whether each stretch of data has the bytes of its stretch of other."""
    out = lengths == other_lengths
    some = np.flatnonzero(out & (lengths > 0))
    stops = np.append(0, np.cumsum(lengths[some]))
    for i, j in slices(stops, 1 << 19):
        own = some[i:j]
        differ = run_bytes(data, starts[own], lengths[own]) != run_bytes(other, other_starts[own], lengths[own])
        at = np.flatnonzero(differ)
        if len(at):
            out[own[np.searchsorted(stops[i : j + 1] - stops[i], at, side="right") - 1]] = False
    return out


def grouped(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the tokens by hash in which equal ones follow each other as they stood, where a different one begins).

    Tokens count as equal when their bytes are: they are compared within each hash.
    """
    order = np.argsort(hashes, kind="stable")
    n = len(order)
    if not n:
        return order, np.zeros(0, np.int64)
    sorted_ = hashes[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    rest = order[~new]
    lengths = ends - starts
    if not equal_runs(data, starts[rest], lengths[rest], data, starts[first[~new]], lengths[first[~new]]).all():
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(data[s:e].tobytes(), len(seen)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        order = np.lexsort((np.arange(n), number, hashes))
        new = np.append(True, number[order][1:] != number[order][:-1])
    return order, np.flatnonzero(new)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes and its length: a polynomial modulo 2**64 from running sums, then mixed.

    Some stretches of 1,024 bytes and more share a hash whatever the base is.
    """
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * _powers(_CACHE, "up", BASE, n), dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_CACHE, "down", BASE_INVERSE, n + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(BASE))


def list_array(values: np.ndarray | pa.Array, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from its values end to end and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, kind))


#: 1 for the bytes of words: digits, letters, everything beyond ASCII; and each byte with A-Z in lower case.
WORD = np.zeros(256, np.uint8)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The distinct words of some texts by hash, and where each token stands in their order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        h, self.row, starts, ends = byte_spans(data, offsets, WORD)
        self.order, self.begins = grouped(data, h, starts, ends)
        first = self.order[self.begins]
        self.hashes = h[first]
        self.bytes = run_bytes(data, starts[first], (ends - starts)[first])
        self.ends = np.cumsum((ends - starts)[first])
        self.starts = np.append(0, self.ends)[:-1]

    def of_tokens(self) -> np.ndarray:
        """The word of each token."""
        out = np.zeros(len(self.order), np.int64)
        new = np.zeros(len(self.order), np.int64)
        new[self.begins[1:]] = 1
        out[self.order] = np.cumsum(new)
        return out

    def forget_tokens(self) -> None:
        """Keep the words alone."""
        self.row = self.order = self.begins = None

    def find(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The word that each stretch of data is, by its bytes; -1 if none."""
        out = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), np.searchsorted(self.hashes, hashes)
        while len(left):  # more than once only where different words share a hash
            inside = at < len(self.hashes)
            left, at = left[inside], at[inside]
            alike = self.hashes[at] == hashes[left]
            left, at = left[alike], at[alike]
            equal = equal_runs(data, starts[left], ends[left] - starts[left], self.bytes, self.starts[at], self.ends[at] - self.starts[at])
            out[left[equal]] = at[equal]
            left, at = left[~equal], at[~equal] + 1
        return out


def write_blocks(items: DataFrame, make: Callable[[list, list], object], most: int) -> list[str]:
    """Paths of blocks of items, each ``make(ids, texts)`` of about ``most`` text bytes or of one longer item.

    items: (id, text). Tasks write their own rows as they come, so equal rows pile up nowhere; only paths come
    to the driver, one or two for each ``most`` bytes.
    """
    folder = f"{shared_folder(items.sparkSession)}/blocks"
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]

    def run(batches):
        fs, place = file_system(folder)
        fs.create_dir(place, recursive=True)
        held: tuple[list, list] = ([], [])
        weight = 0

        def written():
            name = uuid.uuid4().hex  # a task that runs again writes files of its own
            with fs.open_output_stream(f"{place}/{name}") as f:
                f.write(pickle.dumps(make(*held)))
            held[0].clear()
            held[1].clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = len((text or "").encode()) + 64
                if held[0] and weight + own > most:
                    yield written()
                    weight = 0
                held[0].append(name)
                held[1].append(text)
                weight += own
        if held[0]:
            yield written()

    parts = items.coalesce(max(1, -(-int(size) // most)))
    return [r.path for r in parts.mapInArrow(tidied(run), "path string").collect()]


def read_block(path: str) -> object:
    """What write_blocks wrote."""
    fs, place = file_system(path)
    with fs.open_input_stream(place) as f:
        return pickle.loads(f.read())
