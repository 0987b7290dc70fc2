"""Token ids in sorted-string-table shards: ordered by document identifier, searchable by it.

A shard file holds, in this order,

    blocks         zstd-compressed; an entry is (shared, unshared, value length) as
                   varints, the rest of the key, the value. Keys share the prefix of
                   the key before; the first key of a block is whole
    index          for each block its last key, offset, packed and whole length
    Bloom filter   ten bits a key, seven probes
    footer         entries, tokens, where index and filter lie, a CRC-32, the magic word

A key is the identifier (a null sorts first) and its number among equal identifiers;
a value is the ids as little-endian unsigned 32-bit integers. A look-up asks the
filter, finds the block by binary search in the index, and reads that block alone.

Writing range-partitions by identifier (Spark samples the ranges and sorts each outside
memory if need be); equal identifiers may fall into several shards, as ties are dealt by
the hash of the text. The number of ranges follows the bytes of text, and a range that turns out larger goes on in a further
file, so neither a task's keys nor a file grow with the table. A task writes to a name of its own and moves
the finished shard to its final place, so a repeated task does no harm.

Defined results: null text is empty (its document is the end id alone). Documents with equal ids
follow each other in the order of their text's hash and text. Empty tables give no shards. Extra columns are
not read.
"""

from __future__ import annotations

import bisect
import functools
import os
import uuid
import zlib
from array import array
from struct import calcsize, pack, unpack

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import Store, file_system, shared_folder, slices, staged, text_bytes, tidied

MAGIC = b"VTSST001"
_FOOTER = "<QQQQQQI8s"
#: Bytes of a block before compression; a larger value is a block of its own.
BLOCK = 1 << 16
#: Text bytes that a range is meant to hold, and packed bytes from which a further file is begun.
RANGE, FILE = 1 << 27, 1 << 28
END_ID = 0
#: Text bytes that are encoded at once; a longer document is encoded alone.
PIECE = 1 << 20
#: Pieces kept with their ids in each half of a Python worker's store, and new pieces that the library takes at once.
STORE, TOGETHER = 900_000, 4096


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    """Bytes that sort as (null first, identifier, number)."""
    return (b"\x00" + bytes(8) if doc_id is None else b"\x01" + pack(">Q", doc_id + (1 << 63))) + pack(">I", number)


def doc_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else unpack(">Q", key[1:9])[0] - (1 << 63)


class Bloom:
    """Ten bits a key, seven probes by double hashing of the identifier part."""

    PROBES = 7

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def probes(key: bytes, size: int) -> list[int]:
        a, b = zlib.crc32(key[:9]), zlib.adler32(key[:9]) * 2654435761 & 0xFFFFFFFF | 1
        return [(a + k * b) % size for k in range(Bloom.PROBES)]

    @staticmethod
    def of(keys: list[bytes]) -> Bloom:
        size = max(64, len(keys) * 10)
        bits = np.zeros(size, bool)
        for k in keys:
            bits[Bloom.probes(k, size)] = True
        return Bloom(np.packbits(bits))

    def may_have(self, key: bytes, keys: int) -> bool:
        size = max(64, keys * 10)
        return all(self.bits[p >> 3] >> (7 - (p & 7)) & 1 for p in Bloom.probes(key, size))


class Writer:
    """Streams entries in key order into an open file."""

    def __init__(self, f):
        self.f, self.pack = f, zstandard.ZstdCompressor(level=1).compress
        self.at = self.entries = self.tokens = 0
        self.block, self.size, self.last = [], 0, b""
        self.index, self.keys = [], []

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.last = key
        self.keys.append(key[:9])
        self.entries += 1
        self.tokens += len(value) // 4
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            packed = self.pack(b"".join(self.block))
            self.f.write(packed)
            self.index.append((self.last, self.at, len(packed), self.size))
            self.at += len(packed)
            self.block, self.size = [], 0

    def finish(self) -> int:
        """Write index, filter and footer; the file's length."""
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(packed) + varint(whole) for k, at, packed, whole in self.index)
        bloom = Bloom.of(self.keys).bits.tobytes()
        body = index + bloom
        self.f.write(body)
        self.f.write(pack(_FOOTER, self.entries, self.tokens, self.at, len(index), self.at + len(index), len(bloom), zlib.crc32(body), MAGIC))
        return self.at + len(body) + calcsize(_FOOTER)


class Reader:
    """A shard file, opened for look-ups and scans; it holds the index, the filter and one block."""

    def __init__(self, f, size: int):
        self.f = f
        foot = calcsize(_FOOTER)
        self.entries, self.tokens, index_at, index_len, _, bloom_len, crc, magic = unpack(_FOOTER, self.read(size - foot, foot))
        body = self.read(index_at, index_len + bloom_len)
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("the shard is damaged")
        self.index, at = [], 0
        while at < index_len:
            n, at = read_varint(body, at)
            key, at = body[at : at + n], at + n
            place, at = read_varint(body, at)
            packed, at = read_varint(body, at)
            whole, at = read_varint(body, at)
            self.index.append((key, place, packed, whole))
        self.lasts = [x[0] for x in self.index]
        self.bloom = Bloom(np.frombuffer(body[index_len:], np.uint8))

    def read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return bytes(self.f.read(n))

    def block(self, k: int):
        """(key, value) of each entry of a block."""
        _, place, packed, whole = self.index[k]
        data = zstandard.ZstdDecompressor().decompress(self.read(place, packed), max_output_size=whole)
        at, key = 0, b""
        while at < whole:
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            length, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + length]
            at += length

    def scan(self):
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of an identifier, in order; none if the shard lacks it."""
        key = key_of(doc_id)
        if not self.bloom.may_have(key, self.entries):
            return []
        out = []
        for k in range(bisect.bisect_left(self.lasts, key), len(self.index)):
            for found, value in self.block(k):
                if found[:9] == key[:9]:
                    out.append(value)
                elif found > key:
                    return out
        return out


class PieceEncoder:
    """The tokenizers library behind a store of pieces.

    A byte-level BPE file cuts text into pieces that never affect each other, so equal
    pieces have equal ids. In even text (words stand apart by single spaces or line ends) every cut before such a
    space and around a line end is one of the file's own, so its chunks are found by
    splitting strings. Other texts are cut by the file's pattern, and a text with a special token's
    string is encoded as a whole. Stored pieces are told apart by the pieces themselves.

    New pieces go to the library together, a line end between two of them: it is a piece of its own
    before whatever isn't white space, and its id occurs in no other piece. So the ids between two
    line ends are those of one piece.
    """

    #: The usual cut of byte-level BPE files (a fixed value), with white space as Unicode defines it.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

    def __init__(self, path: str):
        # Spark runs a worker for each core; the library's own threads would only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile(self.CUT).findall
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids
        self.store = Store(self.encode_pieces, STORE)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        # White space has a piece of its own, or is one space before others; the former is encoded alone.
        plain = [i for i, p in enumerate(pieces) if not p.isspace()]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.library.encode_batch_fast(["\n".join([pieces[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            if len(stops) != len(some):
                raise ValueError("the tokenizer file doesn't keep line ends apart")
            flat, stops = ids.tobytes(), (4 * stops).tolist()
            for i, a, b in zip(some, [0, *[x + 4 for x in stops]], stops, strict=False):
                out[i] = flat[a:b]
        rest = sorted(set(range(len(pieces))) - set(plain))
        for i, value in zip(rest, self.ids([pieces[i] for i in rest]), strict=True):
            out[i] = value
        return out

    def pieces(self, text: str) -> list[str]:
        if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return self.cut(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        cut, whole = {}, []
        for i, text in enumerate(texts):
            if text and any(s in text for s in self.special):
                whole.append(i)
            elif text:
                cut[i] = self.pieces(text)
        for i, value in zip(whole, self.ids([texts[i] for i in whole]), strict=True):
            out[i] = value
        get = self.store.learned(set().union(*cut.values())).__getitem__
        for i, pieces in cut.items():
            out[i] = b"".join(map(get, pieces))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder in each Python worker."""
    return PieceEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Write docs in ascending order of id; (shard, part, path, size, entries, tokens, first_id, last_id) of each file.

    ``shards`` is the number of ranges; without it there is one for each RANGE bytes of text, and at
    least one for each core.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shards"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange(shards, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text")

    def run(batches):
        from pyspark import TaskContext

        shard, part, writer, number, last = TaskContext.get().partitionId(), 0, None, 0, None
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, to in slices(text_bytes(b.column(1))[1], PIECE):
                texts = b.column(1).slice(at, to - at).to_pylist()
                for doc, value in zip(ids[at:to], encoder(tokenizer).encode(texts), strict=True):
                    if writer and writer.writer.at + writer.writer.size >= FILE:
                        yield writer.done(last)
                        writer, part = None, part + 1
                    if writer is None:
                        writer, number = _ShardFile(folder, shard, part, doc), 0
                    else:
                        number = number + 1 if doc == last else 0
                    last = doc
                    writer.writer.add(key_of(doc, number), value + pack("<I", END_ID))
        if writer:
            yield writer.done(last)

    return staged(placed.mapInArrow(tidied(run), "shard int, part int, path string, size long, entries long, tokens long, first_id long, last_id long"), "manifest")


class _ShardFile:
    """A shard file under a name of this attempt, moved to its place when it is whole."""

    def __init__(self, folder: str, shard: int, part: int, first: int | None):
        self.shard, self.part, self.first = shard, part, first
        self.path = f"{folder}/{shard:06d}-{part:04d}.sst"
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.own, self.final = f"{base}/.{uuid.uuid4().hex}", f"{base}/{shard:06d}-{part:04d}.sst"
        self.out = self.fs.open_output_stream(self.own)
        self.writer = Writer(self.out)

    def done(self, last: int | None) -> pa.RecordBatch:
        """The manifest's row."""
        size = self.writer.finish()
        self.out.close()
        if self.fs.get_file_info(self.final).type.name != "NotFound":  # left by an attempt that was lost
            self.fs.delete_file(self.final)
        self.fs.move(self.own, self.final)
        longs = {"size": size, "entries": self.writer.entries, "tokens": self.writer.tokens, "first_id": self.first, "last_id": last}
        return pa.RecordBatch.from_pydict({"shard": pa.array([self.shard], pa.int32()), "part": pa.array([self.part], pa.int32()), "path": [self.path]} | {k: pa.array([v], pa.int64()) for k, v in longs.items()})


def _open(path: str, size: int) -> Reader:
    fs, place = file_system(path)
    return Reader(fs.open_input_file(place), size)


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document: ids as little-endian unsigned 32-bit
    integers with the end id, start counts the ids of all documents before.

    The manifest has one small row for each file; only it is summed over all.
    """
    from pyspark.sql import Window

    before = F.sum("tokens").over(Window.orderBy("shard", "part")) - F.col("tokens")
    placed = staged(manifest.select(F.row_number().over(Window.orderBy("shard", "part")).alias("file"), "path", "size", before.alias("before")), "placed")
    # By range, since hashes of n files would leave a third of n tasks without one.
    placed = placed.repartitionByRange(max(1, placed.count()), "file")

    def run(batches):
        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                rows, held = [], 0
                for key, value in _open(path, size).scan():
                    rows.append((doc_of(key), start, len(value) // 4, value))
                    start += len(value) // 4
                    held += len(value)
                    if held > 1 << 23:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return placed.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def look_up(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary) of each stored document whose id is wanted; ids that no shard has give no row."""
    # One small row for each file of some hundred MB.
    shards = manifest.orderBy("shard", "part").select("path", "size", "first_id", "last_id").collect()
    least = -(1 << 63)
    firsts = np.array([least if r.first_id is None else r.first_id for r in shards], np.int64)
    lasts = np.array([least if r.last_id is None else r.last_id for r in shards], np.int64)

    def route(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            at = np.array([least if i is None else i for i in ids], np.int64)
            lows, highs = np.searchsorted(lasts, at, side="left"), np.searchsorted(firsts, at, side="right")
            pairs = [(i, k) for i, lo, hi in zip(ids, lows, highs, strict=True) for k in range(lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([int(p[1]) for p in pairs], pa.int32())], ["wanted", "shard"])

    def run(batches):
        opened, reader = None, None
        for b in batches:
            rows = []
            for doc, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != opened:
                    opened, reader = k, _open(shards[k].path, shards[k].size)
                rows += [(doc, v) for v in reader.get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])

    routed = wanted.select(F.col(id_col).cast("long").alias("wanted")).distinct().mapInArrow(tidied(route), "wanted long, shard int")
    return routed.repartition("shard").sortWithinPartitions("shard", "wanted").mapInArrow(tidied(run), "doc_id long, ids binary")


def encode_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """write_shards, then read_shards."""
    return read_shards(write_shards(docs, tokenizer))

