"""Media columns: PNG images in binary columns, read with checksum tests, and their hashes.

A payload becomes an 8-bit greyscale image of a fixed width: each row gets the filter that
leaves the smallest sum of signed differences, the rows are deflated into IDAT chunks, every chunk carries its CRC-32. Reading checks
the signature, each chunk's checksum and the length of the pixel data, then undoes the row filters
with numpy. The perceptual hash shrinks the image to 32 by 32 means, takes the
two-dimensional cosine transform, and sets a bit for each of the 64 lowest frequencies
that exceeds their median.

Defined results: a null payload gives a null image; a null image gives null pixels and features. A
damaged image raises an error that names the chunk. Equal payloads give equal bytes. Rows are independent.
Extra columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veritab.llm.common import mapped

#: The first bytes of every PNG file (fixed value).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payload bytes come in multiples of this, which is also the width of the image.
WIDTH = 576
IDAT = 1 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return pack(">I", len(body)) + kind + body + pack(">I", zlib.crc32(kind + body))


def _filtered(pixels: np.ndarray, kind: int) -> np.ndarray:
    """Rows of 8-bit samples after filter 0 (none), 1 (left) or 2 (up); arithmetic is modulo 256."""
    out = pixels.copy()
    if kind == 1:
        out[:, 1:] -= pixels[:, :-1]
    elif kind == 2:
        out[1:] -= pixels[:-1]
    return out


def write_png(pixels: np.ndarray, filter_kind: int | None = None, level: int = 1) -> bytes:
    """A greyscale image [rows, columns] of uint8. Without a filter each row gets its own of 0 to 2: the
    one whose samples, read as signed, have the smallest sum without their signs; a tie goes to the lower number."""
    rows, columns = pixels.shape
    lines = np.empty((rows, columns + 1), np.uint8)
    if filter_kind is None:
        tried = np.stack([_filtered(pixels, k) for k in (0, 1, 2)])
        sizes = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
        lines[:, 0] = sizes.argmin(axis=0)
        lines[:, 1:] = tried[lines[:, 0], np.arange(rows)]
    else:
        lines[:, 0] = filter_kind
        lines[:, 1:] = _filtered(pixels, filter_kind)
    packed = zlib.compress(lines.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT))
    return SIGNATURE + _chunk(b"IHDR", pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, size: int) -> np.ndarray:
    """Undo the filter that each line's first byte names; size: bytes of a pixel."""
    kinds, data = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    if not kinds.any():
        return data
    out = np.empty_like(data)
    columns = data.shape[1]
    above = np.zeros(columns, np.uint8)
    row = 0
    while row < len(lines):
        kind = kinds[row]
        stop = row + 1
        while stop < len(lines) and kinds[stop] == kind:  # a run of lines with one filter
            stop += 1
        part = data[row:stop]
        if kind == 0:
            out[row:stop] = part
        elif kind == 1:
            out[row:stop] = np.cumsum(part.reshape(len(part), -1, size), axis=1, dtype=np.uint8).reshape(len(part), -1)
        elif kind == 2:
            out[row:stop] = np.cumsum(np.concatenate([above[None], part]), axis=0, dtype=np.uint8)[1:]
        else:
            for k in range(row, stop):  # each sample needs its left neighbour: one step a pixel
                line, prior = data[k].astype(np.int64), above.astype(np.int64)
                done = np.zeros(columns + size, np.int64)
                upper = np.concatenate([np.zeros(size, np.int64), prior])
                for x in range(size, columns + size, size):
                    left, up, corner = done[x - size : x], upper[x : x + size], upper[x - size : x]
                    if kind == 3:
                        guess = (left + up) // 2
                    else:
                        p = left + up - corner
                        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                    done[x : x + size] = (line[x - size : x] + guess) & 255
                out[k] = above = done[size:].astype(np.uint8)
        above = out[stop - 1]
        row = stop
    return out


def read_png(image: bytes) -> np.ndarray:
    """[rows, columns] of a greyscale or [rows, columns, channels] of a colour image with 8-bit samples."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed, ended = 8, None, [], False
    while at < len(image) and not ended:
        (length,) = unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + length]
        if len(body) != length or unpack(">I", image[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} at byte {at} is damaged")
        if kind == b"IHDR":
            head = unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if not head or not ended:
        raise ValueError("the header or the end chunk is missing")
    columns, rows, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit grey and colour samples without interlacing are read")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != rows * (columns * channels + 1):
        raise ValueError("the pixel data has the wrong length")
    out = _unfilter(raw.reshape(rows, -1), channels)
    return out if channels == 1 else out.reshape(rows, columns, channels)


@functools.lru_cache(maxsize=1)
def cosine_matrix() -> np.ndarray:
    """The eight lowest rows of the 32-point cosine transform."""
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / 64)


def _means(a: np.ndarray, parts: int, axis: int) -> np.ndarray:
    """Whole sums of ``parts`` near-equal stretches along an axis, over their lengths; a short axis repeats."""
    n = a.shape[axis]
    starts = np.arange(parts) * n // parts
    lengths = np.maximum(1, np.diff(np.append(starts, n)))
    sums = np.add.reduceat(a, starts, axis=axis)
    return sums / lengths.reshape((-1, 1) if axis == 0 else (1, -1))


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: signs of the 64 lowest frequencies against their median."""
    small = _means(_means(pixels.astype(np.float64), 32, 0), 32, 1)
    m = cosine_matrix()
    low = np.round(m @ small @ m.T, 6).reshape(-1)
    return np.packbits(low > np.median(low)).tobytes().hex()


def padded(payload: bytes, to: int = WIDTH) -> bytes:
    """payload with bytes 255 behind, up to a positive multiple of ``to``."""
    return payload + b"\xff" * (max(to, -(-len(payload) // to) * to) - len(payload))


def to_images(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """(id, n_bytes, image binary): each binary payload, padded, as a PNG image."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch):
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            images, sizes = [], []
            for x in part.column(1):
                p = x.as_py()
                sizes.append(None if p is None else len(p))
                images.append(None if p is None else write_png(np.frombuffer(padded(bytes(p)), np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], [id_col, "n_bytes", "image"])

    return mapped(df.select(id_col, payload_col), run, f"`{id_col}` {kind}, n_bytes long, image binary")


def from_images(df: DataFrame, id_col: str = "doc_id", image_col: str = "image") -> DataFrame:
    """(id, n_bytes, image, payload binary, feature string): the samples read back, and their hash."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch):
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            payloads, features = [], []
            for x in part.column(2):
                pixels = None if x.as_py() is None else read_png(x.as_py())
                payloads.append(None if pixels is None else pixels.tobytes())
                features.append(None if pixels is None else cosine_hash(pixels.reshape(pixels.shape[0], -1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], [id_col, "n_bytes", "image", "payload", "feature"])

    return mapped(df.select(id_col, "n_bytes", image_col), run, f"`{id_col}` {kind}, n_bytes long, image binary, payload binary, feature string")
