import base64
import gzip
import hashlib
import zlib
from struct import pack

import numpy as np
import pytest

from veritab.llm import media, warc

rng = np.random.default_rng(8)


def png(pixels, kinds):
    """A PNG whose rows are filtered one sample at a time, by the format's definition."""
    rows, width = pixels.shape[0], pixels.shape[1] * (pixels.shape[2] if pixels.ndim == 3 else 1)
    size = pixels.shape[2] if pixels.ndim == 3 else 1
    flat, out = pixels.reshape(rows, width).astype(int), bytearray()
    for y, kind in enumerate(kinds):
        out.append(kind)
        for x in range(width):
            a = flat[y, x - size] if x >= size else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - size] if y and x >= size else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((flat[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    chunk = lambda k, d: pack(">I", len(d)) + k + d + pack(">I", zlib.crc32(k + d))
    head = pack(">IIBBBBB", pixels.shape[1], rows, 8, {1: 0, 2: 4, 3: 2, 4: 6}[size], 0, 0, 0)
    z = zlib.compress(bytes(out))
    return media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(9, 5), (7, 4, 3), (5, 3, 4), (1, 1)])
def test_every_filter(shape):
    pixels = rng.integers(0, 256, shape, dtype=np.uint8)
    for kinds in ([k] * shape[0] for k in range(5)):
        assert np.array_equal(media.read_png(png(pixels, kinds)), pixels)
    assert np.array_equal(media.read_png(png(pixels, rng.integers(0, 5, shape[0]).tolist())), pixels)


def test_writer_and_damage():
    pixels = rng.integers(0, 256, (6, 20), dtype=np.uint8)
    for kind in (0, 1, 2, None):
        image = media.write_png(pixels, kind)
        assert np.array_equal(media.read_png(image), pixels)
        for at in (9, 20, len(image) // 2, len(image) - 6):
            with pytest.raises(ValueError):
                media.read_png(image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :])
    with pytest.raises(ValueError):
        media.read_png(media.write_png(pixels)[:-12])


def test_each_row_gets_a_filter_of_its_own():
    flat, ramp = np.full(64, 200, np.uint8), np.arange(64, dtype=np.uint8) * 3
    noise = rng.integers(0, 256, 64, dtype=np.uint8)
    pixels = np.stack([flat, flat, ramp, noise, noise, np.zeros(64, np.uint8)])
    image = media.write_png(pixels)
    kinds = np.frombuffer(zlib.decompress(image[41:-16]), np.uint8).reshape(6, 65)[:, 0].tolist()
    assert kinds == [1, 2, 1, kinds[3], 2, 0] and np.array_equal(media.read_png(image), pixels)


def test_digest_columns(spark):
    """The registered query against hashlib, zlib and the definition of the hash on the smallest tables."""
    from veritab.llm import queries

    path = "/root/testdata/sf0.001"
    want = {}
    for d in spark.read.parquet(f"{path}/documents.parquet").collect():
        raw = (d.text or "").encode()
        full = media.padded(raw)
        assert len(full) % 576 == 0 and full.startswith(raw) and set(full[len(raw) :]) <= {255} and 0 < len(full) < len(raw) + 577
        want[d.doc_id] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), full)
    kinds = set()
    for r in queries.op5_media(spark, path).collect():
        *numbers, full = want.pop(r.doc_id)
        assert [r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32] == numbers
        image = media.write_png(np.frombuffer(full, np.uint8).reshape(-1, 576))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        pixels = np.frombuffer(full, np.uint8).reshape(-1, 576)
        assert r.feature == media.cosine_hash(pixels)
        kinds |= set(np.frombuffer(zlib.decompress(b"".join(image[i + 4 : i + 4 + n] for i, n in idat(image))), np.uint8).reshape(-1, 577)[:, 0].tolist())
    assert not want and kinds >= {1, 2}  # so reading had filters to undo


def idat(image):
    """(place of the name, length) of each data chunk."""
    at = 8
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        if image[at + 4 : at + 8] == b"IDAT":
            yield at + 4, n
        at += 12 + n


def test_cosine_hash_against_the_definition():
    pixels = rng.integers(0, 256, (64, 64), dtype=np.uint8)
    small = pixels.reshape(32, 2, 32, 2).mean(axis=(1, 3))
    low = [[sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    low = np.round(np.array(low).reshape(-1), 6)
    assert media.cosine_hash(pixels) == np.packbits(low > np.median(low)).tobytes().hex()
    brighter = (pixels // 2 + 20).astype(np.uint8)
    apart = bin(int(media.cosine_hash(pixels), 16) ^ int(media.cosine_hash(brighter), 16)).count("1")
    assert apart <= 8
    assert len(media.cosine_hash(np.full((1, 576), 255, np.uint8))) == 16


def test_image_columns(spark):
    payloads = [b"", b"a", bytes(576), bytes(577), rng.bytes(5000), None, b"a"]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "doc_id long, payload binary, image string")
    rows = {r.doc_id: r for r in media.from_images(media.to_images(df)).collect()}
    for i, p in enumerate(payloads):
        r = rows[i]
        if p is None:
            assert r.payload is None and r.feature is None
        else:
            assert bytes(r.payload) == media.padded(p) and r.n_bytes == len(p) and len(r.payload) % 576 == 0
    assert rows[1].image == rows[6].image
    assert media.from_images(media.to_images(df.limit(0))).count() == 0


PAGES = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (3, None, "same"), (4, "http://b/\r\nz é", ""), (5, "u", None), (6, "http://c", "one é \r\n\r\n of its own"), (None, "n", "same"), (None, "n", "alone"), (6, "http://c", "one é \r\n\r\n of its own"), (7, "big", "x" * 3_000_000)]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    written = warc.write_archives(warc.with_references(pages))
    normal = warc.normalise(written)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(normal).collect())
    largest = {}
    for i, _, html in PAGES:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", -1), i)
    want = []
    for i, _, html in PAGES:
        p = (html or "").encode()
        top = largest.get(html or "")
        revisit = top is not None and (i is None or i < top)
        want.append((i is None, i or 0, base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want)
    for r in normal.collect():  # one member a record, at the places that the index names
        import json

        data = open(r.path.removeprefix("file://"), "rb").read()
        for line in open(r.index_path.removeprefix("file://")):
            e = json.loads(line)
            z = zlib.decompressobj(31)
            record = z.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert z.eof and not z.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    for r in written.collect():  # one stream a file
        z = zlib.decompressobj(31)
        z.decompress(open(r.path.removeprefix("file://"), "rb").read())
        assert z.eof and not z.unused_data
    assert warc.read_archives(warc.normalise(warc.write_archives(warc.with_references(pages.limit(0))))).count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "x" * 9), (4, "d", "x" * 9)], "page_id long, url string, html string")
    rows = {r.id: r.refers_to for r in warc.with_references(pages, dedup_bytes=5).collect()}
    assert rows == {1: None, 2: None, 3: 4, 4: None}


def test_many_members_are_read_as_one_stream():
    import io

    records = [warc.record(i, "u", b"p" * i, None) for i in range(5)]
    data = b"".join(gzip.compress(r) for r in records)
    assert [d for _, d in warc._Inflated(io.BytesIO(data)).records()] == records
    with pytest.raises(ValueError):
        list(warc._Inflated(io.BytesIO(gzip.compress(records[3][:-6]))).records())
