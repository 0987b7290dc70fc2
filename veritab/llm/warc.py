"""WARC archives: written as one gzip stream a file, normalised to a member a record, read by index.

Writing gives each task's rows one file, deflated as a single gzip stream, as old
crawlers left them. The normaliser inflates such a stream once, from front to back, cuts it into
records by their Content-Length, writes every record as a gzip member of its own, and a
sidecar index of (record id, type, offset, length of the member). Reading takes members by
that index and inflates nothing else.

Of records with equal payloads (SHA-1) of at least ``dedup_bytes`` bytes, the one with the largest
id is a response and the others are revisits that refer to it and hold no payload.

Defined results: a null payload is empty; a null url becomes ``urn:none``; a null id never refers and is
referred to by none, so null-id rows revisit a numbered row if there is one and are responses otherwise. Rows that share the largest id
are all responses. Empty tables give no archives. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import file_system, shared_folder, staged, tidied

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
#: Rows of repeated payloads up to which they are sent to every task; more are joined.
SMALL = 200_000
#: Bytes read, or inflated, at once.
PIECE = 1 << 20
#: A fixed date: a record's bytes depend on its row alone.
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url) if url else "urn:none"), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    text = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + text + b"\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """The named fields of a record, and where its block begins."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, end + 4


def with_references(pages: DataFrame, dedup_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, refers_to): only digests that occur more than once are kept and joined."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    large = F.octet_length("payload") >= dedup_bytes
    groups = rows.where(large).groupBy("digest").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = staged(groups.where("n > 1 and largest is not null").select("digest", "largest"), "groups")
    if groups.count() <= SMALL:
        groups = F.broadcast(groups)
    refers = F.when(large & (F.col("id").isNull() | (F.col("id") < F.col("largest"))), F.col("largest"))
    return rows.join(groups, "digest", "left").select("id", "url", "payload", refers.alias("refers_to"))


def _put(folder: str, name: str, write) -> str:
    """Write a file under a name of this attempt and move it to its place."""
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    own, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/{name}"
    with fs.open_output_stream(own, compression=None) as f:
        write(f)
    if fs.get_file_info(final).type.name != "NotFound":  # left by an attempt that was lost
        fs.delete_file(final)
    fs.move(own, final)
    return f"{folder}/{name}"


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """One monolithic .warc.gz for each task's rows of with_references; (path) of each."""
    folder = folder or f"{shared_folder(rows.sparkSession)}/monolithic"

    def run(batches):
        from pyspark import TaskContext

        some = [False]

        def write(f):
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            for b in batches:
                for k in range(b.num_rows):
                    some[0] = True
                    page, url, payload, refers = (b.column(i)[k].as_py() for i in range(4))
                    f.write(deflate.compress(record(page, url, payload.encode("utf-8", "surrogatepass"), refers)))
            f.write(deflate.flush())

        path = _put(folder, f"{TaskContext.get().partitionId():06d}.warc.gz", write)
        if some[0]:
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return staged(rows.mapInArrow(tidied(run), "path string"), "archives")


class _Inflated:
    """A gzip file of one or many members, inflated once from front to back."""

    def __init__(self, f):
        self.f, self.z, self.held, self.raw = f, zlib.decompressobj(31), bytearray(), b""

    def more(self) -> bool:
        """Inflate some more; False at the end."""
        while True:
            data = self.raw or self.f.read(PIECE)
            if not data:
                return False
            out = self.z.decompress(data, PIECE)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if out:
                self.held += out
                return True

    def records(self):
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self.more():
                    if self.held.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            fields, start = headers(bytes(self.held[: end + 4]))
            length = start + int(fields["content-length"]) + 4
            while len(self.held) < length:
                if not self.more():
                    raise ValueError("the archive ends inside a record")
            data = bytes(self.held[:length])
            del self.held[:length]
            yield fields, data


def normalise(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Rewrite each archive with a member for each record; (path, index_path) of each."""
    folder = folder or f"{shared_folder(archives.sparkSession)}/members"
    archives = archives.repartitionByRange(max(1, archives.count()), "path")

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                index = []

                def write(f, path=path, index=index):
                    fs, place = file_system(path)
                    at = 0
                    with fs.open_input_stream(place, compression=None) as source:
                        for fields, data in _Inflated(source).records():
                            z = zlib.compressobj(6, zlib.DEFLATED, 31)
                            member = z.compress(data) + z.flush()
                            f.write(member)
                            index.append({"id": fields["warc-record-id"], "type": fields["warc-type"], "offset": at, "length": len(member)})
                            at += len(member)

                name = path.rsplit("/", 1)[1]
                out = _put(folder, name, write)
                listed = _put(folder, f"{name}.idx", lambda f, index=index: f.write("".join(json.dumps(x) + "\n" for x in index).encode()))
                yield pa.RecordBatch.from_pydict({"path": [out], "index_path": [listed]})

    return staged(archives.mapInArrow(tidied(run), "path string, index_path string"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record, by the sidecar index.

    A response's digest is computed from the payload read and must equal the header's.
    """
    archives = archives.repartitionByRange(max(1, archives.count()), "path")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(field: str) -> int | None:
        text = field.strip("<>").removeprefix(ID)
        return int(text) if text else None

    def run(batches):
        for b in batches:
            for path, index_path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, place = file_system(path)
                listed = fs.open_input_stream(file_system(index_path)[1]).read().decode()
                rows, held = [], 0
                with fs.open_input_file(place) as f:
                    for line in io.StringIO(listed):
                        entry = json.loads(line)
                        f.seek(entry["offset"])
                        data = zlib.decompress(f.read(entry["length"]), 31)
                        fields, start = headers(data)
                        http_end = data.index(b"\r\n\r\n", start) + 4
                        size = int(next(x for x in data[start:http_end].split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        payload = None
                        if fields["warc-type"] == "response":
                            payload = data[http_end:-4]
                            if digest_of(payload) != digest or len(payload) != size:
                                raise ValueError(f"the payload of {entry['id']} does not have its digest")
                        refers = number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], refers, payload))
                        held += len(payload or b"")
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return archives.mapInArrow(tidied(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
