"""Web archives of Zstandard frames with a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; then comes one frame per WARC record.  The reader loads the
dictionary from that frame, decodes frame after frame and checks the version
line, the header fields, Content-Length, the record's end and the digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 16 * 1024
#: Pages, at most, and bytes of each that the dictionary is trained on.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 16 * 1024
ARCHIVE_BYTES = 8 << 20
MIN_REVISIT_BYTES = 100
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ArchiveError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in fields:
            raise ArchiveError(f"bad header field {line!r}")
        fields[name.lower()] = value
    try:
        length, kind, digest = int(fields["content-length"]), fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        n = int(fields["x-payload-length"])
    except (KeyError, ValueError) as e:
        raise ArchiveError(f"missing or bad field: {e}") from e
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"Content-Length {length}, but the block has {len(rest) - 4}")
    payload = rest[:-4].partition(b"\r\n\r\n")[2]
    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ArchiveError("the payload doesn't match its length or digest")
    if kind not in ("response", "revisit"):
        raise ArchiveError(f"unknown record type {kind}")
    if not {"warc-record-id", "warc-date"} <= fields.keys():
        raise ArchiveError("a record without an id or a date")
    # a record's id is made of its page and digest, so a revisit shows what digest its target has
    if kind == "revisit" and fields.get("warc-refers-to") != _record_id(int(fields.get("x-refers-to-page-id", -1)), digest):
        raise ArchiveError("a revisit whose target has another digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id"),
    }


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ArchiveError("the dictionary frame is cut")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw) if raw else None, 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        size = zstandard.frame_content_size(view[at:])
        one = reader.decompressobj()
        # a bounded look at first: a record is rarely larger than its content size
        step, out = max(4096, min(size if size > 0 else 1 << 16, 1 << 20)), []
        pos = at
        try:
            while not one.eof:
                if pos >= len(data):
                    raise ArchiveError("the last frame is cut")
                out.append(one.decompress(view[pos : pos + step]))
                pos += step
        except zstandard.ZstdError as e:
            raise ArchiveError(str(e)) from e
        at = min(pos, len(data)) - len(one.unused_data)
        raw = b"".join(out)
        if size >= 0 and len(raw) != size:
            raise ArchiveError("the frame's content size is wrong")
        yield decode_record(raw)


def train_dictionary(pages: DataFrame) -> bytes:
    """Trained on a bounded sample, pages of the smallest hashes; empty if there are
    too few.  The hashes are cut at twice the sample's share of the pages first, so
    that tasks hand over few pages."""
    pages = pages.select("html", F.xxhash64("page_id").alias("h"))
    n, space = pages.count(), 1 << 40
    rows = pages.filter(F.pmod("h", F.lit(space)) < min(space, 2 * SAMPLE_PAGES * space // max(1, n) + 1))
    html = F.substring(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 1, SAMPLE_BYTES)
    rows = rows.select(html.alias("html"), "h").orderBy(F.pmod("h", F.lit(space)), "html").limit(SAMPLE_PAGES)
    samples = [bytes(r["html"]) for r in rows.select("html").collect() if r["html"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): whole archives of about ``archive_bytes``, one row each."""
    frame = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        part, nth, parts, size = TaskContext.get().partitionId(), 0, [frame], len(frame)

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:05d}-{nth:05d}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c for c in batch.columns)):
                body = html.as_py()
                raw = encode_record(page_id.as_py(), url.as_py(), body.encode("utf-8") if body else b"", digest.as_py(), refers_to.as_py())
                parts.append(packer.compress(raw))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield whole()
                    nth, parts, size = nth + 1, [frame], len(frame)
        if len(parts) > 1:
            yield whole()

    return pages.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, "archive string, content binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of every archive of a (…, content) table, such as binaryFile gives."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds = [x for x in kinds if with_payload or x[0] != "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record in read_archive(content.as_py()):
                    rows.append(record)
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    types = {"page_id": "long", "payload": "binary", "payload_bytes": "long", "refers_to": "long"}
    return archives.select("content").mapInArrow(read, ", ".join(f"{n} {types.get(n, 'string')}" for n, _ in kinds))


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of its own in a folder that pyarrow can reach;
    (path, bytes) of the files.  A file appears under its name when it is whole."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for name, content in zip(*batch.to_pydict().values()):
                path = f"{root}/{name}"
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, path)
                out.append((path, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64())], names=["path", "bytes"])

    return archives.select("archive", "content").mapInArrow(save, "path string, bytes long")


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return read_archives(spark.read.format("binaryFile").load(path).select("content"), with_payload)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null for a response)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    p = p.withColumn("payload_digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    firsts = p.filter(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return p.join(firsts, "payload_digest", "left").select("page_id", "url", "html", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page as a record and read all records back.

    page_id, payload_bytes, payload_digest, record_type, refers_to: one row for
    each row of ``pages``.  A null html is an empty payload; among equal payloads
    of at least 100 bytes the smallest page_id (each row that has it, if it is
    repeated) is the response.  A null page_id never is what others refer to
    unless all are null; then all are responses.
    """
    archives = checkpoint(write_archives(with_revisits(pages), train_dictionary(pages)))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
