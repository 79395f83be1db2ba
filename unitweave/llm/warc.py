"""WARC archives of Zstandard frames with a dictionary in the leading skippable frame.

An archive is one skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame for each record, so
that a reader can start at any record it knows the place of. A record is a WARC/1.1 header, an HTTP response as its
block, and two line ends. Equal payloads are stored once: the record of the smallest page id is the ``response``, the
others are ``revisit`` records that refer to it and have no payload, but its digest and length.

``archives`` packs a table of pages into archives of bounded size, as rows (archive, content) of a table in the
shared folder, which any store that Spark can write to can hold; ``records`` reads such rows, or files read by
``spark.read.format("binaryFile")``, and checks every header, length and digest.

Rows: null html is an empty payload; a null url is an empty target; null page ids come last among equal payloads and
read back as null; rows of the same page id and payload are of the same type. Empty tables give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.scratch import stored

#: Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC, RAW_DICTIONARY = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528, 0xEC30A437
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}

#: Pages that the dictionary is trained on at most (about; chosen by a hash of the page id), and how much of each.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 65536
#: Compressed bytes after which the next archive begins.
ARCHIVE_BYTES = 4 << 20
#: Repeated payloads up to which their list (40 bytes each) goes to every task; a longer one is joined by a shuffle.
BROADCAST_REPEATS = 200_000


class WarcError(ValueError):
    """What is wrong with an archive."""


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or nothing where the samples are too few or too small for one."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def pack_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, kind: str, date: str) -> bytes:
    """The bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + END + block + END


class Writer:
    """Collects records of one archive."""

    def __init__(self, dictionary: bytes, level: int = 3):
        use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **use)
        self.lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        self.parts, self.size = [self.lead], len(self.lead)

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)

    def take(self) -> bytes:
        out, self.parts, self.size = b"".join(self.parts), [self.lead], len(self.lead)
        return out


def frames(archive: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of the frames of an archive, from their headers alone."""
    at, n = 0, len(archive)
    while at < n:
        if n - at < 8:
            raise WarcError("a frame is cut off")
        start, magic = at, struct.unpack_from("<I", archive, at)[0]
        if magic in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
        elif magic == FRAME_MAGIC:
            kind = archive[at + 4]
            single = kind >> 5 & 1
            at += 5 + (not single) + (0, 1, 2, 4)[kind & 3] + ((1 if single else 0), 2, 4, 8)[kind >> 6]
            while True:
                if at + 3 > n:
                    raise WarcError("a block is cut off")
                head = int.from_bytes(archive[at : at + 3], "little")
                at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
                if head & 1:
                    break
            at += 4 * (kind >> 2 & 1)
        else:
            raise WarcError(f"no frame begins with {magic:#x}")
        if at > n:
            raise WarcError("a frame is cut off")
        yield magic, start, at


def parse_record(raw: bytes) -> dict:
    """The headers of one record (names in lower case) with ``block``, ``payload_bytes`` and ``payload``; checks the
    version, the headers that must be there, the lengths and the digests."""
    head, found, rest = raw.partition(END)
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError("no WARC header")
    out: dict = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name:
            raise WarcError(f"bad header line {line[:60]!r}")
        out[name.decode().lower()] = value.strip().decode()
    if missing := NEEDED - out.keys():
        raise WarcError(f"no {', '.join(sorted(missing))}")
    size = int(out["content-length"]) if out["content-length"].isdigit() else -1
    if size < 0 or len(rest) != size + len(END) or rest[size:] != END:
        raise WarcError(f"content-length {out['content-length']}, but {len(rest) - len(END)} bytes")
    block = rest[:size]
    if "warc-block-digest" in out and out["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise WarcError("the block digest differs")
    http, found, payload = block.partition(END)
    stated = re.search(rb"(?im)^content-length: *([0-9]+)\r?$", http)
    if not found or not stated:
        raise WarcError("no HTTP header in the block")
    if out["warc-type"] == "response":
        if len(payload) != int(stated[1]):
            raise WarcError("the payload's length differs")
        if out.get("warc-payload-digest") != "sha1:" + base32_sha1(payload):
            raise WarcError("the payload digest differs")
    elif out["warc-type"] == "revisit" and payload:
        raise WarcError("a revisit has a payload")
    return out | {"block": block, "payload": payload, "payload_bytes": int(stated[1])}


def read_archive(archive: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    decompressor, first = zstandard.ZstdDecompressor(), True
    view = memoryview(archive)
    for magic, start, end in frames(archive):
        if magic == DICTIONARY_MAGIC and first:
            content = archive[start + 8 : end]
            if content[:4] == struct.pack("<I", FRAME_MAGIC):
                content = zstandard.ZstdDecompressor().decompress(content)
            if content[:4] != struct.pack("<I", RAW_DICTIONARY):
                raise WarcError("the leading frame holds no dictionary")
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME_MAGIC:
            try:
                yield parse_record(decompressor.decompress(view[start:end]))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame does not decompress: {e}") from None
        first = False


def _repeats(pages: DataFrame) -> DataFrame:
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    same = pages.select("page_id", digest.alias("digest")).groupBy("digest")
    return same.agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1").drop("n").withColumnRenamed("digest", "d")


def archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A stored table (archive, content) of the pages (page_id, url, html)."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    every = max(1, pages.count() // SAMPLE_PAGES)
    part = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(4 * SAMPLE_PAGES)
    dictionary = train([r.html.encode() for r in part.collect() if r.html])
    repeats = stored(_repeats(pages), "repeats")
    if repeats.count() <= BROADCAST_REPEATS:
        repeats = F.broadcast(repeats)
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    typed = pages.withColumn("digest", digest).join(repeats, F.col("digest") == F.col("d"), "left")
    typed = typed.select("page_id", "url", "html", "first_id", (F.col("d").isNotNull() & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("again"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, n, task = Writer(dictionary), 0, TaskContext.get().partitionId()

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{n:05d}.warc.zst"]), pa.array([writer.take()], pa.binary())], ["archive", "content"])

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                for page in batch.slice(k, 200).to_pylist():
                    kind = "revisit" if page["again"] else "response"
                    writer.add(pack_record(page["page_id"], page["url"] or "", (page["html"] or "").encode("utf-8", "surrogatepass"), page["first_id"], kind, date))
                    if writer.size > ARCHIVE_BYTES:
                        yield taken()
                        n += 1
        if len(writer.parts) > 1:
            yield taken()

    packed = typed.mapInArrow(pack, "archive string, content binary")
    return stored(packed, "archives", **{"compression": "uncompressed", "parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})


def records(table: DataFrame, content_col: str = "content") -> DataFrame:
    """The records of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda x: None if x is None or x.endswith(":none>") else int(x[len("<urn:page:") : -1])
        for batch in batches:
            for content in batch.column(0):
                rows = [(page(r["warc-record-id"]), r["payload_bytes"], r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"], page(r.get("warc-refers-to")), r.get("warc-target-uri")) for r in read_archive(content.as_py() or b"")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    return table.select(content_col).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex, coalesce(url, '') AS target_uri FROM pages
), firsts AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(p.hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, target_uri
FROM p JOIN firsts USING (hex)
"""
