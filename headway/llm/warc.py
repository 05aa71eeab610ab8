"""Dictionary-compressed WARC archives: written by Spark, read back whole.

A Zstandard dictionary is built from archived records (a bounded sample, see SAMPLE_RECORDS and
SAMPLE_BYTES). Each archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, and each record after it is a frame of its own, so any record can be read by itself.
The first record is a warcinfo.

Files are written by Spark's text writer, which commits whole files only. Its line separator is
an empty skippable frame, which readers of Zstandard pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fraction, joined

MAGIC = 0x184D2A5D
#: An empty skippable frame; its bytes are ASCII characters.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
LEVEL = 3
DICTIONARY_BYTES = 110 << 10
#: The dictionary is built from about so many records and at most so many characters of each.
SAMPLE_RECORDS = 600
SAMPLE_BYTES = 16 << 10
ARCHIVE_BYTES = 16 << 20
#: The date of records where none is given; a fixed one, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def info_record(archive: str, date: str = DATE) -> bytes:
    """The record that opens an archive: its format and what wrote it."""
    block = b"format: WARC File Format 1.1\r\nsoftware: headway\r\n"
    head = f"WARC-Record-ID: <urn:archive:{archive}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return INFO + head.encode() + block + b"\r\n\r\n"


def record(row_id, url, digest: str, size: int, refers, payload: bytes | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record where payload is None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if row_id is None else row_id}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; the payload digest of a response is computed anew and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    out = {
        "page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = block.partition(b"\r\n\r\n")[2]
        if payload_digest(out["payload"]) != out["payload_digest"] or len(out["payload"]) != out["payload_bytes"]:
            raise ValueError(f"record {out['page_id']}: the payload doesn't match its digest")
    return out


def build_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records of about SAMPLE_RECORDS pages, picked by a hash; empty if there is too little.

    The share of pages is set from their number, so tasks send no more than the sample in all.
    """
    share = min(1.0, SAMPLE_RECORDS / max(1, pages.count()))
    picked = pages.where(fraction(2, "page_id", "url", "html") < share)
    rows = picked.select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).collect()
    samples = sorted((r["html"] or "").encode("utf-8", "surrogatepass") for r in rows)
    samples = [record(i, "https://example.com/", payload_digest(s), len(s), None, s) for i, s in enumerate(samples)]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform samples: archives go without a dictionary
        return b""


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Writes a record for each row of pages (page_id, url, html) into archives below path.

    Of rows with equal payloads, those with the largest page_id are responses, the others
    revisits of it; a null page_id counts as smallest. A null html is an empty payload, a null
    url gives no target. Other columns are ignored. A task starts a new archive when one
    has archive_bytes; an archive is one file in a folder of its own.
    """
    dictionary = build_dictionary(pages)
    body = F.coalesce("html", F.lit("")).cast("binary")
    digested = pages.select("page_id", "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).cast("long").alias("size"))
    same = ["sha", "size"]
    counted = digested.groupBy(*same).agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n"))
    repeated = checkpointed(counted.where("n > 1 and refers is not null").drop("n"))
    marked = joined(digested, repeated, same).withColumn("revisit", F.col("refers").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers")))
    rows = marked.select("page_id", "url", "sha", "size", "revisit", "refers", F.when(~F.col("revisit"), F.coalesce("html", F.lit(""))).alias("html"))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known).compress
        head = struct.pack("<II", MAGIC, len(dictionary)) + dictionary
        task, archive, name, filled, n, out = TaskContext.get().partitionId(), -1, "", archive_bytes, 0, []
        for batch in batches:
            for page, url, sha, size, revisit, refers, html in zip(*(batch[c].array for c in batch.columns), strict=True):
                if filled >= archive_bytes:
                    archive, filled, n = archive + 1, 0, n + 1
                    name = f"{task:06d}-{archive:06d}"
                    out += [(name, n, head), (name, n + 1, compress(info_record(name, date)))]
                    n += 1
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                payload = None if revisit else html.encode("utf-8", "surrogatepass")
                frame = compress(record(page, url, digest, size, refers, payload, date))
                filled, n = filled + len(frame), n + 1
                out.append((name, n, frame))
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=["archive", "n", "frame"])
                    out = []
        yield pd.DataFrame(out, columns=["archive", "n", "frame"])

    written = rows.select(F.col("page_id").cast("string"), "url", "sha", "size", "revisit", F.col("refers").cast("string"), "html")
    written = written.mapInPandas(frames, "archive string, n long, frame binary")
    written.sortWithinPartitions("archive", "n").select("archive", F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", SEPARATOR
    ).partitionBy("archive").text(path)


def frames_of(data: memoryview) -> Iterator[memoryview]:
    """The frames of an archive, one after another."""
    at = 0
    while at < len(data):
        start, (magic,) = at, struct.unpack_from("<I", data, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            checked = data[at + 4] & 4
            at += zstandard.frame_header_size(data[at : at + 18])
            last = 0
            while not last:
                word = int.from_bytes(data[at : at + 3], "little")
                last, kind, size = word & 1, word >> 1 & 3, word >> 3
                at += 3 + (1 if kind == 1 else size)
            at += 4 if checked else 0
        yield data[start:at]


def records_of(content: bytes) -> Iterator[dict]:
    reader = zstandard.ZstdDecompressor()
    for frame in frames_of(memoryview(content)):
        (magic,) = struct.unpack_from("<I", frame)
        if magic == MAGIC and len(frame) > 8:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame[8:])))
        elif not 0x184D2A50 <= magic <= 0x184D2A5F:
            data = reader.decompress(frame)
            if not data.startswith(INFO):
                yield parse(data)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below path: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    payload is null for revisits, and for all where payload=False (digests are verified all the same).
    """
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for r in records_of(content):
                    out.append([r[x] if x != "payload" or payload else None for x in names])
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        out = []
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
