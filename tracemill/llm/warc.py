"""Operator 3: WARC archives in Zstandard, with a dictionary.

An archive starts with a skippable frame that holds the dictionary (itself a Zstandard frame); then comes one frame per
record, compressed with that dictionary, so that each record can be read alone. The reader walks the frames by their
block headers and checks, for each record, that the frame holds exactly one, its version and header lines, that
Content-Length is the block's length and that a response's payload has the length and digest that its headers state.

Archives are rows (archive, content) of a DataFrame: those that write_archives makes of pages, or files that Spark's
binaryFile source reads; save_archives writes rows out as files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the file format: the magic numbers of the dictionary's skippable frame and of a frame.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"
#: An archive ends at this many bytes of payload, or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 4_000_000, 2000
#: A record that is read has at most so many bytes; a larger one is an error.
RECORD_BYTES = 1 << 30
#: Of an archive's payloads, so many, and so many bytes of each, train its dictionary of so many bytes.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 64, 8192, 16_384


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _dictionary(payloads: list[bytes]) -> bytes:
    samples = [p[:SAMPLE_BYTES] for p in payloads[:SAMPLES] if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too small: the samples themselves serve
        return (b"".join(samples) or b"WARC-Type: response\r\n")[:DICTIONARY_BYTES].ljust(8, b" ")


def _record(page_id, url, payload: bytes, kind: str, refers_to, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{_digest(payload)}"), ("WARC-Payload-Length", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def pack(rows: list[tuple], date: str) -> bytes:
    """One archive of rows (page_id, url, payload, kind, refers_to)."""
    words = _dictionary([r[2] for r in rows])
    head = zstandard.ZstdCompressor(level=9).compress(words)
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(head)) + head + b"".join(press.compress(_record(*r, date)) for r in rows)


def frames(content: memoryview) -> Iterator[memoryview]:
    """The frames of an archive, by their headers."""
    at = 0
    while at < len(content):
        if at + 8 > len(content):
            raise ArchiveError(f"{len(content) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", content, at)
        start = at
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == FRAME:
            try:
                at += zstandard.frame_header_size(bytes(content[at : at + 18]))
                check = zstandard.get_frame_parameters(bytes(content[start : start + 18])).has_checksum
            except zstandard.ZstdError as e:
                raise ArchiveError(f"bad frame header at {start}") from e
            last = 0
            while not last:
                if at + 3 > len(content):
                    raise ArchiveError(f"the frame at {start} is cut off")
                block = int.from_bytes(content[at : at + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                at += 3 + (1 if kind == 1 else block >> 3)
            at += 4 * check
        else:
            raise ArchiveError(f"no frame at {start}")
        if at > len(content):
            raise ArchiveError(f"the frame at {start} is cut off")
        yield content[start:at]


def _whole(reader: zstandard.ZstdDecompressor, frame: memoryview, most: int) -> bytes:
    """A frame's content of at most so many bytes."""
    with reader.stream_reader(frame) as stream:
        raw = stream.read(most + 1)
    if len(raw) > most:
        raise ArchiveError(f"a record of over {most} bytes")
    return raw


def _text(value: bytes, frame: int) -> str:
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ArchiveError(f"frame {frame}: a header that is not UTF-8") from e


def unpack(content: bytes, most: int = RECORD_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers by lower-case name, and the block. A record may have `most` bytes; anything against the format is an ArchiveError."""
    reader = None
    for k, frame in enumerate(frames(memoryview(content))):
        magic = struct.unpack_from("<I", frame)[0]
        if magic != FRAME:
            if magic == SKIPPABLE and k == 0:
                words = bytes(frame[8:])
                try:
                    if words[:4] == struct.pack("<I", FRAME):
                        words = b"".join(_whole(zstandard.ZstdDecompressor(), x, most) for x in frames(memoryview(words)))
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
                except zstandard.ZstdError as e:
                    raise ArchiveError(f"the dictionary: {e}") from e
            continue
        reader = reader or zstandard.ZstdDecompressor()
        try:
            raw = _whole(reader, frame, most)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"frame {k}: {e}") from e
        head, gap, rest = raw.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
            raise ArchiveError(f"frame {k} is no WARC record")
        fields: dict[str, str] = {}
        last = None
        for line in lines[1:]:
            if line[:1] in (b" ", b"\t") and last:  # a line that goes on
                fields[last] += " " + _text(line.strip(), k)
                continue
            name, colon, value = line.partition(b":")
            if not colon or not re.fullmatch(rb"[!#-'*+.0-9A-Z^_`a-z|~-]+", name):
                raise ArchiveError(f"frame {k}: bad header line {line[:80]!r}")
            last = name.decode().lower()
            fields[last] = _text(value.strip(), k)
        for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
            if needed not in fields:
                raise ArchiveError(f"frame {k} has no {needed}")
        if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
            raise ArchiveError(f"frame {k}: Content-Length {fields['content-length']} and {len(rest) - 4} bytes")
        yield fields, rest[:-4]


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives (archive string, content binary) with a record for each row of pages (page_id, url, html).

    The payload is html in UTF-8, a null one empty; a null url is left out. Of rows with equal payloads of at least
    min_bytes, those with the largest page_id are responses and the others revisit it; smaller payloads are all
    responses. A null page_id is smaller than any other; if a group has only such, all of it are responses. Other
    columns are ignored. date is for records of which no time is known.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    latest = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.join(latest.hint("shuffle_hash"), "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:06d}-{number:06d}.warc.zst"], "content": pa.array([pack(held, date)], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                page_id, url, payload, refers_to = row
                held.append((page_id, url, payload, "response" if refers_to is None else "revisit", refers_to))
                size += len(payload)
                if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return marked.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, content binary")


_HASHES = {"sha1": 20, "md5": 16, "sha256": 32, "sha512": 64}


def _holds(stated: str, payload: bytes) -> bool:
    """Whether a digest (algorithm:value, in base32 or hexadecimal) is that of the payload; one of another algorithm is believed."""
    kind, _, value = stated.partition(":")
    if kind.lower() not in _HASHES:
        return True
    own = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def record(fields: dict[str, str], block: bytes) -> tuple:
    """A record as read_archives returns it, with its payload last."""
    kind, body = fields["warc-type"], None
    if kind in ("response", "resource", "conversion"):
        body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").partition(";")[0].strip().lower() == "application/http" else block
    stated, length = fields.get("warc-payload-digest"), fields.get("warc-payload-length")
    if length is not None and not re.fullmatch(r"[0-9]{1,18}", length):
        raise ArchiveError(f"{fields['warc-record-id']}: a payload of {length} bytes")
    if body is not None and (stated is not None and not _holds(stated, body) or length is not None and int(length) != len(body)):
        raise ArchiveError(f"{fields['warc-record-id']}: the payload differs from its digest or length")
    own = _digest(body) if body is not None else stated[5:].upper() if (stated or "").lower().startswith("sha1:") else None
    page = lambda name: int(found[1]) if (found := re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", fields.get(name, ""))) else None
    return page("warc-record-id"), fields["warc-record-id"], fields.get("warc-target-uri"), len(body) if body is not None else None if length is None else int(length), own, kind, page("warc-refers-to"), fields.get("warc-refers-to"), body


_RECORD = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string"


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives (a column content): page_id, record_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_id, and payload if asked for.

    Archives may come from elsewhere. record_type is WARC-Type; page_id and refers_to are the numbers of records that
    write_archives names, else null, and record_id and refers_to_id the names as they are. The payload is the body of an HTTP
    response, or the block of another response, resource or conversion; it is held against a stated digest (SHA-1, SHA-256,
    SHA-512 or MD5) and length. payload_bytes and payload_digest (bare upper-case base32 of the SHA-1) are of the full
    payload; of a revisit, which carries none, as its headers state; null for other records that state none. A null content
    has no records. A broken archive raises ArchiveError.
    """
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: 8 + payload]
    names = [x.split()[0] for x in _RECORD.split(", ")] + ["payload"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for fields, block in unpack(content.as_py() or b""):
                    rows.append(record(fields, block)[: 8 + payload])
                    size += len(block)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return archives.select("content").mapInArrow(run, _RECORD + ", payload binary" * payload)


def save_archives(archives: DataFrame, folder: str) -> None:
    """Writes each archive as a file into a folder that all executors see as a path."""
    os.makedirs(folder, exist_ok=True)

    def run(rows) -> None:
        for row in rows:
            at = os.path.join(folder, row.archive)
            with open(f"{at}.part", "wb") as f:
                f.write(row.content)
            os.replace(f"{at}.part", at)

    archives.foreachPartition(run)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_archives(archives, payload=False).drop("record_id", "url", "refers_to_id")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS latest FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM d
"""
