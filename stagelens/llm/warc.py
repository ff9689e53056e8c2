"""WARC archives of Zstandard frames, one a record, with their dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .graphs import salted_join

#: The skippable frame that holds a dictionary, a Zstandard frame, WARC's version line, and the
#: profile of a revisit.
DICTIONARY_MAGIC, FRAME_MAGIC, VERSION = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on so many pages at most, of so many bytes each, and is so large at most.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
#: An archive is closed when its records have so many bytes.
ARCHIVE_BYTES = 4 << 20
#: Payloads shorter than this are always responses.
LEAST_REVISIT = 100
_DATE = "2024-01-01T00:00:00Z"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; empty if there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC record. A revisit has no block, but the digest and length of what it stands for."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "text/html; charset=utf-8"),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(payload))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


class Writer:
    """Appends records to an archive in memory."""

    def __init__(self, dictionary: bytes):
        self.head = DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True)
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.parts.append(self.frames.compress(data))
        self.size += len(data)

    def close(self) -> bytes:
        out = self.head + b"".join(self.parts)
        self.parts, self.size = [], 0
        return out


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record. Raises ValueError on frames that aren't a whole record each, on missing or
    repeated headers, wrong lengths, and payloads that don't have their digest."""
    at, dictionary = 0, None
    if data[:4] == DICTIONARY_MAGIC:
        at = 8 + int.from_bytes(data[4:8], "little")
        content = data[8:at]
        if len(content) != at - 8:
            raise ValueError("the dictionary is cut off")
        if content[:4] == FRAME_MAGIC:  # a dictionary may be compressed itself
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content)
    frames = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        if bytes(view[at : at + 3])[1:] == b"\x2a\x4d" and 0x50 <= data[at] <= 0x5F:  # other skippable frames
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        one = frames.decompressobj()
        try:
            body = one.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise ValueError(f"a frame is damaged: {e}") from e
        if not one.eof:
            raise ValueError("the last frame is cut off")
        at = len(data) - len(one.unused_data)
        yield _parse(body)


def _parse(body: bytes) -> tuple[dict[str, str], bytes]:
    head, mark, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0].encode() != VERSION:
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"a header is damaged or repeated: {line[:80]}")
        headers[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"missing headers: {sorted(missing)}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    block = rest[:size]
    if headers["warc-type"] == "response":
        if int(headers.get("warc-payload-length", size)) != size or headers.get("warc-payload-digest", "sha256:").partition(":")[2] not in ("", hashlib.sha256(block).hexdigest()):
            raise ValueError("a payload doesn't have its digest")
    return headers, block


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives (archive binary, n_records int) with a record for each row, as a table in the shared folder.

    Null html is an empty payload. Of rows with an equal payload of at least LEAST_REVISIT bytes that with the
    smallest page_id is the response, the others are revisits that refer to it; rows that repeat that page_id and
    payload are responses too. Null page_ids are kept; they are never referred to, and where all are null all are
    responses. Other columns aren't read. A payload that a third of all rows have is found by partial aggregation,
    and looked up by keys that are salted.
    """
    spark = pages.sparkSession
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    sample = own.select(F.substring("payload", 1, SAMPLE_BYTES).alias("x")).limit(SAMPLE_PAGES).collect()
    dictionary = spark.sparkContext.broadcast(train_dictionary([bytes(r.x) for r in sample if r.x]))

    digests = own.where(F.length("payload") >= LEAST_REVISIT).select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = own.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    first = stored(first, "first")
    revisits = salted_join(digests, first, ["digest"], "page_id", "n").where("not (page_id <=> first)")
    revisits = stored(revisits.select("page_id", "digest", "first").distinct(), "revisits")
    rows = rows.join(revisits.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "first"), F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(dictionary.value)
        many = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary()), pa.array([many], pa.int32())], names=["archive", "n_records"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, target, payload, digest, refers = (batch.column(i)[k].as_py() for i in range(5))
                kind = "response" if refers is None else "revisit"
                writer.add(record(kind, page, target, payload if refers is None else b"", digest.hex(), len(payload), refers))
                many += 1
                if writer.size >= ARCHIVE_BYTES:
                    yield flush()
                    many = 0
        if many:
            yield flush()

    return stored(rows.mapInArrow(run, "archive binary, n_records int"), "warc")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of each record of write()'s
    archives; payload is empty for a revisit, length and digest are those of the full payload."""
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for archive in batch["archive"]:
                rows = []
                for h, block in read_archive(archive.as_py()):
                    size, digest = int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], block, size, digest, number(h.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return archives.select("archive").mapInArrow(run, schema)
