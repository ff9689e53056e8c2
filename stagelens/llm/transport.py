"""Payload columns as MPEG transport streams: packets, program tables, timestamps, random-access points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKET, SYNC = 188, 0x47
#: Fixed values of the format and of our one program.
PAT_PID, PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x0000, 0x1000, 0x0100, 1, 0x06, 0xBD
CLOCK, FRAME_TICKS = 90_000, 3_600
#: Payloads are filled up with bytes 255 to a multiple of this.
UNIT = 576
#: Bytes of an access unit, access units between random-access points, and between program tables.
ACCESS_UNIT, RANDOM_EVERY, TABLES_EVERY = 16 * UNIT, 8, 32
#: PES header with a presentation timestamp; adaptation field with a clock reference.
PES_HEADER, CLOCK_FIELD = 14, 8


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, not reflected, initially all ones."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(body: bytes, table: int) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 4).to_bytes(2, "big")
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(64)
def _tables(counter: int) -> bytes:
    """A packet each with the program association and the program map."""
    version = b"\xc1\x00\x00"
    pat = _section(b"\x00\x01" + version + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"), 0x00)
    stream = bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(PROGRAM.to_bytes(2, "big") + version + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream, 0x02)
    out = b""
    for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)):
        out += (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15]) + b"\x00" + section).ljust(PACKET, b"\xff")
    return out


def _stamp(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | (ticks >> 30 & 7) << 1, ticks >> 22 & 255, (ticks >> 15 & 127) << 1 | 1, ticks >> 7 & 255, (ticks & 127) << 1 | 1])


def mux(payload: bytes) -> bytes:
    """The payload in access units of ACCESS_UNIT bytes, each a PES packet with a timestamp."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        if k % TABLES_EVERY == 0:
            out.append(_tables(k // TABLES_EVERY % 16))
        unit = payload[at : at + ACCESS_UNIT]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(k * FRAME_TICKS) + unit
        random = k % RANDOM_EVERY == 0
        if random:  # the clock field goes where the first packet's payload would begin
            base = k * FRAME_TICKS & (1 << 33) - 1
            pes = bytes([7, 0x50]) + (base << 15 | 0x7E00).to_bytes(6, "big") + pes
        many = -(-len(pes) // (PACKET - 4))
        fill = many * (PACKET - 4) - len(pes)
        packets = np.empty((many, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1], packets[:, 2] = DATA_PID >> 8, DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (np.arange(many) + counter) & 15
        if random:
            packets[0, 3] |= 0x20
        counter += many
        if many == 1 and random:  # one adaptation field holds clock and filling
            pes, fill = bytes([7 + fill]) + pes[1:8] + b"\xff" * fill + pes[8:], 0
        body = packets[:, 4:].reshape(-1)
        last = (many - 1) * (PACKET - 4)
        whole = np.frombuffer(pes, np.uint8)
        body = np.empty(many * (PACKET - 4), np.uint8)
        body[:last] = whole[:last]
        if fill:
            packets[-1, 3] |= 0x20
            body[last] = fill - 1
            body[last + 1 : last + fill] = 255
            if fill > 1:
                body[last + 1] = 0
        body[last + fill :] = whole[last:]
        packets[:, 4:] = body.reshape(many, PACKET - 4)
        out.append(packets.tobytes())
    return b"".join(out)


def _read_section(packet: bytes, start: int, table: int) -> bytes:
    start += 1 + packet[start]
    size = int.from_bytes(packet[start + 1 : start + 3], "big") & 0xFFF
    section = packet[start : start + 3 + size]
    if section[0] != table or len(section) != 3 + size or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("a program table is damaged")
    return section[8:-4]


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _pids(packets: np.ndarray) -> np.ndarray:
    return (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]


def _repeated(packets: np.ndarray) -> np.ndarray:
    """Packets with a payload whose counter and bytes are those of the packet before them of their stream."""
    out = np.zeros(len(packets), bool)
    carries = np.flatnonzero(packets[:, 3] & 0x10)
    order = carries[np.argsort(_pids(packets)[carries], kind="stable")]
    if len(order) > 1:
        same = (packets[order[1:], 1:4] == packets[order[:-1], 1:4]).all(axis=1)  # the counter too, so few are compared whole
        at = np.flatnonzero(same)
        out[order[1:][at]] = (packets[order[1:][at]] == packets[order[:-1][at]]).all(axis=1)
    return out


def demux(stream: bytes) -> dict:
    """What a stream holds: programs, elementary streams, continuity errors, payload, and for each PES packet its
    timestamp, its offset in the payload and whether decoding can begin there. Program 0 of a program table names
    the network's table and is no program; a packet that repeats the one before it of its stream, as the format
    allows once, counts once. Raises ValueError on a stream that isn't whole packets, has damaged tables or none, or
    has a PES packet of the wrong length."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a sync byte is missing")
    packets = packets[~_repeated(packets)]
    pid = _pids(packets)
    starts = (packets[:, 1] & 0x40) > 0
    adapted, carries, counter = (packets[:, 3] & 0x20) > 0, (packets[:, 3] & 0x10) > 0, packets[:, 3] & 15
    begin = np.where(adapted, 5 + packets[:, 4].astype(np.int32), 4)
    random = adapted & (packets[:, 4] > 0) & ((packets[:, 5] & 0x40) > 0)

    programs, streams = {}, {}
    for i in np.flatnonzero((pid == PAT_PID) & starts):
        body = _read_section(packets[i].tobytes(), int(begin[i]), 0x00)
        programs |= {int.from_bytes(body[k : k + 2], "big"): int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(body), 4)}
    programs.pop(0, None)
    for number, own in programs.items():
        for i in np.flatnonzero((pid == own) & starts):
            body = _read_section(packets[i].tobytes(), int(begin[i]), 0x02)
            k = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while k < len(body):
                streams[int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF] = (number, body[k])
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0xFFF)
    if not streams:
        raise ValueError("no program table")

    errors = 0
    for own in (PAT_PID, *programs.values(), *streams):
        seen = counter[(pid == own) & carries].astype(np.int32)
        errors += int(((np.diff(seen) - 1) % 16 != 0).sum())

    units, pts, offsets, access = [], [], [], []
    at = 0
    for own in streams:
        held = np.flatnonzero((pid == own) & carries)
        first = starts[held]
        if len(held) and not first[0]:
            raise ValueError("a PES packet has no beginning")
        data = packets[held][np.arange(PACKET) >= begin[held, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - begin[held])])
        marks = [*ends[:-1][first].tolist(), int(ends[-1])]
        for a, b, here in zip(marks[:-1], marks[1:], random[held][first].tolist(), strict=True):
            size = int.from_bytes(data[a + 4 : a + 6], "big")
            if data[a : a + 3] != b"\x00\x00\x01" or size != b - a - 6:
                raise ValueError("a PES packet is damaged")
            body = data[a + 9 + data[a + 8] : b]
            units.append(body)
            pts.append(_ticks(data[a + 9 : a + 14]) if data[a + 7] & 0x80 else None)
            offsets.append(at)
            access.append(here)
            at += len(body)
    return {"programs": programs, "streams": streams, "packets": len(packets), "continuity_errors": errors, "payload": b"".join(units), "pts": pts, "offsets": offsets, "random_access": access}


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """Filled up with bytes 255 to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\xff")


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a transport stream. Null counts as empty (one unit of bytes
    255); equal texts give equal streams; other columns aren't read, rows aren't joined or grouped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for a in range(0, len(texts), 256):
                some = [x or b"" for x in texts.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, 256), pa.array(map(len, some), pa.int64()), pa.array([mux(padded(x)) for x in some], pa.binary())], names=["doc_id", "n_bytes", "media"])

    own = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    return own.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _demuxed(stream: bytes | None) -> dict:
    """demux()'s facts with the numbers of programs and streams, or what is wrong with the stream."""
    try:
        out = demux(stream or b"")
    except (ValueError, IndexError) as e:  # IndexError: a length that points out of its packet
        return {"error": str(e)}
    return out | {"n_programs": len(out["programs"]), "n_streams": len(out["streams"])}


def load(stored: DataFrame) -> DataFrame:
    """store()'s rows with what their streams hold: payload, n_programs, n_streams, n_packets, continuity_errors,
    and for each access unit its timestamp, payload offset and whether it is a random-access point. A damaged stream
    has an error, and nulls for the rest; error is null for whole ones."""
    schema = "doc_id long, n_bytes long, media binary, payload binary, n_programs int, n_streams int, n_packets long, continuity_errors long, pts array<long>, unit_offsets array<long>, random_access array<boolean>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [_demuxed(x.as_py()) for x in part["media"]]
                of = lambda key, kind, found=found: pa.array([x.get(key) for x in found], kind)
                long, many = pa.int64(), pa.list_(pa.int64())
                columns = [of("payload", pa.binary()), of("n_programs", pa.int32()), of("n_streams", pa.int32()), of("packets", long), of("continuity_errors", long), of("pts", many), of("offsets", many), of("random_access", pa.list_(pa.bool_())), of("error", pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
