import pytest
from stagelens.llm import transport as T


@pytest.mark.parametrize("size", [1, 150, 155, 160, 161, 162, 163, 170, 176, 183, 184, 185, 576, 577, T.ACCESS_UNIT - 1, T.ACCESS_UNIT, T.ACCESS_UNIT + 1, 40 * T.ACCESS_UNIT])
def test_round_trip(size):
    payload = bytes(i * 7 % 256 for i in range(size))
    stream = T.mux(payload)
    got = T.demux(stream)
    assert got["payload"] == payload and got["continuity_errors"] == 0 and len(stream) % T.PACKET == 0
    assert got["programs"] == {1: T.PMT_PID} and got["streams"] == {T.DATA_PID: (1, T.STREAM_TYPE)}
    assert got["pts"] == [i * T.FRAME_TICKS for i in range(len(got["pts"]))] and got["random_access"] == [i % T.RANDOM_EVERY == 0 for i in range(len(got["pts"]))]
    assert got["offsets"] == list(range(0, size, T.ACCESS_UNIT))


def test_every_short_length():
    for size in range(1, 400):
        payload = bytes(range(256)) * 2
        assert T.demux(T.mux(payload[:size]))["payload"] == payload[:size]


def test_crc_of_the_format():
    assert T.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damage():
    stream = T.mux(bytes(2000))
    with pytest.raises(ValueError, match="whole packets"):
        T.demux(stream[:-1])
    with pytest.raises(ValueError, match="sync"):
        T.demux(b"\x00" + stream[1:])
    with pytest.raises(ValueError, match="damaged"):
        T.demux(stream[:10] + b"\x55" + stream[11:])
    with pytest.raises(ValueError, match="no program"):
        T.demux(stream[2 * T.PACKET :])
    lost = stream[: 4 * T.PACKET] + stream[5 * T.PACKET :]
    with pytest.raises(ValueError, match="PES"):
        T.demux(lost)
    counter = bytearray(stream)
    counter[4 * T.PACKET + 3] ^= 0x05
    assert T.demux(bytes(counter))["continuity_errors"] == 2


def test_network_entry_and_repeated_packet():
    """A program table that names the network's table too; and a packet sent twice."""
    payload = bytes(range(256)) * 40
    stream = T.mux(payload)
    body = bytes([0, 0, 0x00, 0x10, 0x00, 1, 0xE0 | T.PMT_PID >> 8, T.PMT_PID & 0xFF])
    head = bytes([0, 0xB0, len(body) + 9, 0, 1, 0xC1, 0, 0]) + body
    table = bytes([0]) + head + T.crc32_mpeg(head).to_bytes(4, "big")
    pat = stream[:4] + table + b"\xff" * (T.PACKET - 4 - len(table))
    got = T.demux(pat + stream[T.PACKET :])
    assert got["programs"] == {1: T.PMT_PID} and got["payload"] == payload
    for k in (2, 3, 5):
        twice = stream[: (k + 1) * T.PACKET] + stream[k * T.PACKET :]
        got = T.demux(twice)
        assert got["payload"] == payload and got["continuity_errors"] == 0


def test_a_damaged_stream_is_a_row(spark):
    good = T.mux(b"x" * 576)
    df = spark.createDataFrame([(1, 3, bytearray(good)), (2, 3, bytearray(good[:-1])), (3, 3, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in T.load(df).collect()}
    assert got[1].error is None and bytes(got[1].payload) == b"x" * 576
    assert "whole packets" in got[2].error and got[2].payload is None and got[3].error


def test_rows_of_a_table(spark):
    df = spark.createDataFrame([(1, "é", "x"), (2, "é", "y"), (None, None, None), (3, "", "z")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in T.load(T.store(df)).collect()}
    assert got[1].media == got[2].media and bytes(got[1].payload) == T.padded("é".encode()) and got[1].n_bytes == 2
    assert bytes(got[None].payload) == bytes(got[3].payload) == b"\xff" * T.UNIT
    assert T.load(T.store(df.limit(0))).count() == 0
