import hashlib
import zlib

import pytest

from textloom.llm.transport import ACCESS_UNIT, PACKET, crc32_mpeg, digest, mux, padded, parse, parse_media, to_media

SIZES = [0, 1, 12, 158, 162, 163, 183, 184, 185, 192, 300, 346, 347, ACCESS_UNIT - 1, ACCESS_UNIT, ACCESS_UNIT + 1, 9 * ACCESS_UNIT + 77]


@pytest.mark.parametrize("n", SIZES)
def test_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    got = parse(mux(data))
    assert got["payload"] == data
    assert (got["bad_sync"], got["bad_tables"], got["discontinuities"]) == (0, 0, 0)
    assert got["programs"] == [{"program": 1, "pid": 256}] and got["streams"] == [{"pid": 257, "type": 6}]
    units = max(1, -(-n // ACCESS_UNIT))
    assert got["pts"] == [3600 * (i + 1) for i in range(units)] and got["random_access"] == list(range(0, units, 8))


def test_independent_walk():
    data = bytes(range(256)) * 60
    ts, out = mux(data), b""
    for i in range(0, len(ts), PACKET):
        p = ts[i : i + PACKET]
        assert p[0] == 0x47
        if ((p[1] & 31) << 8 | p[2]) == 257:
            at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
            out += p[at + 9 + p[at + 8] :] if p[1] & 0x40 else p[at:]
    assert out == data


def test_faults():
    ts = bytearray(mux(b"a" * 2000))
    del ts[3 * PACKET : 4 * PACKET]
    assert parse(bytes(ts))["discontinuities"] == 1
    ts[PACKET + 20] ^= 1
    assert parse(bytes(ts))["bad_tables"] == 1 and parse(bytes(ts))["streams"] == []
    ts[0] = 0
    assert parse(bytes(ts))["bad_sync"] == 1
    assert parse(b"")["payload"] == b""
    assert crc32_mpeg(b"123456789") == 0x0376E6E7


def test_query(spark):
    texts = ["", None, "é" * 96, "x" * 193, "x" * 193, "y" * 100_000]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in digest(parse_media(to_media(df), keep=("doc_id", "n_bytes"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = padded(raw)
        assert len(want) % 192 == 0 and len(want) > 0 and rows[i].n_bytes == len(raw) and rows[i].payload_bytes == len(want)
        assert rows[i].payload_sha256 == hashlib.sha256(want).hexdigest() and rows[i].tail_crc32 == zlib.crc32(want[-16:])
        assert rows[i].media_sha256 == hashlib.sha256(mux(want)).hexdigest() and rows[i].media_bytes == len(mux(want))
    assert rows[3].feature == rows[4].feature
    assert digest(parse_media(to_media(df.limit(0)), keep=("doc_id", "n_bytes"))).count() == 0
    assert parse_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).collect()[0].payload is None
