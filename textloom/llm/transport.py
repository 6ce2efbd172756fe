"""Media columns: MPEG transport streams.

`mux` stores a payload as a private-data elementary stream in a single-program transport stream of
188-byte packets. `parse` reads any stream of that kind: it checks sync bytes, parses the program
association and map tables (their CRC included), checks continuity counters, reassembles the elementary
packets, and keeps time stamps and random-access points.

Defined results: a null or empty text is stored as one unit of spaces; a null media value parses to nulls
with no programs; repeated rows give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, each_batch, raw_text, spread, table

#: Fixed by the format: packet size, sync byte, and table identifiers.
PACKET, SYNC = 188, 0x47
PAT_TABLE, PMT_TABLE = 0x00, 0x02
#: This writer's choices: payload unit, identifiers, bytes of an access unit, clock ticks of one, units between random-access points.
UNIT = 192
PMT_PID, ES_PID, PRIVATE_STREAM, PRIVATE_TYPE = 0x100, 0x101, 0xBD, 0x06
ACCESS_UNIT, TICKS, GROUP = 30 * UNIT, 3600, 8
PES_HEADER = 14


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def _crc_steps() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
        out.append(c)
    return out


CRC_STEPS = _crc_steps()


def crc32_mpeg(b: bytes) -> int:
    c = 0xFFFFFFFF
    for x in b:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC_STEPS[c >> 24 ^ x]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    """A long-form table section with its CRC."""
    head = bytes([table_id]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, table_id: int, number: int, body: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section(table_id, number, body)).ljust(PACKET, b"\xff"), np.uint8)


TABLES = np.stack(
    [
        table_packet(0, PAT_TABLE, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")),
        table_packet(PMT_PID, PMT_TABLE, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"),
    ]
)


def mux(payload: bytes) -> bytes:
    """The payload as one transport stream; its length is free, the query's is a multiple of UNIT."""
    data = np.frombuffer(payload, np.uint8)
    units = max(1, -(-len(data) // ACCESS_UNIT))
    u = np.arange(units)
    size = np.minimum(ACCESS_UNIT, len(data) - u * ACCESS_UNIT)
    # The first packet of a unit holds an adaptation field of 8 bytes (flags and clock) and the packet header.
    first_room = PACKET - 4 - 8 - PES_HEADER
    per = 1 + -(-np.maximum(0, size - first_room) // (PACKET - 4))
    n = int(per.sum())
    first = np.cumsum(per) - per
    last = first + per - 1
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    out[first, 1] |= 0x40
    field = np.zeros(n, np.int64)
    field[first] = 8
    head = np.zeros(n, np.int64)
    head[first] = PES_HEADER
    room = PACKET - 4 - field - head
    body = room.copy()
    body[last] = size - (np.where(per > 1, first_room + (per - 2) * (PACKET - 4), 0))
    field += room - body
    out[:, 3] = 0x10 | (field > 0) * np.uint8(0x20) | (np.arange(n) & 15).astype(np.uint8)
    has = field > 0
    out[has, 4] = field[has] - 1
    long = field > 1
    out[long, 5] = 0
    pts = (u + 1) * TICKS
    random = u % GROUP == 0
    out[first, 5] = 0x10 | random * np.uint8(0x40)
    clock = pts - TICKS
    for i, shift in enumerate((25, 17, 9, 1)):
        out[first, 6 + i] = clock >> shift & 255
    out[first, 10] = (clock & 1) << 7 | 0x7E
    out[first, 11] = 0
    at = 4 + field[first]
    length = size + PES_HEADER - 6
    for i, v in enumerate(
        [0, 0, 1, PRIVATE_STREAM, length >> 8, length & 255, 0x84, 0x80, 5, 0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1]
    ):
        out[first, at + i] = v
    out.ravel()[spread(np.arange(n) * PACKET + 4 + field + head, body)] = data
    return np.concatenate([TABLES, out]).tobytes()


def read_section(packet: np.ndarray, table_id: int) -> bytes | None:
    """The body of a table section in one packet; None if it is malformed or its CRC is wrong."""
    b = packet.tobytes()
    at = 4 + (1 + b[4] if b[3] & 0x20 else 0)
    if at >= PACKET:
        return None
    at += 1 + b[at]
    if at + 3 > PACKET or b[at] != table_id:
        return None
    end = at + 3 + (int.from_bytes(b[at + 1 : at + 3], "big") & 0xFFF)
    return b[at + 8 : end - 4] if end <= PACKET and end - at >= 12 and crc32_mpeg(b[at:end]) == 0 else None


def parse(media: bytes) -> dict:
    """Tables, faults, elementary payload, time stamps and random-access points of one stream.

    Faults don't stop the parse: bad_sync counts packets without the sync byte (they are skipped), bad_tables
    tables whose CRC fails, discontinuities counter steps other than +1 within an identifier.
    """
    whole = len(media) // PACKET
    p = np.frombuffer(media, np.uint8, whole * PACKET).reshape(-1, PACKET)
    good = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)
    out = {"packets": whole, "bad_sync": int(whole - good.sum()), "bad_tables": 0, "discontinuities": 0, "programs": [], "streams": [], "payload": b"", "pts": [], "random_access": []}
    p = p if good.all() else p[good]
    pid = (p[:, 1] & 31).astype(np.int32) << 8 | p[:, 2]
    start = p[:, 1] & 0x40 > 0
    for k in np.flatnonzero((pid == 0) & start).tolist():
        body = read_section(p[k], PAT_TABLE)
        out["bad_tables"] += body is None
        for i in range(0, len(body or b""), 4):
            got = {"program": int.from_bytes(body[i : i + 2], "big"), "pid": int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF}
            if got["program"] and got not in out["programs"]:
                out["programs"].append(got)
    for program in out["programs"]:
        for k in np.flatnonzero((pid == program["pid"]) & start).tolist():
            body = read_section(p[k], PMT_TABLE)
            out["bad_tables"] += body is None
            i = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF) if body else 0
            while body and i + 5 <= len(body):
                got = {"pid": int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF, "type": body[i]}
                if got not in out["streams"]:
                    out["streams"].append(got)
                i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0xFFF)
    has = p[:, 3] & 0x10 > 0
    for stream in out["streams"]:
        own = np.flatnonzero((pid == stream["pid"]) & has)
        step = np.diff((p[own, 3] & 15).astype(np.int32)) & 15
        out["discontinuities"] += int((step != 1).sum())
    if out["streams"]:
        own = np.flatnonzero((pid == out["streams"][0]["pid"]) & has)
        q = p if len(own) == len(p) else p[own]
        begins = start[own]
        field = q[:, 3] & 0x20 > 0
        at = 4 + np.where(field, 1 + q[:, 4].astype(np.int64), 0)
        rows = np.flatnonzero(begins & (at + 9 <= PACKET))
        base = at[rows]
        pes = (q[rows, base] == 0) & (q[rows, base + 1] == 0) & (q[rows, base + 2] == 1)
        rows, base = rows[pes], base[pes]
        at[rows] += 9 + q[rows, base + 8].astype(np.int64)
        out["random_access"] = np.flatnonzero(field[rows] & (q[rows, 4] > 0) & (q[rows, 5] & 0x40 > 0)).tolist()
        stamped = (q[rows, base + 7] & 0x80 > 0) & (base + 14 <= PACKET)
        r, s = rows[stamped], base[stamped]
        b = [q[r, s + 9 + i].astype(np.int64) for i in range(5)]
        out["pts"] = ((b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1).tolist()
        at = np.minimum(at, PACKET)
        first = int(rows[0]) if len(rows) else len(q)
        out["payload"] = q.ravel()[spread((np.arange(len(q)) * PACKET + at)[first:], (PACKET - at)[first:])].tobytes()
    return out


def to_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media binary): the UTF-8 text, padded with spaces to whole units, as a transport stream."""
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            data, offsets = raw_text(b.column(1))
            raw, at = data.tobytes(), offsets.tolist()
            media = [mux(padded(raw[i:j])) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], schema=schema)

    return (
        bounded(df)
        .select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
        .mapInArrow(run, "k long, n_bytes long, media binary")
        .withColumnRenamed("k", key)
    )


PARSED = "packets int, bad_sync int, bad_tables int, discontinuities int, programs array<struct<program:int,pid:int>>, streams array<struct<pid:int,type:int>>, payload binary, pts array<long>, random_access array<int>"


def parse_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the media column, and PARSED: what its stored bytes hold."""
    pairs = lambda *names: pa.list_(pa.struct([(n, pa.int32()) for n in names]))
    parsed = [
        ("packets", pa.int32()), ("bad_sync", pa.int32()), ("bad_tables", pa.int32()), ("discontinuities", pa.int32()),
        ("programs", pairs("program", "pid")), ("streams", pairs("pid", "type")), ("payload", pa.binary()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches):
            rows = [parse(x) if x is not None else {} for x in b.column(len(keep)).to_pylist()]
            arrays = [pa.array([r.get(n) for r in rows], t) for n, t in parsed]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *(n for n, _ in parsed)])

    src = bounded(df).select(*keep, F.col(media).alias("media"))
    return src.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in src.dtypes) + ", " + PARSED)


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(parse_media(to_media(table(spark, sf_dir, "documents")), keep=("doc_id", "n_bytes")))


def digest(parsed: DataFrame) -> DataFrame:
    feature = F.format_string(
        "packets=%d;bad_sync=%d;bad_tables=%d;discontinuities=%d;programs=%d;streams=%d;units=%d;first_pts=%d;last_pts=%d;random_access=%s",
        "packets", "bad_sync", "bad_tables", "discontinuities", F.size("programs"), F.size("streams"), F.size("pts"),
        F.get("pts", F.lit(0)), F.element_at("pts", -1), F.concat_ws(",", F.col("random_access").cast("array<string>")),
    )
    return parsed.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
