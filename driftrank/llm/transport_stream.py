"""Media columns: MPEG transport streams.

``multiplex`` wraps a payload column into a transport stream (program association and program map
tables, one elementary stream of private data, PES packets with presentation times, an adaptation
field with clock reference at every random-access point). ``demultiplex`` reads any such stream back:
it follows the program tables (checking their CRC), checks continuity counters, drops duplicate
packets, reassembles the PES packets of the first elementary stream, and stores time stamps with the
random-access points.

Both are narrow maps over Arrow batches of a few MB of media, so memory is bounded by the longest text
and nothing is shuffled. Defined results: a null payload is an empty one and gives a stream with tables
and no units; a null or empty stream gives empty data and zero counts; bytes outside packets, packets
with errors, lost packets and broken tables are counted, never raised; a unit that a gap cuts keeps the
bytes that came before the gap; of a stream with several programs or elementary streams the first is read; a payload of
any length is one stream; equal rows give equal streams; empty tables give empty tables. Columns named like the outputs
are replaced, others pass through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm.common import map_column, table, utf8

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_PES_TYPE, PRIVATE_STREAM_1 = 0x06, 0xBD
CRC_POLYNOMIAL = 0x04C11DB7

PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Bytes of payload in an access unit, units from one random-access point to the next, clock ticks (90 kHz) of a unit.
UNIT, RANDOM_ACCESS_EVERY, TICKS = 3840, 8, 3600
FIRST_PTS = 90_000
TABLES_EVERY = 64  # units
READ = {"data": "binary", "timestamps": "array<bigint>", "random_access": "array<int>", "cc_errors": "int", "lost_bytes": "bigint", "feature": "string"}


@lru_cache(1)
def _crc_table() -> list[int]:
    found = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (CRC_POLYNOMIAL if crc & 1 << 31 else 0)) & 0xFFFFFFFF
        found.append(crc)
    return found


@lru_cache(4096)
def section_crc(section: bytes) -> int:
    """The MPEG-2 CRC-32; 0 over a section that ends with its own."""
    steps, crc = _crc_table(), 0xFFFFFFFF
    for byte in section:
        crc = (crc << 8 & 0xFFFFFFFF) ^ steps[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(1)
def _table_payloads() -> tuple[tuple[int, bytes], ...]:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_PES_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return tuple((pid, (b"\x00" + x).ljust(184, b"\xff")) for pid, x in ((PAT_PID, pat), (PMT_PID, pmt)))


def _stamp(prefix: int, ticks: int) -> bytes:
    """A 33-bit time in the five bytes of a PES header."""
    ticks &= (1 << 33) - 1
    return bytes([prefix << 4 | ticks >> 29 & 0x0E | 1]) + ((ticks >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + (ticks << 1 & 0xFFFE | 1).to_bytes(2, "big")


def _clock(ticks: int) -> bytes:
    """A program clock reference whose extension is 0."""
    return ((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    out: list[bytes] = []
    counters = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}

    def packet(pid: int, start: bool, adaptation: bytes, body: bytes) -> None:
        control = (0x20 if adaptation else 0) | (0x10 if body else 0)
        out.append(bytes([SYNC, start << 6 | pid >> 8, pid & 0xFF, control | counters[pid]]) + adaptation + body)
        counters[pid] = counters[pid] + bool(body) & 15

    for unit in range(max(1, -(-len(payload) // UNIT))):
        if unit % TABLES_EVERY == 0:
            for pid, body in _table_payloads():
                packet(pid, True, b"", body)
        chunk = payload[unit * UNIT : (unit + 1) * UNIT]
        if not chunk:
            break
        ticks = FIRST_PTS + unit * TICKS
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(chunk) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + chunk
        at = 0
        while at < len(pes):
            fields = b"\x50" + _clock(ticks) if at == 0 and unit % RANDOM_ACCESS_EVERY == 0 else b""
            room = 184 - (len(fields) + 1 if fields else 0)
            body = pes[at : at + room]
            if spare := room - len(body):  # the adaptation field grows to fill the packet
                if fields or spare > 1:
                    fields = (fields or b"\x00").ljust(len(fields) + spare - (0 if fields else 1), b"\xff")
                adaptation = bytes([len(fields)]) + fields
            else:
                adaptation = bytes([len(fields)]) + fields if fields else b""
            packet(DATA_PID, at == 0, adaptation, body)
            at += len(body)
    return b"".join(out)


def _packets(stream: bytes) -> tuple[np.ndarray, int]:
    """The packets of a stream, by rows, and the bytes that belong to none."""
    if len(stream) % PACKET == 0:
        rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] == SYNC).all():
            return rows, 0
    found, at, end = [], 0, len(stream)
    while at + PACKET <= end:
        if stream[at] == SYNC and (at + PACKET == end or stream[at + PACKET] == SYNC or found and found[-1] + PACKET == at):
            found.append(at)
            at += PACKET
        else:
            at = stream.find(SYNC, at + 1)
            if at < 0:
                break
    rows = np.frombuffer(b"".join(stream[x : x + PACKET] for x in found), np.uint8).reshape(-1, PACKET)
    return rows, end - len(found) * PACKET


def _sections(bodies: list[tuple[bool, bytes]], table_id: int) -> list[bytes]:
    """The whole sections of a table with a right CRC, without head and CRC."""
    found, buffer, open_ = [], b"", False
    for start, body in bodies:
        if start and body:
            pointer = body[0]
            whole = [buffer + body[1 : 1 + pointer]] if open_ else []
            buffer, open_ = body[1 + pointer :], True
        else:
            whole, buffer = [], buffer + body
        for data in [*whole, buffer]:
            while len(data) >= 3 and data[0] != 0xFF:
                size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
                if len(data) < size:
                    break
                if data[0] == table_id and size >= 12 and section_crc(data[:size]) == 0:
                    found.append(data[8 : size - 4])
                data = data[size:]
                buffer = data
    return found


def _time(field: bytes) -> int:
    return (field[0] >> 1 & 7) << 30 | (int.from_bytes(field[1:3], "big") >> 1) << 15 | int.from_bytes(field[3:5], "big") >> 1


def read_stream(stream: bytes) -> dict:
    """Data, time stamps, random-access points and defects of the first elementary stream of a program."""
    rows, lost = _packets(stream or b"")
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    good = (rows[:, 1] & 0x80) == 0
    begins = (rows[:, 1] & 0x40) != 0
    has_fields, has_body = (rows[:, 3] & 0x20) != 0, (rows[:, 3] & 0x10) != 0
    counter = rows[:, 3] & 0x0F
    start = np.where(has_fields, 5 + rows[:, 4].astype(np.int32), 4)
    entry = has_fields & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) != 0)
    broken = has_fields & (rows[:, 4] > 0) & ((rows[:, 5] & 0x80) != 0)
    errors = 0

    def bodies(pid: int) -> list[tuple[bool, bytes, bool, bool]]:
        """(begins a unit, bytes, random access, bytes were lost before it)"""
        nonlocal errors
        found, last, before = [], -1, b""
        for k in np.flatnonzero((pids == pid) & good & has_body):
            body, count = rows[k, start[k] :].tobytes(), int(counter[k])
            if last == count and body == before:
                continue  # a repeated packet
            gap = last >= 0 and count != (last + 1) & 15 and not broken[k]
            errors += gap
            found.append((bool(begins[k]), body, bool(entry[k]), gap))
            last, before = count, body
        return found

    programs = [(int.from_bytes(s[i : i + 2], "big"), int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF) for s in _sections([x[:2] for x in bodies(PAT_PID)], 0x00) for i in range(0, len(s), 4)]
    pmt = next((pid for number, pid in programs if number), None)
    streams = []
    for s in _sections([x[:2] for x in bodies(pmt)], 0x02)[:1] if pmt is not None else []:
        at = 4 + (int.from_bytes(s[2:4], "big") & 0x0FFF)
        while at + 5 <= len(s):
            streams.append((s[at], int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF))
            at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)

    units: list[tuple[list[bytes], bool]] = []
    cut = True
    for begin, body, point, gap in bodies(streams[0][1]) if streams else []:
        cut = cut and not begin or gap and not begin
        if begin:
            units.append(([body], point))
        elif units and not cut:
            units[-1][0].append(body)
    data, stamps, points = [], [], []
    for parts, point in units:
        pes = b"".join(parts)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            continue
        size, body = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        if point:
            points.append(len(stamps))
        stamps.append(_time(pes[9:14]) if pes[7] & 0x80 and len(pes) >= 14 else -1)
        data.append(pes[body : 6 + size] if size else pes[body:])
    kind = f"type={streams[0][0]};pid={streams[0][1]}" if streams else "type=none;pid=none"
    feature = f"{kind};packets={len(rows)};units={len(stamps)};points={len(points)};pts={stamps[0] if stamps else ''}-{stamps[-1] if stamps else ''};cc_errors={errors};lost={lost}"
    return {"data": b"".join(data), "timestamps": stamps, "random_access": points, "cc_errors": errors, "lost_bytes": lost, "feature": feature}


def multiplex(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``df`` with the payload column given up for the stream that holds it."""
    return map_column(df, payload, {media: "binary"}, lambda values: [pa.array([write_stream(x or b"") for x in values], pa.binary())])


def demultiplex(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with the columns of READ; the media column stays."""
    kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.string()]

    def run(values: list) -> list[pa.Array]:
        rows = [read_stream(x) for x in values]
        return [pa.array([r[name] for r in rows], kind) for name, kind in zip(READ, kinds, strict=True)]

    return map_column(df, media, READ, run, keep=True)


def padded(data, to: int = 192):
    """Column expression: bytes followed by bytes 32 up to a positive multiple of ``to``."""
    size = F.greatest(F.lit(to), F.ceil(F.length(data) / to) * to).cast("int")
    return F.call_function("rpad", data, size, F.lit(b" "))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", utf8(F.col("text")).alias("raw"))
    docs = docs.select("doc_id", F.length("raw").cast("long").alias("n_bytes"), padded(F.col("raw")).alias("payload"))
    read = demultiplex(multiplex(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("data").cast("long").alias("payload_bytes"),
        F.sha2("data", 256).alias("payload_sha256"),
        F.crc32(F.substring("data", -16, 16)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "timestamps",
        "random_access",
    )
