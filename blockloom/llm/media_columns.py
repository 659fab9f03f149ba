"""Media columns: MPEG transport streams.

store_media() puts a payload into a transport stream of 188-byte packets: program association and
program map tables before every random-access point, and the payload as private elementary packets
with presentation timestamps, clock references and random-access indicators. read_media() reads such
bytes back: it parses the program tables (with their checksums) to find the elementary stream,
checks every continuity counter (packets that are legally sent twice and announced breaks are no errors), reassembles the elementary packets, and returns their timestamps
and random-access points.

Defined results: null text is empty text; the payload of empty text is 64 zero bytes; equal payloads
give equal bytes; bytes that aren't a transport stream raise ValueError in demux(), and read_media()
reports them in `error` with the other fields null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.shared import bounded_batches, pick

PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE_STREAM, PRIVATE_TYPE = 0, 0x1000, 0x100, 1, 0xBD, 0x06
#: Bytes of payload in an access unit, access units from one random-access point to the next, and
#: ticks of the 90 kHz clock from one access unit to the next.
UNIT, GROUP, TICKS = 16384, 8, 3600
PES_HEADER = 14
ALIGN = 64


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program tables (polynomial 0x04C11DB7, no reflection)."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0"
    return (s := head + body) + section_crc(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, bytes([STUFFING])), np.uint8)


TABLES = np.stack([
    _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")),
])


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds the payload."""
    parts, cc, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        key, pts = k % GROUP == 0, k * TICKS % (1 << 33)
        if key:
            pair = TABLES.copy()
            pair[:, 3] |= tables % 16
            tables += 1
            parts.append(pair.tobytes())
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + data
        field_of = bytes([0x10 | 0x40 * key]) + (pts << 15 | 0x7E00).to_bytes(6, "big")
        first = PACKET - 4 - 1 - len(field_of)
        n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
        p = np.full((n, PACKET), STUFFING, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        p[:, 3] = 0x10 | (cc + np.arange(n)) % 16
        cc = (cc + n) % 16
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        raw = np.frombuffer(pes, np.uint8)
        spare = max(0, first - len(pes))  # of a unit that ends in its first packet
        p[0, 4] = len(field_of) + spare
        p[0, 5 : 5 + len(field_of)] = np.frombuffer(field_of, np.uint8)
        p[0, 5 + len(field_of) + spare :] = raw[: first - spare]
        if n > 1:
            p[1 : n - 1, 4:] = raw[first : first + (n - 2) * (PACKET - 4)].reshape(n - 2, PACKET - 4)
            tail = raw[first + (n - 2) * (PACKET - 4) :]
            if (gap := PACKET - 4 - len(tail)) > 0:
                p[n - 1, 3] |= 0x20
                p[n - 1, 4] = gap - 1
                if gap > 1:
                    p[n - 1, 5] = 0
            p[n - 1, 4 + gap :] = tail
        parts.append(p.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes
    pid: int
    packets: int
    continuity_errors: int
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers


def _read_section(packet: np.ndarray, start: int, table: int) -> bytes:
    data = packet.tobytes()
    at = start + 1 + data[start]
    size = 3 + (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF)
    body = data[at : at + size]
    if body[:1] != bytes([table]) or at + size > PACKET or section_crc(body):
        raise ValueError("a program table is broken")
    return body[8:-4]


def continuity(p: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """(errors, which rows repeat) of the packets of one id that have a payload. A counter goes up by one. A packet that says that
    it breaks the count is no error, and neither is one that repeats the packet before it once, but for its clock reference."""
    step = np.diff(p[rows, 3].astype(np.int32) & 15) % 16
    field_ = (p[rows, 3] & 0x20 != 0) & (p[rows, 4] > 0)
    flags = np.where(field_, p[rows, 5], 0)
    again = np.zeros(len(rows), bool)
    for k in (np.flatnonzero(step == 0) + 1).tolist():
        a, b = p[rows[k - 1]].copy(), p[rows[k]].copy()
        if flags[k] & 0x10 and flags[k - 1] & 0x10:
            a[6:12] = b[6:12] = 0
        again[k] = not again[k - 1] and bool((a == b).all())
    return int(((step != 1) & ~again[1:] & (flags[1:] & 0x80 == 0)).sum()), again


def demux(media: bytes) -> Stream:
    """Reads the first program's first elementary stream. Packets sent twice count once."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise ValueError("a packet lacks its sync byte")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    start = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    begins = (p[:, 1] & 0x40) != 0

    def section(of: int, table: int) -> bytes:
        found = np.flatnonzero((pid == of) & begins & ((control & 1) != 0))
        if not len(found):
            raise ValueError(f"no program table on {of}")
        return _read_section(p[found[0]], int(start[found[0]]), table)

    programs = section(PAT_PID, 0)
    entries = [(int.from_bytes(programs[i : i + 2], "big"), int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(programs), 4)]
    program_map = section(next(at for number, at in entries if number), 2)
    at = 4 + (int.from_bytes(program_map[2:4], "big") & 0xFFF)
    stream = int.from_bytes(program_map[at + 1 : at + 3], "big") & 0x1FFF

    errors, own = 0, np.zeros(0, int)
    for of in {x for _, x in entries} | {PAT_PID, stream}:
        rows = np.flatnonzero((pid == of) & ((control & 1) != 0))
        wrong, again = continuity(p, rows)
        errors += wrong
        if of == stream:
            own = rows[~again]
    e, skip, unit = p[own], start[own].copy(), begins[own]
    heads = np.flatnonzero(unit)
    if not len(heads):
        raise ValueError("no elementary packet")
    stamps, points = [], []
    for k in heads.tolist():
        head = e[k, skip[k] :].tobytes()
        if head[:3] != b"\0\0\1" or len(head) < PES_HEADER:
            raise ValueError("an elementary packet lacks its start code")
        if head[7] & 0x80:
            a, b, c, d, f = head[9:14]
            stamps.append((a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | f >> 1)
        if control[own[k]] & 2 and e[k, 4] and e[k, 5] & 0x40:
            points.append(int(own[k]))
        skip[k] += 9 + head[8]
    keep = np.arange(PACKET)[None, :] >= skip[:, None]
    keep[: heads[0]] = False
    return Stream(e[keep].tobytes(), stream, len(p), errors, stamps, points)


def padded(text: bytes) -> bytes:
    return text.ljust(max(ALIGN, -(-len(text) // ALIGN) * ALIGN), b"\0")


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pid int, packets long, continuity_errors long, timestamps array<long>, random_access array<long>, error string"
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("pid", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("error", pa.string())])
ROWS = 256


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's transport stream as a binary column."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                media = pa.array([mux(padded(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, STORED)


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: digests of payload and media, timestamps, random-access points."""
    bounded_batches(stored.sparkSession)

    def row(name: int | None, size: int | None, media: bytes | None) -> dict:
        out = {"doc_id": name, "n_bytes": size, "media_bytes": len(media or b""), "media_sha256": hashlib.sha256(media or b"").hexdigest()}
        try:
            s = demux(media or b"")
        except (ValueError, IndexError, StopIteration) as e:
            return out | {"error": str(e) or type(e).__name__}
        return out | {"payload_bytes": len(s.payload), "payload_sha256": hashlib.sha256(s.payload).hexdigest(), "tail_crc32": zlib.crc32(s.payload[-64:]), "pid": s.pid, "packets": s.packets, "continuity_errors": s.continuity_errors, "timestamps": s.timestamps, "random_access": s.random_access}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(a.as_py(), b.as_py(), c.as_py()) for a, b, c in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return pick(stored, "doc_id", "n_bytes", "media").mapInArrow(run, READ)


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in {
        "pid": F.col("pid"), "packets": F.col("packets"), "continuity_errors": F.col("continuity_errors"), "units": F.size("timestamps"),
        "first_pts": F.element_at("timestamps", 1), "last_pts": F.element_at("timestamps", -1), "random_access": F.array_join(F.col("random_access").cast("array<string>"), ","),
    }.items()])
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
