"""MPEG transport streams in a media column: multiplex, parse, check and reassemble.

``multiplex`` stores a payload without loss as a single-program stream: program tables with CRC, elementary packets
(private stream 1) with time stamps, a clock reference and a random-access mark where each begins. ``demultiplex`` reads
any stream of 188-byte packets: it resynchronises on lost sync bytes, parses the program association and map tables,
checks continuity counters, reassembles elementary packets, and stores time stamps with random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, table, text_slices, utf8

PACKET, SYNC, BLOCK = 188, 0x47, 64
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Payload bytes of an elementary packet, and 90 kHz ticks from one to the next.
UNIT, TICKS = 16384, 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables; zero over a table with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFF00) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _psi_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _psi_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _psi_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | t >> 29 & 14 | 1]) + ((t >> 14 & 0xFFFE | 1) << 16 | (t << 1 & 0xFFFE | 1)).to_bytes(4, "big")


def multiplex(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``; the same payload gives the same bytes."""
    out, counter = [_TABLES], 0
    lead = (0x4000 | DATA_PID).to_bytes(2, "big")
    more = bytes([SYNC]) + DATA_PID.to_bytes(2, "big")
    for k in range(0, max(len(payload), 1), UNIT):
        part, t = payload[k : k + UNIT], k // UNIT * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, t + TICKS & (1 << 33) - 1) + part
        # adaptation: random access, clock reference
        adapt = b"\x50" + ((t << 15) | 0x7E00).to_bytes(6, "big")
        take = min(len(pes), PACKET - 5 - len(adapt))
        adapt = adapt.ljust(PACKET - 5 - take, b"\xff")
        out.append(bytes([SYNC]) + lead + bytes([0x30 | counter, len(adapt)]) + adapt + pes[:take])
        counter = counter + 1 & 15
        size = len(pes)
        full = take + (size - take) // 184 * 184
        for at in range(take, full, 184):
            out.append(more + bytes((0x10 | counter,)) + pes[at : at + 184])
            counter = counter + 1 & 15
        if full < size:
            rest = pes[full:]
            room = 183 - len(rest)
            out.append(more + bytes((0x30 | counter, room)) + (b"\x00".ljust(room, b"\xff") if room else b"") + rest)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What one stream of bytes holds."""

    packets: int = 0
    lost_sync: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    crc_errors: int = 0
    scrambled: int = 0
    transport_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    #: (pid, pts, dts, clock, random access, bytes) for each elementary packet
    units: list[tuple[int, int | None, int | None, int | None, bool, bytes]] = field(default_factory=list)
    #: elementary packets whose declared length was not met, or whose header was broken
    damaged: int = 0

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join(u[5] for u in self.units if pid is None or u[0] == pid)


def _time(b: bytes) -> int:
    return (b[0] & 14) << 29 | b[1] << 22 | (b[2] & 254) << 14 | b[3] << 7 | b[4] >> 1


def _unit(found: Stream, pid: int, parts: list[bytes], access: bool, clock: int | None) -> None:
    pes = b"".join(parts)
    if pes[:3] != b"\x00\x00\x01" or len(pes) < 6:
        found.damaged += 1
        return
    length, kind, body, pts, dts = int.from_bytes(pes[4:6], "big"), pes[3], 6, None, None
    if kind not in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
        if len(pes) < 9 or len(pes) < 9 + pes[8]:
            found.damaged += 1
            return
        flags, body = pes[7] >> 6, 9 + pes[8]
        if flags & 2 and pes[8] >= 5:
            pts = _time(pes[9:14])
        if flags == 3 and pes[8] >= 10:
            dts = _time(pes[14:19])
    if length and length != len(pes) - 6:
        found.damaged += 1
        pes = pes[: 6 + length]
    found.units.append((pid, pts, dts, clock, access, pes[body:]))


def _tables(found: Stream, pid: int, data: bytes) -> None:
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        s, data = data[:size], data[size:]
        if len(s) < size or size < 12 or section_crc(s):
            found.crc_errors += 1
            return
        if pid == 0 and s[0] == 0:
            for k in range(8, size - 4, 4):
                if number := s[k] << 8 | s[k + 1]:
                    found.programs[number] = (s[k + 2] & 31) << 8 | s[k + 3]
        elif s[0] == 2:
            k = 12 + ((s[10] & 15) << 8 | s[11])
            while k + 5 <= size - 4:
                found.streams[(s[k + 1] & 31) << 8 | s[k + 2]] = s[k]
                k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])


def _complete(parts: list[bytes]) -> bool:
    data = b"".join(parts)
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if len(data) < size:
            return False
        data = data[size:]
    return not data or data[0] == 0xFF


def demultiplex(data: bytes | None) -> Stream:
    """Parse a stream. Null and empty streams, and bytes without sync, give an empty result; damage is counted, not raised."""
    found = Stream()
    data = data or b""
    at, end = 0, len(data)
    last: dict[int, tuple[int, bytes]] = {}
    open_units: dict[int, tuple[list[bytes], bool, int | None]] = {}
    sections: dict[int, list[bytes]] = {}
    while at + PACKET <= end:
        if data[at] != SYNC:
            found.lost_sync += 1
            at = data.find(b"\x47", at + 1)
            while at >= 0 and at + 2 * PACKET <= end and data[at + PACKET] != SYNC:
                at = data.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        p = at
        at += PACKET
        found.packets += 1
        b1, b3 = data[p + 1], data[p + 3]
        pid = (b1 & 31) << 8 | data[p + 2]
        if b1 & 0x80:
            found.transport_errors += 1
            continue
        if pid == 0x1FFF:
            continue
        body, access, clock, jump = p + 4, False, None, False
        if b3 & 0x20:
            size = data[body]
            if size > 183:
                found.transport_errors += 1
                continue
            if size:
                flags = data[body + 1]
                access, jump = bool(flags & 0x40), bool(flags & 0x80)
                if flags & 0x10 and size >= 7:
                    clock = int.from_bytes(data[body + 2 : body + 8], "big") >> 15
            body += 1 + size
        chunk = data[body:at] if b3 & 0x10 else b""
        if b3 & 0x10:
            now = b3 & 15
            if pid in last and not jump:
                before, same = last[pid]
                if now == before and chunk == same:
                    found.duplicates += 1
                    continue
                if now != before + 1 & 15:
                    found.continuity_errors += 1
            last[pid] = now, chunk
        if b3 & 0xC0:
            found.scrambled += 1
            continue
        if pid == 0 or pid in found.programs.values():
            if b1 & 0x40 and chunk:
                head = chunk[0]
                if pid in sections and head:
                    _tables(found, pid, b"".join(sections.pop(pid)) + chunk[1 : 1 + head])
                sections[pid] = [chunk[1 + head :]]
            elif pid in sections:
                sections[pid].append(chunk)
            if pid in sections and _complete(sections[pid]):
                _tables(found, pid, b"".join(sections.pop(pid)))
        elif pid in found.streams or not found.streams:
            if b1 & 0x40:
                if pid in open_units:
                    _unit(found, pid, *open_units.pop(pid))
                open_units[pid] = [chunk], access, clock
            elif pid in open_units:
                open_units[pid][0].append(chunk)
    for pid, unit in open_units.items():
        _unit(found, pid, *unit)
    return found


def summary(s: Stream) -> str:
    """The features of a stream as one line."""
    stamps = [u[1] for u in s.units if u[1] is not None]
    kinds = ",".join(f"{pid}:{kind}" for pid, kind in sorted(s.streams.items()))
    points = [u[1] for u in s.units if u[4]]
    return f"packets={s.packets};programs={','.join(f'{n}@{p}' for n, p in sorted(s.programs.items()))};streams={kinds};units={len(s.units)};pts={min(stamps, default='')}-{max(stamps, default='')};access={len(points)}@{points[0] if points and points[0] is not None else ''};cc={s.continuity_errors};dup={s.duplicates};crc={s.crc_errors};sync={s.lost_sync};damaged={s.damaged}"


_UNITS = "array<struct<pid:int,pts:long,dts:long,clock:long,random_access:boolean,bytes:int>>"


def parse_column(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """One row for each row of ``df``: its id, counts of packets and faults, programs, streams, the elementary packets with their times and random-access points, and the reassembled payload. A null column counts as an empty stream."""
    bound_batches(df.sparkSession)
    maps = pa.map_(pa.int32(), pa.int32())
    units = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("clock", pa.int64()), ("random_access", pa.bool_()), ("bytes", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in text_slices(b, "media", 8 << 20):
                got = [demultiplex(x) for x in piece.column("media").to_pylist()]
                count = lambda name: pa.array([getattr(s, name) for s in got], pa.int64())  # noqa: B023, E731
                names = ["packets", "lost_sync", "continuity_errors", "duplicates", "crc_errors", "scrambled", "transport_errors", "damaged"]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), *map(count, names), pa.array([list(s.programs.items()) for s in got], maps), pa.array([list(s.streams.items()) for s in got], maps), pa.array([[(*u[:5], len(u[5])) for u in s.units] for s in got], units), pa.array([s.payload() for s in got], pa.binary())],
                    names=["id", *names, "programs", "streams", "units", "payload"],
                )

    kind = dict(df.dtypes)[id_col]
    counts = ", ".join(f"{n} long" for n in ("packets", "lost_sync", "continuity_errors", "duplicates", "crc_errors", "scrambled", "transport_errors", "damaged"))
    return df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {kind}, {counts}, programs map<int,int>, streams map<int,int>, units {_UNITS}, payload binary").withColumnRenamed("id", id_col)


def multiplex_column(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, media): the UTF-8 of each text, zero bytes appended to a positive multiple of 64, as a transport stream."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in text_slices(b, "text", 8 << 20):
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([multiplex(padded(t)) for t in utf8(piece.column("text"))], pa.binary())], names=["id", "media"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        out = []
        for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
            media = multiplex(padded(text))
            stream = demultiplex(media)
            back = stream.payload(DATA_PID)
            out.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), summary(stream)))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` through a transport stream and back; null texts count as empty, null ids stay null."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
