"""Media columns: MPEG transport streams (ISO/IEC 13818-1) written and read back.

`mux` stores a payload as one program: a program association table, a program map table, and one elementary stream of
PES packets with presentation timestamps; the first PES packet of every `gop` is a random-access point with a program
clock reference. `demux` reads such and other streams: it puts table sections together across packets and checks their
CRCs, checks continuity counters, drops duplicate packets and packets marked as damaged, reassembles PES packets, and
lists timestamps, random-access points and clock references. What a lost packet touches is one PES packet: it is left
out and counted, the others are kept. `media_column` adds the stored bytes to documents, `read_media` turns stored bytes
into features.

Defined cases: null and empty texts are 64 zero bytes (the contract's padding); streams without whole packets, sync bytes
or a valid program give `error` and no payload; damaged ones give `error` and the payload of their whole PES packets;
equal texts give equal rows, so there are no ties, and repeated rows are stored one by one; an empty table gives an empty
table; other columns pass through media_column, but for one of the media column's own name, which is replaced, and
read_media leaves out kept columns with the names of its features; a long text is stored and read as a whole, in about 8
times its bytes of memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tables import kept_schema, map_arrow

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private PES data
PES_BYTES, PTS_STEP, GOP = 8192, 3600, 8
NULL_PID = 0x1FFF


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


_PAT = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15])
    return (head + b"\x00" + section).ljust(PACKET, b"\xff")


def _timestamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def _read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes, pes_bytes: int = PES_BYTES, gop: int = GOP) -> bytes:
    """The payload as a transport stream. Whole packets are laid out with numpy; only a PES packet's ends are special."""
    out: list[bytes] = []
    table_counter = counter = 0
    for k, lo in enumerate(range(0, len(payload), pes_bytes)):
        part = payload[lo : lo + pes_bytes]
        pts = k * PTS_STEP & (1 << 33) - 1
        random_access = k % gop == 0
        if random_access:
            out += [_table_packet(0, _PAT, table_counter), _table_packet(PMT_PID, _PMT, table_counter)]
            table_counter += 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + part
        adaptation = b""
        if random_access:  # random-access indicator and program clock reference
            adaptation = bytes([7, 0x50, pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0])
        room = PACKET - 4 - len(adaptation)
        first, rest = pes[:room], pes[room:]
        full, tail = divmod(len(rest), PACKET - 4)
        if len(first) < room:
            adaptation = _stuff(adaptation, room - len(first))
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 255, (0x30 if adaptation else 0x10) | counter & 15]) + adaptation + first)
        counter += 1
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, :4] = (SYNC, ES_PID >> 8, ES_PID & 255, 0x10)
            block[:, 3] |= (np.arange(counter, counter + full) & 15).astype(np.uint8)
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(block.tobytes())
            counter += full
        if tail:
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 255, 0x30 | counter & 15]) + _stuff(b"", PACKET - 4 - tail) + rest[len(rest) - tail :])
            counter += 1
    return b"".join(out)


def _stuff(adaptation: bytes, more: int) -> bytes:
    """An adaptation field lengthened by `more` bytes of stuffing."""
    if not more:
        return adaptation
    if adaptation:
        return bytes([adaptation[0] + more]) + adaptation[1:] + b"\xff" * more
    return b"\x00" if more == 1 else bytes([more - 1, 0]) + b"\xff" * (more - 2)


@dataclass
class Stream:
    """What `demux` found."""

    payload: bytes | None = None
    error: str = ""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    continuity_errors: int = 0
    duplicates: int = 0
    damaged: int = 0  # packets marked so
    bad_sections: int = 0
    lost_pes: int = 0
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers
    clock: list[tuple[int, int]] = field(default_factory=list)  # (packet number, program clock reference at 27 MHz)


@dataclass
class _Packets:
    """The packets of a stream that are whole, by number."""

    rows: np.ndarray
    pid: np.ndarray
    begins: np.ndarray
    has_payload: np.ndarray
    counter: np.ndarray
    skip: np.ndarray
    flags: np.ndarray  # the adaptation field's, 0 without one

    def data(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Payload bytes of these packets, and where each one's begin in them, with the end."""
        keep = np.arange(4, PACKET) >= (4 + self.skip[own])[:, None]
        return self.rows[own, 4:][keep], np.concatenate([[0], np.cumsum(keep.sum(1))])

    def in_order(self, own: np.ndarray, found: Stream) -> tuple[np.ndarray, np.ndarray]:
        """These packets of one PID without duplicates, and which of them follow a gap."""
        if not len(own):
            return own, np.zeros(0, bool)
        step = (np.diff(self.counter[own]) & 15).astype(np.int64)
        again = np.flatnonzero(step == 0)
        twice = np.zeros(len(own), bool)
        for i in again:  # an equal packet after a first one; clock references may differ
            a, z = own[i], own[i + 1]
            own_bytes = [self.rows[k, 4 + self.skip[k] :].tobytes() for k in (a, z)]
            twice[i + 1] = own_bytes[0] == own_bytes[1] and not twice[i]
        found.duplicates += int(twice.sum())
        own = own[~twice]
        gap = np.zeros(len(own), bool)
        gap[1:] = (np.diff(self.counter[own]) & 15 != 1) & (self.flags[own[1:]] & 0x80 == 0)  # 0x80: a jump that was announced
        found.continuity_errors += int(gap.sum())
        return own, gap


def _sections(packets: _Packets, pid: int, table_id: int, found: Stream) -> Iterator[tuple[int, bytes]]:
    """(number, body) of the distinct valid sections of a PID; they may span packets or share one."""
    own, gap = packets.in_order(np.flatnonzero((packets.pid == pid) & packets.has_payload), found)
    seen: set[bytes] = set()
    held: bytearray | None = None
    data, ends = packets.data(own)

    def whole(held: bytearray, last: bool) -> Iterator[tuple[int, bytes]]:
        """The sections that are complete in `held`, which keeps the rest."""
        while len(held) >= 3 and held[0] != 0xFF:
            size = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < size:
                break
            section = bytes(held[:size])
            del held[:size]
            if section in seen or section[0] != table_id:
                continue
            seen.add(section)
            if size < 12 or section_crc(section):
                found.bad_sections += 1
            elif section[5] & 1:  # in force now
                yield section[3] << 8 | section[4], section[8:-4]
        if last or held and held[0] == 0xFF:
            held.clear()

    for k, i in enumerate(own):
        part = data[ends[k] : ends[k + 1]].tobytes()
        if gap[k]:
            held = None
        if packets.begins[i]:
            if not part or 1 + part[0] > len(part):
                found.bad_sections += 1
                held = None
                continue
            if held is not None:
                held += part[1 : 1 + part[0]]
                yield from whole(held, True)
            held = bytearray(part[1 + part[0] :])
        elif held is not None:
            held += part
        if held is not None:
            yield from whole(held, False)


def _program_tables(packets: _Packets, found: Stream) -> None:
    for _, body in _sections(packets, 0, 0, found):
        for i in range(0, len(body) - 3, 4):
            if number := body[i] << 8 | body[i + 1]:  # 0 names the network table
                found.programs[number] = (body[i + 2] & 31) << 8 | body[i + 3]
    for number, map_pid in sorted(found.programs.items()):
        for program, body in _sections(packets, map_pid, 2, found):
            if program != number or len(body) < 4:
                continue
            i = 4 + ((body[2] & 15) << 8 | body[3])
            while i + 5 <= len(body):
                found.streams[(body[i + 1] & 31) << 8 | body[i + 2]] = body[i]
                i += 5 + ((body[i + 3] & 15) << 8 | body[i + 4])


def _elementary(packets: _Packets, pid: int, found: Stream) -> list[bytes]:
    """Payloads of the whole PES packets of a PID, with their timestamps and random-access points."""
    own, gap = packets.in_order(np.flatnonzero((packets.pid == pid) & packets.has_payload), found)
    data, ends = packets.data(own)
    starts = np.flatnonzero(packets.begins[own])
    out = []
    if len(own) and (not len(starts) or starts[0]):
        found.lost_pes += 1  # what begins before the stream does
    breaks = np.flatnonzero(gap)
    for a, b in zip(starts, [*starts[1:], len(own)]):
        after = breaks[np.searchsorted(breaks, a, "right") :]  # a gap before its first packet is the packet before's
        cut = int(after[0]) if len(after) and after[0] < b else b
        pes = data[ends[a] : ends[cut]].tobytes()
        body = 9 + pes[8] if len(pes) >= 9 else 0
        length = pes[4] << 8 | pes[5] if body else 0
        whole = pes[:3] == b"\x00\x00\x01" and 0 < body <= len(pes) and (length == len(pes) - 6 if length else cut == b)
        found.lost_pes += not whole or cut < b
        if not whole:
            continue
        if pes[7] & 0x80 and body >= 14:
            found.pts.append(_read_timestamp(pes[9:14]))
        if packets.flags[own[a]] & 0x40:
            found.random_access.append(int(own[a]))
        out.append(pes[body:])
    return out


def demux(media: bytes) -> Stream:
    found = Stream(packets=len(media) // PACKET)
    if not media or len(media) % PACKET:
        found.error = "length"
        return found
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        found.error = "sync"
        return found
    head = rows[:, 1:4].astype(np.int32)
    pid, control = (head[:, 0] & 31) << 8 | head[:, 1], head[:, 2]
    has_field = control & 0x20 != 0
    skip = np.where(has_field, rows[:, 4].astype(np.int32) + 1, 0)
    marked = (head[:, 0] & 0x80 != 0) | (4 + skip > PACKET)
    found.damaged = int(marked.sum())
    good = ~marked & (pid != NULL_PID)
    flags = np.where(has_field & (skip > 1), rows[:, 5], 0)
    payload = (control & 0x10 != 0) & good
    packets = _Packets(rows, np.where(good, pid, -1), head[:, 0] & 0x40 != 0, payload, control & 15, np.where(good, skip, 0), flags)
    for i in np.flatnonzero(good & (flags & 0x10 != 0) & (skip >= 8)):
        b = rows[i, 6:12].astype(np.int64)
        base = b[0] << 25 | b[1] << 17 | b[2] << 9 | b[3] << 1 | b[4] >> 7
        found.clock.append((int(i), int(base) * 300 + (int(b[4] & 1) << 8 | int(b[5]))))
    _program_tables(packets, found)
    if not found.streams:
        found.error = "table"
        return found
    parts = [x for pid in sorted(found.streams) for x in _elementary(packets, pid, found)]
    found.payload = b"".join(parts)
    if found.lost_pes or found.damaged or found.bad_sections:
        found.error = f"lost pes {found.lost_pes}, damaged packets {found.damaged}, bad sections {found.bad_sections}"
    return found


def padded(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def _slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `limit` bytes in `column`: what one Python step holds is bounded."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """The documents with one more column: the padded text stored as a transport stream."""
    docs = docs.drop(media)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(media, T.BinaryType())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                made = pa.array([mux(padded(t)) for t in _texts(part.column(text))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, media])

    return map_arrow(docs, store, schema)


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long, "
    "continuity_errors long, lost_pes long, pts array<long>, random_access array<long>, clock array<long>, error string"
)
_KINDS = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in FEATURES.split(", ")])


def features_of(media: bytes) -> dict:
    s = demux(media)
    payload = s.payload or b""
    said = {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "packets": s.packets,
        "continuity_errors": s.continuity_errors, "lost_pes": s.lost_pes, "pts": s.pts, "random_access": s.random_access,
        "clock": [t for _, t in s.clock], "error": s.error,
    }
    streams = ",".join(f"{p}:{t}" for p, t in sorted(s.streams.items()))
    said["feature"] = ";".join([
        f"packets={s.packets}", f"programs={len(s.programs)}", f"streams={streams}", f"continuity_errors={s.continuity_errors}",
        f"pes={len(s.pts)}", f"pts={s.pts[0] if s.pts else -1}-{s.pts[-1] if s.pts else -1}", f"random_access={len(s.random_access)}",
        f"error={s.error}",
    ])
    return said


def read_media(stored: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """Columns `keep` and what the stored bytes hold when read back: columns as in FEATURES. Null media: empty."""
    keep = [k for k in keep if k.lower() not in _ARROW.names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, media):
                rows = pa.RecordBatch.from_pylist([features_of(m) for m in _texts(part.column(media))], schema=_ARROW)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *rows.columns], names=[*keep, *_ARROW.names])

    return map_arrow(stored.select(*dict.fromkeys([*keep, media])), read, ", ".join([*([kept_schema(stored, keep)] * bool(keep)), FEATURES]))
