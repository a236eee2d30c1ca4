"""Transport streams that other muxers write, or that lost something on the way."""

import random

from regionspark.llm import transport_stream as ts

PAYLOAD = random.Random(0).randbytes(50_000)


def packets(media):
    return [bytearray(media[k : k + ts.PACKET]) for k in range(0, len(media), ts.PACKET)]


def joined(parts):
    return b"".join(map(bytes, parts))


def of_pid(parts, pid):
    return [k for k, p in enumerate(parts) if (p[1] & 31) << 8 | p[2] == pid]


def test_a_duplicate_packet_counts_once():
    parts = packets(ts.mux(PAYLOAD))
    media = of_pid(parts, 0x100)
    for k in (media[0], media[9], media[-1]):
        own = parts[: k + 1] + [parts[k]] + parts[k + 1 :]
        s = ts.demux(joined(own))
        assert s.payload == PAYLOAD and s.duplicates == 1 and not s.continuity_errors and not s.lost_pes
    thrice = parts[: media[9] + 1] + [parts[media[9]]] * 2 + parts[media[9] + 1 :]
    assert ts.demux(joined(thrice)).continuity_errors == 1  # a packet may be sent twice, not three times


def test_a_lost_packet_costs_its_pes():
    parts = packets(ts.mux(PAYLOAD))
    media = of_pid(parts, 0x100)
    heads = [k for k in media if parts[k][1] & 0x40]
    for at in (media.index(heads[2]) + 3, media.index(heads[2]), len(media) - 1):
        s = ts.demux(joined(parts[: media[at]] + parts[media[at] + 1 :]))
        own = [k for k in heads if k <= media[at]]
        first = (len(own) - 1) * ts.PES_BYTES
        assert s.lost_pes == 1 and s.payload == PAYLOAD[:first] + PAYLOAD[first + ts.PES_BYTES :]
        assert s.continuity_errors == (at != len(media) - 1) and len(s.pts) == len(heads) - 1


def test_an_announced_jump_is_no_error():
    parts = packets(ts.mux(PAYLOAD, gop=2))
    media = of_pid(parts, 0x100)
    heads = [k for k in media if parts[k][1] & 0x40 and parts[k][3] & 0x20 and parts[k][4]]
    start = heads[1]
    for k in media[media.index(start) :]:
        parts[k][3] = parts[k][3] & 0xF0 | (parts[k][3] + 5) & 15
    assert ts.demux(joined(parts)).continuity_errors == 1
    parts[start][5] |= 0x80
    s = ts.demux(joined(parts))
    assert s.continuity_errors == 0 and s.payload == PAYLOAD and s.lost_pes == 0


def test_packets_marked_as_damaged_are_left_out():
    parts = packets(ts.mux(PAYLOAD))
    k = of_pid(parts, 0x100)[5]
    parts[k][1] |= 0x80
    s = ts.demux(joined(parts))
    assert s.damaged == 1 and s.lost_pes == 1 and len(s.payload) == len(PAYLOAD) - ts.PES_BYTES


def test_sections_over_several_packets():
    """A program map with so many descriptors that it takes three packets."""
    parts = packets(ts.mux(PAYLOAD))
    (map_pid,) = ts.demux(joined(parts)).programs.values()
    note = b"\x05\xc8" + bytes(200)
    body = bytes([0xE1, 0x00, 0xF0 | len(note * 2) >> 8, len(note * 2) & 255]) + note * 2 + bytes([6, 0xE1, 0x00, 0xF0, 0])
    section = ts._section(2, 1, body)
    data = b"\0" + section
    data += b"\xff" * (-len(data) % (ts.PACKET - 4))
    made = []
    for n, lo in enumerate(range(0, len(data), ts.PACKET - 4)):
        made.append(bytes([0x47, (0x40 if n == 0 else 0) | map_pid >> 8, map_pid & 255, 0x10 | n & 15]) + data[lo : lo + ts.PACKET - 4])
    assert len(made) == 3
    maps = of_pid(parts, map_pid)
    own = [p for k, p in enumerate(parts) if k not in maps]
    whole = own[:1] + made + own[1:]
    s = ts.demux(joined(whole))
    assert s.streams == {0x100: 6} and s.payload == PAYLOAD and s.bad_sections == 0
    lost = ts.demux(joined(own[:1] + made[:1] + made[2:] + own[1:]))
    assert lost.streams == {} and lost.continuity_errors == 1


def test_clock_references_ascend():
    s = ts.demux(ts.mux(PAYLOAD, gop=2))
    times = [t for _, t in s.clock]
    assert len(times) > 1 and times == sorted(times) and all(k in range(s.packets) for k, _ in s.clock)
    assert s.pts == sorted(s.pts)
