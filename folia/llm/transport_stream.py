"""Media columns: MPEG transport streams (ISO/IEC 13818-1) with one program of one elementary stream.

Writing cuts samples into access units, each a PES packet with a presentation time, and those into
188-byte packets, behind a program association table and a program map table.  Reading parses
the tables, checks every continuity counter, reassembles the elementary packets and keeps the
timestamps and the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folia.llm.common import by_bytes, lean, written

PACKET = 188
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
#: Stream type and id of private data in PES packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Samples of an access unit; ticks of the 90 kHz clock that one takes.
UNIT = 16_384
TICKS = 90_000 * UNIT // 8_000
#: Payloads are padded with zeros to a positive multiple of this.
BLOCK = 64


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pes(unit: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp + unit


def _packets(pes: bytes, first_counter: int, pcr: int) -> np.ndarray:
    """The transport packets of one PES packet; the first bears the clock and is a random-access point."""
    rest = max(0, len(pes) - 176)
    n = 1 + -(-rest // 184)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | (first_counter + np.arange(n)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    head = min(len(pes), 176)
    out[0, 4], out[0, 5] = 183 - head, 0x50
    out[0, 6:12] = np.frombuffer((pcr << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    data = np.frombuffer(pes, np.uint8)
    out[0, PACKET - head :] = data[:head]
    full, last = divmod(rest, 184)
    if full:
        out[1 : 1 + full, 4:] = data[head : head + 184 * full].reshape(full, 184)
    if last:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - last
        if last < 183:
            out[-1, 5] = 0
        out[-1, PACKET - last :] = data[-last:]
    return out


def mux(samples: bytes) -> bytes:
    """A transport stream of the samples; without samples it is the two tables alone."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(samples), UNIT)):
        pts = (k * TICKS + 9_000) & (1 << 33) - 1
        packets = _packets(_pes(samples[at : at + UNIT], pts), counter, pts - 9_000)
        counter = (counter + len(packets)) & 15
        parts.append(packets.tobytes())
    return b"".join(parts)


class Stream(NamedTuple):
    """What reading a transport stream gives."""

    samples: bytes
    pid: int
    packets: int
    pts: list[int]
    random_access: list[int]  # byte offsets of packets from which decoding can start


def _read_section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    at = 5 + raw[4]
    size = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF)
    section = raw[at : at + size]
    if len(section) != size or section[0] != table_id or crc32_mpeg(section):
        raise ValueError("a program table is damaged")
    return section


def demux(media: bytes) -> Stream:
    """Reads a stream back; raises ValueError where sync bytes, tables, counters or lengths are wrong."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("a sync byte is missing")
    pids = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    pats = np.flatnonzero(pids == 0)
    if not len(pats):
        raise ValueError("there is no program association table")
    pat = _read_section(p[pats[0]], 0)
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4)}
    pmts = np.flatnonzero(pids == programs.get(PROGRAM, -1))
    if not len(pmts):
        raise ValueError("there is no program map table")
    pmt = _read_section(p[pmts[0]], 2)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    own = np.flatnonzero(pids == pid)
    e = p[own]
    if not len(e):
        return Stream(b"", pid, len(p), [], [])
    counters = e[:, 3] & 15
    if ((counters[1:] - counters[:-1]) & 15 != 1).any():
        raise ValueError("a continuity counter is out of order")
    adapted = e[:, 3] & 0x20 != 0
    begin = np.where(adapted, 5 + e[:, 4].astype(np.int64), 4)
    flags = np.where(adapted & (e[:, 4] > 0), e[:, 5], 0)
    body = e[np.arange(PACKET)[None] >= begin[:, None]].tobytes()
    ends = (PACKET - begin).cumsum()
    starts = np.flatnonzero(e[:, 1] & 0x40)
    edges = [*np.concatenate(([0], ends))[starts].tolist(), len(body)]
    units, pts = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if body[a : a + 4] != b"\x00\x00\x01" + bytes([STREAM_ID]) or int.from_bytes(body[a + 4 : a + 6], "big") != b - a - 6:
            raise ValueError("an elementary packet is damaged")
        s = body[a + 9 : a + 14]
        pts.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
        units.append(body[a + 9 + body[a + 8] : b])
    return Stream(b"".join(units), pid, len(p), pts, (own[flags & 0x40 != 0] * PACKET).tolist())


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded UTF-8 bytes as a transport stream, written and read back.

    A null text counts as empty; equal texts give equal streams.  Only doc_id and text are read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in by_bytes(whole.column(1), 8_000_000):
                batch = whole.slice(at, n)
                texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())], names=schema.names)

    return written(docs.select("doc_id", "text").mapInArrow(lean(make), schema), "media", compression="zstd")


def feature(stream: Stream) -> str:
    """Format, packets, units, first and last time, random-access points and the samples' mean and deviation."""
    x = np.frombuffer(stream.samples, np.uint8)
    first, last = (stream.pts[0], stream.pts[-1]) if stream.pts else (0, 0)
    mean, dev = (x.mean(), x.std()) if len(x) else (0.0, 0.0)
    return f"ts pid={stream.pid} packets={stream.packets} units={len(stream.pts)} pts={first}-{last} rap={len(stream.random_access)} mean={mean:.4f} dev={dev:.4f}"


def read(media: DataFrame) -> DataFrame:
    """Of each row of ``store``: the stream's digests, its timestamps and its random-access points.

    Gives doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, pts (array of 90 kHz ticks) and random_access (array of byte offsets).
    """
    fields = [("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string()), ("pts", T.ArrayType(T.LongType()), pa.list_(pa.int64())), ("random_access", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    schema = T.StructType([media.schema["doc_id"], media.schema["n_bytes"], *(T.StructField(n, t) for n, t, _ in fields)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in by_bytes(whole.column(2), 8_000_000):
                batch, rows = whole.slice(at, n), []
                for raw in batch.column(2).to_pylist():
                    s = demux(raw)
                    rows.append((len(s.samples), hashlib.sha256(s.samples).hexdigest(), zlib.crc32(s.samples[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(s), s.pts, s.random_access))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(fields))], names=schema.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(parse), schema)
