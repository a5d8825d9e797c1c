"""MPEG transport streams as a media column: write, parse, check, reassemble.

A stream carries one program: association table (PID 0), program map table, and one elementary
stream of timestamped packets. Reading follows the tables from PID 0, checks sync bytes,
checksums of the tables, continuity counters and packet lengths, and gives back the elementary
bytes with the timestamp of each access unit and the byte offsets of random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from objwatch.llm.common import fresh_path, map_batches, table

# fixed values of the format
PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PRIVATE_PES, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000
CRC_POLY = 0x04C11DB7

# choices of this writer
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT = 576  # the payload is padded to a multiple of this
ACCESS_UNIT = 10 * UNIT
TICKS = CLOCK // 25  # between access units
RANDOM_ACCESS_EVERY = 5  # access units
HEADER = 14  # bytes of a packet header of the elementary stream that has a timestamp


@lru_cache(maxsize=256)
def section_crc(data: bytes) -> int:
    """The checksum of program tables; 0 over a section with its own checksum."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLY if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, PRIVATE_PES, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


def _stamp(pts: np.ndarray) -> np.ndarray:
    """Timestamps of 33 bits as five bytes each."""
    parts = [0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, 1 | (pts >> 15 & 127) << 1, pts >> 7 & 255, 1 | (pts & 127) << 1]
    return np.stack(parts, 1).astype(np.uint8)


def _units(data: np.ndarray, first: int) -> np.ndarray:
    """Packets (m, k, 188) of m access units of equal size; data is (m, size), first the number of the first one."""
    m, size = data.shape
    number = np.arange(first, first + m)
    pts = (number + 1) * TICKS
    head = np.zeros((m, HEADER), np.uint8)
    head[:, :9] = [0, 0, 1, PRIVATE_STREAM, size + 8 >> 8, size + 8 & 255, 0x80, 0x80, 5]
    head[:, 9:] = _stamp(pts)
    stream = np.concatenate([head, data], 1)
    lead = BODY - 8  # beside a clock reference
    full, rest = divmod(stream.shape[1] - lead, BODY)
    k = 1 + full + (rest > 0)
    out = np.zeros((m, k, PACKET), np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = ES_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = ES_PID & 255
    out[:, :, 3] = 0x10 | np.arange(first * _per_unit(), first * _per_unit() + m * k).reshape(m, k) & 15
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = 7
    out[:, 0, 5] = np.where(number % RANDOM_ACCESS_EVERY == 0, 0x50, 0x10)
    base = pts - TICKS  # the clock runs one unit ahead
    out[:, 0, 6:12] = np.stack([base >> 25 & 255, base >> 17 & 255, base >> 9 & 255, base >> 1 & 255, (base & 1) << 7 | 0x7E, base * 0], 1)
    out[:, 0, 12:] = stream[:, :lead]
    out[:, 1 : 1 + full, 4:] = stream[:, lead : lead + full * BODY].reshape(m, full, BODY)
    if rest:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = BODY - 1 - rest
        if rest < BODY - 1:
            out[:, -1, 5] = 0
            out[:, -1, 6 : PACKET - rest] = 0xFF
        out[:, -1, PACKET - rest :] = stream[:, -rest:]
    return out


@lru_cache(maxsize=1)
def _per_unit() -> int:
    """Packets of a full access unit."""
    return 1 + -(-(HEADER + ACCESS_UNIT - BODY + 8) // BODY)


def write_stream(payload: bytes) -> bytes:
    """A transport stream whose elementary bytes are payload, of a positive multiple of UNIT bytes."""
    data = np.frombuffer(payload, np.uint8)
    m = len(data) // ACCESS_UNIT
    parts = [_tables()]
    if m:
        parts.append(_units(data[: m * ACCESS_UNIT].reshape(m, ACCESS_UNIT), 0).tobytes())
    if len(data) % ACCESS_UNIT:
        parts.append(_units(data[None, m * ACCESS_UNIT :], m).tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What read_stream() finds. Errors are counted; payload has all elementary bytes that arrived."""

    payload: bytes = b""
    packets: int = 0
    pts: list[int] = field(default_factory=list)  # of each access unit, in 1/90000 s
    random_access: list[int] = field(default_factory=list)  # offsets in payload
    sync_errors: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    length_errors: int = 0

    def feature(self) -> str:
        last = self.pts[-1] if self.pts else 0
        faults = self.sync_errors + self.table_errors + self.continuity_errors + self.length_errors
        return f"packets={self.packets};units={len(self.pts)};last_pts={last};random_access={len(self.random_access)};errors={faults}"


def _program_table(packets: np.ndarray, pid: np.ndarray, begin: np.ndarray, want: int, out: Stream) -> bytes | None:
    """The body of the first intact section on a PID."""
    for p in packets[(pid == want) & begin]:
        at = 4 + (1 + int(p[4]) if p[3] & 0x20 else 0)
        section = p[at + 1 + int(p[at]) :].tobytes() if at < PACKET else b""
        if len(section) > 2:
            section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
            if len(section) >= 12 and section_crc(section) == 0:
                return section[8:-4]
        out.table_errors += 1
    return None


def read_stream(media: bytes | None) -> Stream:
    """Parse a transport stream; null, empty or foreign bytes give an empty result with errors counted."""
    out = Stream()
    raw = np.frombuffer(media or b"", np.uint8)
    packets = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    out.sync_errors += int(len(raw) % PACKET > 0) + int((packets[:, 0] != SYNC).sum())
    packets = packets[packets[:, 0] == SYNC]
    out.packets = len(packets)
    pid = (packets[:, 1] & 0x1F).astype(int) << 8 | packets[:, 2]
    begin = packets[:, 1] & 0x40 > 0
    pat = _program_table(packets, pid, begin, PAT_PID, out)
    pmt_pid = next((((pat[i + 2] & 31) << 8 | pat[i + 3]) for i in range(0, len(pat) - 3, 4) if pat[i] | pat[i + 1]), None) if pat else None
    pmt = _program_table(packets, pid, begin, pmt_pid, out) if pmt_pid is not None else None
    if not pmt or len(pmt) < 4:
        out.table_errors += 1
        return out
    at = 4 + ((pmt[2] & 15) << 8 | pmt[3])
    if at + 4 >= len(pmt):
        out.table_errors += 1
        return out
    own = pid == ((pmt[at + 1] & 31) << 8 | pmt[at + 2])
    packets, begin = packets[own & (packets[:, 3] & 0x10 > 0)], begin[own & (packets[:, 3] & 0x10 > 0)]
    if not len(packets):
        return out
    counter = packets[:, 3] & 15
    out.continuity_errors = int(((np.diff(counter.astype(int)) - 1) % 16 != 0).sum())
    adapted = packets[:, 3] & 0x20 > 0
    offset = np.minimum(np.where(adapted, 5 + packets[:, 4].astype(int), 4), PACKET)
    random = adapted & (packets[:, 4] > 0) & (packets[:, 5] & 0x40 > 0) & begin
    data = packets[np.arange(PACKET) >= offset[:, None]]
    ends = np.cumsum(PACKET - offset)
    starts = (ends - (PACKET - offset))[begin]
    keep = np.ones(len(data), bool)
    if len(starts):
        keep[: starts[0]] = False
    heads = data[np.minimum(starts[:, None] + np.arange(HEADER), len(data) - 1)].astype(int)
    sizes = np.diff(np.append(starts, len(data)))
    sound = (sizes >= 9) & (heads[:, 0] == 0) & (heads[:, 1] == 0) & (heads[:, 2] == 1)
    told = heads[:, 4] << 8 | heads[:, 5]
    out.length_errors = int((~sound).sum() + (sound & (told > 0) & (told + 6 != sizes)).sum())
    head = np.where(sound, 9 + heads[:, 8], 0)
    for i in range(int(head.max(initial=0))):
        at_head = starts[(head > i) & (sizes > i)]
        keep[at_head + i] = False
    stamped = sound & (heads[:, 7] & 0x80 > 0) & (sizes >= HEADER)
    t = heads[stamped]
    out.pts = ((t[:, 9] >> 1 & 7) << 30 | t[:, 10] << 22 | (t[:, 11] >> 1) << 15 | t[:, 12] << 7 | t[:, 13] >> 1).tolist()
    payload_at = np.cumsum(keep) - keep
    out.random_access = payload_at[np.minimum(starts[random[begin]] + head[random[begin]], len(data) - 1)].tolist()
    out.payload = data[keep].tobytes()
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of text (null: empty), filled up with 255 to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff"), len(raw)


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs(doc_id, text, ...) as a transport stream, and its bytes before padding.

    Null counts as empty, which is one unit of padding. Repeated rows are streams each; a null doc_id is carried. A very long
    text is one stream of as many access units as it takes, and is held once with its stream. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = [padded(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([n for _, n in both], pa.int64()), pa.array([write_stream(x) for x, _ in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, media binary")


def stored(media: DataFrame) -> DataFrame:
    """media, written to the shared folder and read from there."""
    path = fresh_path(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


STREAM = "payload binary, packets bigint, pts array<bigint>, random_access array<bigint>, sync_errors bigint, table_errors bigint, continuity_errors bigint, length_errors bigint"


def read_media(df: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key and STREAM for each row of a column of transport streams; null or broken ones give what can be read and error counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STREAM.split(", ")]
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [read_stream(m) for m in part[column].to_pylist()]
                yield pa.RecordBatch.from_arrays([part[key], *(pa.array([getattr(s, n) for s in found], k) for n, k in zip(names, kinds, strict=True))], [key, *names])

    return map_batches(df.select(key, column), run, f"{key} {dict(df.dtypes)[key]}, {STREAM}")


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """DIGESTS of each stream of media(doc_id, n_bytes, media), from its bytes; null, empty or broken streams give what can be read, and errors in feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for doc, n, raw in zip(part["doc_id"].to_pylist(), part["n_bytes"].to_pylist(), part["media"].to_pylist(), strict=True):
                    raw = raw or b""
                    back = read_stream(raw)
                    rows.append((doc, n, len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), back.feature()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for x, n in zip(zip(*rows, strict=True), names, strict=True)], names)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, DIGESTS)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(stored(to_media(table(spark, sf_dir, "documents"))))
