"""Operator 7, media columns: MPEG audio. Frames are found again after damage, tags and variable-bitrate tables parsed, checksums verified, exact durations and seek offsets kept.

:func:`parse` reads any MPEG 1/2/2.5 audio, layers I to III, from bytes: an ID3v2 tag at the front, an ID3v1 tag at the
end, a Xing/Info or VBRI table in the first frame, then a chain of frames. Where the last frame ends with the file, 'TAG' within
it is its own data and no ID3v1 tag. A frame header is believed only if a
second one (or the end) follows where its length says; after damage the next such place is sought byte by byte.

:func:`store` writes a payload losslessly: an ID3v2 tag with the payload's length, an Info frame with frame count, byte
count and seek table, then mono layer III frames with checksums, each holding 192 payload bytes as its main data.
Every byte is read back from the frames by :func:`payload`.

Edge cases: null and empty texts are stored as 192 blanks; null ids and repeated rows are kept; very long texts become more
frames, one row each; bytes that are no MPEG audio give no frames and a null duration; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, text_of

UNIT = 192
#: Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by version and layer, samples a second by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed values (ISO/IEC 11172-3 tables B.2a to B.2d, 13818-3 table B.1): bits of a layer II allocation, as (subbands, bits) from the lowest on.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The frame checksum: polynomial 0x8005, most significant bit first."""
    for b in data:
        value ^= b << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def crc16_bits(value: int, n: int) -> int:
    """:func:`crc16` of the ``n`` lowest bits of ``value``, highest first."""
    out = crc16((value >> n % 8).to_bytes(n // 8)) if n >= 8 else 0xFFFF
    for i in range(n % 8 - 1, -1, -1):
        out = (out << 1 ^ (0x8005 if (out >> 15 ^ value >> i) & 1 else 0)) & 0xFFFF
    return out


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int
    joint: int | None = None  # first subband that both channels share

    def allocation(self) -> list[int]:
        """Bits of the allocation of each subband, layers I and II."""
        if self.layer == 1:
            return [4] * 32
        each = self.kbps // (1 if self.mono else 2)
        if self.version != 1:
            table = "lsf"
        elif each <= 48:
            table = "d" if self.rate == 32000 else "c"
        else:
            table = "a" if self.rate == 48000 or each <= 80 else "b"
        return [bits for n, bits in ALLOCATION[table] for _ in range(n)]

    def checksum(self, frame: bytes) -> int:
        """The checksum of what it covers in this frame: the header's second half and side information, allocation, or allocation and selection."""
        if self.layer == 3:
            return crc16(frame[2:4] + frame[6 : 6 + self.side])
        widths = self.allocation()
        joint = len(widths) if self.joint is None else min(self.joint, len(widths))
        fields = [w for k, w in enumerate(widths) for _ in range(1 if self.mono or k >= joint else 2)]
        body, total = frame[6:], sum(fields)
        value, have = int.from_bytes(body[: total // 8 + 1]), (total // 8 + 1) * 8
        if self.layer == 2:  # two bits of scale factor selection for each channel whose subband has an allocation
            at, used = 0, 0
            for k, w in enumerate(widths):
                own = 1 if self.mono or k >= joint else 2
                for _ in range(own):
                    used += (value >> have - at - w & (1 << w) - 1 > 0) * (1 if self.mono or own == 2 else 2)
                    at += w
            total += 2 * used
            value, have = int.from_bytes(body[: total // 8 + 1]), (total // 8 + 1) * 8
        return crc16_bits(int.from_bytes(frame[2:4]) << total | value >> have - total, 16 + total)


def header(four: bytes, _known: dict = {}) -> Header | None:  # noqa: B006  a table of the few headers that occur
    """The frame header in these four bytes, None if there is none. Free-format frames are not read."""
    if (h := _known.get(four, 0)) != 0:
        return h
    if len(_known) > 4096:
        _known.clear()
    h = None
    if len(four) == 4 and four[0] == 0xFF and four[1] >> 5 == 7:
        version, layer = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
        b, r, pad, mono = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1, four[3] >> 6 == 3
        if version and layer < 4 and 0 < b < 15 and r < 3:
            kbps, rate = BITRATES[1 if version == 1 else 2, layer][b], RATES[version][r]
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
            size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
            side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
            joint = 4 + 4 * (four[3] >> 4 & 3) if four[3] >> 6 == 1 and layer < 3 else None
            h = Header(version, layer, not four[1] & 1, kbps, rate, mono, size, samples, side, joint)
    _known[four] = h
    return h


@dataclass
class Media:
    offsets: list[int] = field(default_factory=list)  # of the audio frames, the table's frame not among them
    samples: int = 0
    rate: int = 0
    kbps: list[int] = field(default_factory=list)  # distinct, sorted
    checked: int = 0
    bad: int = 0
    skipped: int = 0  # bytes that belong to no tag and no frame
    tags: dict[str, str] = field(default_factory=dict)
    table: str | None = None  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes | list[int] | None = None
    end: int = 0  # of the last frame

    @property
    def seconds(self) -> float | None:
        return self.samples / self.rate if self.rate else None


def syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a version 2.3 or 2.4 tag, and where the tag ends (0 without one)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    end, at, out = 10 + syncsafe(data[6:10]) + (10 if data[5] & 16 else 0), 10, {}
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        size = syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, cut, value = text.partition("\0")
            out[f"{name}:{key}" if name == "TXXX" and cut else name] = value if name == "TXXX" and cut else text
        at += 10 + size
    return out, end


def vbr_table(frame: bytes, h: Header, out: Media) -> bool:
    """Reads a Xing/Info or VBRI table into ``out``; False if this frame holds none."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out.table, flags, at = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8]), at + 8
        if flags & 1:
            out.table_frames, at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 2:
            out.table_bytes, at = int.from_bytes(frame[at : at + 4]), at + 4
        if flags & 4:
            out.toc = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(frame[46:50]), int.from_bytes(frame[50:54])
        entries, scale, width = (int.from_bytes(frame[i : i + 2]) for i in (54, 56, 58))
        out.toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(entries)]
        return True
    return False


def parse(data: bytes) -> Media:
    tags, at = id3v2(data)
    end = len(data) - 128
    if end < at or data[end : end + 3] != b"TAG":
        return chain(data, at, len(data), tags)
    whole = chain(data, at, len(data), tags)
    if whole.offsets and whole.offsets[-1] < end and whole.end == len(data):
        return whole  # the last frame holds these bytes: no tag
    tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return chain(data, at, end, tags)


def chain(data: bytes, at: int, end: int, tags: dict[str, str]) -> Media:
    """The frames from ``at`` to ``end``."""
    out = Media(tags=tags)
    sums: dict[bytes, int] = {}
    rates, chained, first = set(), False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h is None or after > end or not chained and after != end and header(data[after : after + 4]) is None:
            lost = data.find(b"\xff", at + 1, end)
            out.skipped += (lost if lost >= 0 else end) - at
            at, chained = lost if lost >= 0 else end, False
            continue
        if h.protected:
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side] if h.layer == 3 else data[at:after]
            if (s := sums.get(covered)) is None:
                s = h.checksum(data[at:after])
                if len(sums) < 1000:
                    sums[covered] = s
            out.checked += 1
            out.bad += s != data[at + 4] << 8 | data[at + 5]
        if not (first and vbr_table(data[at:after], h, out)):
            out.offsets.append(at)
            out.samples += h.samples
            out.rate = out.rate or h.rate
            rates.add(h.kbps)
        at, chained, first = after, True, False
        out.end = after
    out.skipped += max(0, end - at)
    out.kbps = sorted(rates)
    return out


#: Version 1, layer III, checksum, 80 kbit/s, 48000 Hz, mono: 240 bytes a frame, of which 4 header, 2 checksum, 17 side information.
HEAD = bytes([0xFF, 0xFA, 0x64, 0xC0])
FRAME = 240
MAIN = 4 + 2 + 17


def store(raw: bytes) -> bytes:
    """``raw`` padded with blanks to a positive multiple of UNIT, as an MPEG file."""
    n = max(1, -(-len(raw) // UNIT))
    body = np.frombuffer(raw.ljust(n * UNIT, b" "), np.uint8).reshape(n, UNIT)
    side = bytes(17)
    lead = HEAD + crc16(HEAD[2:] + side).to_bytes(2) + side
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :MAIN] = np.frombuffer(lead, np.uint8)
    frames[:, MAIN : MAIN + UNIT] = body
    note = b"\x03LENGTH\0" + str(len(raw)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    size = len(tag)
    front = b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag
    toc = bytes(min(255, 256 * (FRAME + FRAME * (n * i // 100)) // (FRAME * (n + 1))) for i in range(100))
    info = (lead + b"Info" + struct.pack(">III", 7, n, FRAME * (n + 1)) + toc).ljust(FRAME, b"\0")
    return front + info + frames.tobytes()


def payload(data: bytes, media: Media) -> bytes:
    """The main data of each frame that :func:`store` wrote."""
    at = media.offsets
    if at and at[-1] - at[0] == FRAME * (len(at) - 1):
        return np.frombuffer(data, np.uint8)[at[0] : at[-1] + FRAME].reshape(-1, FRAME)[:, MAIN : MAIN + UNIT].tobytes()
    return b"".join(data[i + MAIN : i + MAIN + UNIT] for i in at)


def feature(m: Media) -> str:
    """What a catalogue keeps of the audio: duration as a fraction, frame counts, checks, and the seek offsets' digest."""
    seek = hashlib.sha256(np.array(m.offsets, "<u8").tobytes()).hexdigest()[:16]
    return f"frames={len(m.offsets)};samples={m.samples}/{m.rate};kbps={','.join(map(str, m.kbps))};crc={m.checked - m.bad}/{m.checked};skipped={m.skipped};table={m.table}:{m.table_frames}:{m.table_bytes};first={m.offsets[0] if m.offsets else ''};seek={seek}"


def with_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text stored as an MPEG file in a binary column."""
    d = docs.select("doc_id", text_of().cast("binary").alias("raw"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([store(x) for x in b.column("raw").to_pylist()], pa.binary())], names=["doc_id", "media"])

    return d.mapInArrow(run, f"doc_id {kind}, media binary")


FEATURES = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, seconds double, seek_offsets array<bigint>"


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, the columns of FEATURES) from the stored bytes alone; null media give nulls."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    fields = [x.strip().split()[0] for x in FEATURES.split(", ")]

    def row(data: bytes | None):
        if data is None:
            return (None,) * len(fields)
        m = parse(data)
        p = payload(data, m)
        length = m.tags.get("TXXX:LENGTH")
        return (int(length) if length else None, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(m), m.seconds, m.offsets)

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = [row(x) for x in b.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", *fields])

    return stored.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, {FEATURES}")


def query(spark, sf_dir: str) -> DataFrame:
    return read_media(with_media(documents(spark, sf_dir)))
