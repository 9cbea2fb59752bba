"""MPEG audio columns: frames, tags, seek tables, checksums, durations and seek offsets.

``read_stream`` takes any bytes: it reads an ID3v2 tag, finds the first frame
by a header whose successor is a header too, walks from frame to frame and
resynchronises after damage in the same way. Layer III with a stated bit rate is
read; the free format is not. ``write_stream`` makes a Layer III stream whose
frames carry a payload as ancillary data behind empty granules, which players
take as silence: a lossless store in the format's own units.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch_path

# Fixed values of the format: kbit/s by header index, for MPEG-1 and MPEG-2/2.5 Layer III; Hz by version.
BITRATES_1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
BITRATES_2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}

RATE = 32000  # at this rate every bit rate gives frames of whole, equal length
SAMPLES = 1152
MONO_SIDE = 17
OVERHEAD = 4 + 2 + MONO_SIDE  # header, CRC-16, side information

MEDIA_SCHEMA = "doc_id string, n_bytes long, media binary"


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int

    @property
    def samples(self) -> int:
        return SAMPLES if self.version == 3 else SAMPLES // 2

    @property
    def side(self) -> int:
        if self.version == 3:
            return MONO_SIDE if self.mono else 32
        return 9 if self.mono else MONO_SIDE


def parse_header(data: bytes, at: int) -> Header | None:
    """The Layer III frame header at ``at``, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = b1 >> 3 & 3, b1 >> 1 & 3
    index, rate = b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer != 1 or index in (0, 15) or rate == 3 or b3 & 3 == 2:
        return None
    bitrate = (BITRATES_1 if version == 3 else BITRATES_2)[index]
    hz = RATES[version][rate]
    length = (144 if version == 3 else 72) * bitrate * 1000 // hz + (b2 >> 1 & 1)
    return Header(version, not b1 & 1, bitrate, hz, b3 >> 6 == 3, length)


def _crc_table() -> np.ndarray:
    """CRC-16 with polynomial 0x8005, most significant bit first, by byte."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of bytes: the header's last two and the side information."""
    value = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for column in rows.T:
        value = (value << 8 & 0xFFFF) ^ _CRC[value >> 8 ^ column]
    return value


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsyncsafe(b: bytes) -> int:
    out = 0
    for x in b:
        out = out << 7 | x & 127
    return out


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of each frame, the table's one included
    headers: list[Header] = field(default_factory=list)
    table_frames: int | None = None  # as the variable-bitrate table declares
    table_bytes: int | None = None
    seek_table: bytes = b""
    has_table: bool = False
    crc_errors: int = 0
    resyncs: int = 0
    entry_bytes: list[int] = field(default_factory=list)  # of a VBRI table: bytes of each run of frames_per_entry frames
    frames_per_entry: int = 0

    @property
    def audio(self) -> range:
        """Indexes of the frames that sound."""
        return range(int(self.has_table), len(self.offsets))

    def samples(self) -> dict[int, int]:
        """How many samples sound at each rate, in samples a second; a stream may change its rate."""
        out: dict[int, int] = {}
        for i in self.audio:
            h = self.headers[i]
            out[h.rate] = out.get(h.rate, 0) + h.samples
        return out

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly: each rate's samples by that rate."""
        return sum((Fraction(n, rate) for rate, n in self.samples().items()), Fraction(0))

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that plays ``sample``; beyond the end, of the last one."""
        ends = np.cumsum([self.headers[i].samples for i in self.audio])
        return self.offsets[self.audio[min(int(np.searchsorted(ends, sample, "right")), len(ends) - 1)]]


#: The text encodings of ID3v2 by their byte; others, which no version defines, are read as Latin-1.
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _whole(data: bytes) -> bytes:
    """Bytes without the zeros that unsynchronisation puts behind 0xFF."""
    return data.replace(b"\xff\0", b"\xff")


def _frame_body(body: bytes, version: int, flags: int) -> bytes:
    """A tag frame's content: grouping, length, unsynchronisation and compression undone; empty if it is encrypted or broken."""
    if version == 4:
        group, packed, secret, spread, sized = flags & 0x40, flags & 8, flags & 4, flags & 2, flags & 1
    else:
        group, packed, secret, spread, sized = flags & 0x20, flags & 0x80, flags & 0x40, 0, flags & 0x80
    if secret:
        return b""
    body = body[(1 if group else 0) + (4 if sized else 0) :]
    body = _whole(body) if spread else body
    if not packed:
        return body
    try:
        return zlib.decompressobj().decompress(body, 1 << 20)
    except zlib.error:
        return b""


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """The text frames of an ID3v2.2, 2.3 or 2.4 tag, and where the tag (and its footer) ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    version, flags, size = data[3], data[5], _unsyncsafe(data[6:10])
    end, body = 10 + size + (10 if version == 4 and flags & 0x10 else 0), data[10 : 10 + size]
    if version not in (2, 3, 4) or version == 2 and flags & 0x40:
        return {}, end
    if flags & 0x80 and version < 4:
        body = _whole(body)
    at, out = 0, {}
    if flags & 0x40:
        at = _unsyncsafe(body[:4].ljust(4, b"\0")) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    letters, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at]:
        name = body[at : at + letters].decode("latin-1")
        raw = body[at + letters : at + 2 * letters]
        length = _unsyncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        content = body[at + head : at + head + length]
        if version > 2:
            marks = body[at + 9] | (2 if version == 4 and flags & 0x80 else 0)
            content = _frame_body(content, version, marks)
        if name[0] == "T" and content:
            key, _, value = content[1:].decode(ENCODINGS.get(content[0], "latin-1"), "replace").partition("\0")
            own = name in ("TXXX", "TXX")
            out[f"{name}:{key}" if own else name] = value.lstrip("\ufeff") if own else key
        at += head + length
    return out, end


def _follows(data: bytes, at: int, end: int) -> Header | None:
    """The header at ``at`` if its frame ends at another header or at ``end``."""
    head = parse_header(data, at)
    if head and at + head.length <= end and (at + head.length == end or parse_header(data, at + head.length)):
        return head
    return None


def _sync(data: bytes, at: int, end: int) -> int:
    """The next place from ``at`` with a header that _follows() accepts; -1: none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        if _follows(data, at, end):
            return at
        at += 1
    return -1


def read_stream(data: bytes) -> Stream:
    """Frames, tags, tables and checks of any bytes.

    A frame that begins where the one before it ends needs its header only; the
    first one, and one behind bytes that are no frame, need a successor too.
    """
    out = Stream()
    out.tags, at = _tags(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    joined = False
    while at < end:
        head = parse_header(data, at) if joined else _follows(data, at, end)
        if head is None or at + head.length > end:
            at, joined = _sync(data, at + 1, end), False
            out.resyncs += 1
            if at < 0:
                break
            continue
        if not out.offsets:
            out.has_table = _table(data, at, head, out)
        out.offsets.append(at)
        out.headers.append(head)
        at, joined = at + head.length, True
    out.crc_errors = _check(data, out)
    return out


def _table(data: bytes, at: int, head: Header, out: Stream) -> bool:
    """Read a Xing, Info or VBRI table from the first frame."""
    inside = data[at : at + head.length]
    start = 4 + 2 * head.protected + head.side
    if inside[start : start + 4] in (b"Xing", b"Info"):
        flags, start = int.from_bytes(inside[start + 4 : start + 8], "big"), start + 8
        if flags & 1:
            out.table_frames, start = int.from_bytes(inside[start : start + 4], "big"), start + 4
        if flags & 2:
            out.table_bytes, start = int.from_bytes(inside[start : start + 4], "big"), start + 4
        if flags & 4:
            out.seek_table = inside[start : start + 100]
        return True
    if inside[36:40] != b"VBRI" or len(inside) < 62:  # always 32 bytes behind the header
        return False
    out.table_bytes, out.table_frames = int.from_bytes(inside[46:50], "big"), int.from_bytes(inside[50:54], "big")
    entries, scale, width, out.frames_per_entry = (int.from_bytes(inside[k : k + 2], "big") for k in (54, 56, 58, 60))
    table = inside[62 : 62 + entries * width]
    out.entry_bytes = [scale * int.from_bytes(table[k : k + width], "big") for k in range(0, len(table) - width + 1, width)] if width else []
    return True


def _check(data: bytes, out: Stream) -> int:
    """How many protected frames don't have the checksum that they say."""
    bad, raw = 0, np.frombuffer(data, dtype=np.uint8)
    for side in {h.side for h in out.headers if h.protected}:
        at = np.array([o for o, h in zip(out.offsets, out.headers, strict=True) if h.protected and h.side == side])
        covered = np.concatenate([raw[at[:, None] + [2, 3]], raw[at[:, None] + 6 + np.arange(side)]], axis=1)
        bad += int((crc16(covered) != raw[at + 4] * np.uint32(256) + raw[at + 5]).sum())
    return bad


def _frame_sizes(n: int) -> Iterator[int]:
    """Bit-rate indexes of the frames that hold ``n`` bytes: the largest, then the smallest that does."""
    room = [144 * r * 1000 // RATE - OVERHEAD for r in BITRATES_1]
    while n > room[14]:
        yield 14
        n -= room[14]
    yield next(i for i in range(1, 15) if room[i] >= n)


def write_stream(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """A mono Layer III stream at 32 kHz whose frames carry ``payload``; its length is in the tag."""
    indexes = list(_frame_sizes(len(payload)))
    lengths = [144 * BITRATES_1[i] * 1000 // RATE for i in indexes]
    out = np.zeros(sum(lengths), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    heads = np.array([[0xFF, 0xFA, i << 4 | 8, 0xC0] for i in indexes], dtype=np.uint8)
    out[starts[:, None] + np.arange(4)] = heads
    check = crc16(np.concatenate([heads[:, 2:], np.zeros((len(heads), MONO_SIDE), np.uint8)], axis=1))
    out[starts + 4], out[starts + 5] = check >> 8, check & 255
    source, at = np.frombuffer(payload, dtype=np.uint8), 0
    for start, length in zip(starts.tolist(), lengths, strict=True):
        take = min(length - OVERHEAD, len(payload) - at)
        out[start + OVERHEAD : start + OVERHEAD + take] = source[at : at + take]
        at += take
    total = int(out.size)
    toc = bytes(min(255, int(starts[len(starts) * k // 100]) * 256 // total) for k in range(100))
    lead = 144 * 64 * 1000 // RATE
    head = bytes([0xFF, 0xFA, 5 << 4 | 8, 0xC0])
    table = head + crc16(np.frombuffer(head[2:] + bytes(MONO_SIDE), np.uint8)[None]).astype(">u2").tobytes() + bytes(MONO_SIDE)
    table += b"Xing" + (7).to_bytes(4, "big") + len(indexes).to_bytes(4, "big") + (total + lead).to_bytes(4, "big") + toc
    texts = {"payload": str(len(payload))} | (tags or {})
    frames = b"".join(_text_frame(k, v) for k, v in texts.items())
    return b"ID3\x04\0\0" + _syncsafe(len(frames)) + frames + table.ljust(lead, b"\0") + out.tobytes()


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that the frames of ``write_stream`` carry."""
    parts = (
        data[stream.offsets[i] + 4 + 2 * h.protected + h.side : stream.offsets[i] + h.length]
        for i in stream.audio
        for h in [stream.headers[i]]
    )
    return b"".join(parts)[: int(stream.tags.get("TXXX:payload", 0))]


def feature(stream: Stream) -> str:
    """Exact duration, rates, table and checks of a stream, and a digest of its seek offsets, as one text."""
    samples = stream.samples() or {RATE: 0}
    rates = sorted({h.bitrate for h in (stream.headers[i] for i in stream.audio)})
    seek = np.array([stream.offsets[i] for i in stream.audio], dtype="<u8")
    agree = stream.table_frames == len(stream.audio)
    return (
        f"frames={len(stream.audio)};samples={'+'.join(map(str, samples.values()))};rate={'+'.join(map(str, samples))};kbps={rates[0] if rates else 0}-{rates[-1] if rates else 0};"
        f"table={'agrees' if agree else 'differs'};crc_errors={stream.crc_errors};resyncs={stream.resyncs};"
        f"first={int(seek[0]) if len(seek) else 0};last={int(seek[-1]) if len(seek) else 0};seek_crc={zlib.crc32(seek.tobytes())}"
    )


def encode_texts(docs: DataFrame, unit: int = 64) -> DataFrame:
    """Whole texts as streams: UTF-8, zero bytes up to a positive multiple of ``unit``, then ``write_stream``.

    The unpadded length is in the tag too. A null text is empty, so one unit of zeros.
    """

    def make(batches):
        for b in batches:
            raw = [x.encode("utf-8") if x else b"" for x in b["text"]]
            media = [
                write_stream(x.ljust(max(unit, -(-len(x) // unit) * unit), b"\0"), {"bytes": str(len(x))}) for x in raw
            ]
            sizes = [len(x) for x in raw]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": sizes, "media": pd.Series(media, dtype=object)})

    return docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(make, MEDIA_SCHEMA)


READ_SCHEMA = (
    "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, duration_num long, duration_den long, seek_offsets array<long>"
)


def read_media(media: DataFrame, every: int = 1) -> DataFrame:
    """Parse stored streams: payload digests, exact duration, feature, and the offsets of all frames, or of every ``every``-th."""

    def parse(batches):
        for b in batches:
            out = []
            for doc_id, data in zip(b["doc_id"], b["media"], strict=True):
                data = bytes(data)
                stream = read_stream(data)
                payload = payload_of(data, stream)
                seconds = stream.duration
                out.append(
                    (doc_id, int(stream.tags.get("TXXX:bytes", 0)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(stream), seconds.numerator, seconds.denominator, [stream.offsets[i] for i in stream.audio[::every]])
                )
            yield pd.DataFrame(out, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return media.select("doc_id", "media").mapInPandas(parse, READ_SCHEMA)


def store_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The media contract: write every text as a media column, read the stored bytes back, and describe them.

    Equal texts give equal values. Repeated rows give a row each, a null doc_id stays null, no documents no rows.
    """
    spark = docs.sparkSession
    place = path or scratch_path(spark, "media")
    encode_texts(docs).write.option("compression", "zstd").parquet(place)
    found = read_media(spark.read.schema(MEDIA_SCHEMA).parquet(place))
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(
        "duration_s", F.col("duration_num") / F.col("duration_den")
    )
