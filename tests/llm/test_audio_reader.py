"""The reader on streams that its own writer doesn't make, and the stored form against one made here bit by bit."""

import hashlib
import random
import struct
import zlib
from fractions import Fraction

from foliant.llm import audio

from .conftest import documents


def frame(rate=0, index=9, fill=b"", protected=False, mono=False):
    """An MPEG-1 Layer III frame: rate 0 to 2 is 44.1, 48 and 32 kHz; index 9 is 128 kbit/s."""
    hz, kbps = (44100, 48000, 32000)[rate], audio.BITRATES_1[index]
    head = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | rate << 2, 0xC0 if mono else 0])
    return (head + fill).ljust(144 * kbps * 1000 // hz, b"\0")


def test_the_first_frame_needs_a_successor():
    junk = frame()[:4] + b"j" * 20
    stream = audio.read_stream(junk + frame() * 2)
    assert stream.offsets == [24, 24 + len(frame())] and stream.resyncs == 1
    assert audio.read_stream(frame()[:4] + b"x" * 5000).offsets == []
    assert audio.read_stream(frame()).offsets == [0]
    alone = audio.read_stream(frame() * 3 + b"tail" * 9)
    assert len(alone.offsets) == 3 and alone.resyncs == 1


def test_rates_may_change():
    stream = audio.read_stream(frame(0) * 3 + frame(1) * 3)
    assert len(stream.offsets) == 6 and stream.samples() == {44100: 3456, 48000: 3456}
    assert stream.duration == Fraction(3456, 44100) + Fraction(3456, 48000)
    assert "samples=3456+3456;rate=44100+48000;" in audio.feature(stream)
    assert [stream.seek(n) for n in (0, 1151, 1152, 6911, 10**9)] == [0, 0, *stream.offsets[1:2], *stream.offsets[5:] * 2]


def text_frame(name, body, flags=b"\0\0", syncsafe=True):
    size = audio._syncsafe(len(body)) if syncsafe else len(body).to_bytes(4, "big")
    return name + size + flags + body


def tag(version, frames, flags=0, footer=b""):
    return b"ID3" + bytes([version, 0, flags]) + audio._syncsafe(len(frames)) + frames + footer


def test_tags_of_all_versions():
    sound = frame() * 2
    for made, want in (
        (tag(2, b"TT2\0\0\x05\0Song"), {"TT2": "Song"}),
        (tag(2, b"TXX\0\0\x08\0key\0val"), {"TXX:key": "val"}),
        (tag(3, text_frame(b"TIT2", b"\0Song", syncsafe=False)), {"TIT2": "Song"}),
        (tag(3, text_frame(b"TIT2", b"\x01\xff\xfeS\0o\0", syncsafe=False).replace(b"\xff", b"\xff\0"), 0x80), {"TIT2": "So"}),
        (tag(3, (6).to_bytes(4, "big") + bytes(6) + text_frame(b"TIT2", b"\0Song", syncsafe=False), 0x40), {"TIT2": "Song"}),
        (tag(3, text_frame(b"TIT2", (5).to_bytes(4, "big") + zlib.compress(b"\0Song"), b"\0\x80", syncsafe=False)), {"TIT2": "Song"}),
        (tag(4, text_frame(b"TIT2", b"\x03S\xc3\xb6ng")), {"TIT2": "Söng"}),
        (tag(4, audio._syncsafe(6) + b"\x01\0" + text_frame(b"TIT2", b"\x03Song"), 0x40), {"TIT2": "Song"}),
        (tag(4, text_frame(b"TIT2", b"\x01\xff\0\xfeS\0o\0", b"\0\x02"), 0x80), {"TIT2": "So"}),
        (tag(4, text_frame(b"TIT2", audio._syncsafe(5) + b"\x03Song", b"\0\x01"), 0x10, b"3DI\x04\0\x10" + bytes(4)), {"TIT2": "Song"}),
        (tag(4, text_frame(b"TIT2", b"\x09Song")), {"TIT2": "Song"}),
        (tag(4, text_frame(b"TIT2", b"secret", b"\0\x04")), {}),
        (tag(9, b"whatever"), {}),
    ):
        stream = audio.read_stream(made + sound)
        assert stream.tags == want and stream.offsets == [len(made), len(made) + len(frame())] and not stream.resyncs, made


def test_vbri_table():
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4321, 6, 3, 2, 2, 2) + struct.pack(">HHH", 10, 20, 30)
    stream = audio.read_stream(frame(fill=bytes(32) + table) + frame(index=5) * 6)
    assert stream.has_table and (stream.table_frames, stream.table_bytes) == (6, 4321) and len(stream.audio) == 6
    assert stream.entry_bytes == [20, 40, 60] and stream.frames_per_entry == 2
    assert "table=agrees" in audio.feature(stream)


def test_any_bytes_are_read():
    rng = random.Random(1)
    whole = audio.write_stream(bytes(rng.randrange(256) for _ in range(3000)), {"a": "b"})
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        cut = rng.randrange(len(data))
        stream = audio.read_stream(bytes(data[: cut if rng.random() < 0.5 else None]))
        assert len(stream.offsets) == len(stream.headers) and stream.duration >= 0
        audio.feature(stream)
    for n in (0, 1, 3, 9, 10, 50, 2000):
        audio.read_stream(b"ID3" + bytes(rng.randrange(256) for _ in range(n)))
        audio.read_stream(b"\xff" * n)


def bits_crc(data):
    value = 0xFFFF
    for byte in data:
        for k in range(7, -1, -1):
            value = (value << 1 & 0xFFFF) ^ (0x8005 if value >> 15 ^ (byte >> k & 1) else 0)
    return value


def plain_stream(payload, size):
    """The stored form as the module states it: 32 kHz mono, 23 bytes a frame that aren't payload, largest frames first."""
    rates = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    room = {k: r * 1000 * 144 // 32000 - 23 for k, r in enumerate(rates, 1)}

    def one(index, body):
        head = bytes([0xFF, 0xFA, index << 4 | 8, 0xC0])
        return head + bits_crc(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) + body.ljust(room[index], b"\0")

    frames, rest = [], payload
    while len(rest) > room[14]:
        frames.append(one(14, rest[: room[14]]))
        rest = rest[room[14] :]
    frames.append(one(min(k for k in room if room[k] >= len(rest)), rest))
    sound, starts, at = b"".join(frames), [], 0
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(min(255, starts[len(starts) * k // 100] * 256 // len(sound)) for k in range(100))
    lead = one(5, b"Xing" + struct.pack(">III", 7, len(frames), len(sound) + 288) + toc)
    texts = b""
    for key, value in (("payload", len(payload)), ("bytes", size)):
        body = b"\x03" + key.encode() + b"\0" + str(value).encode()
        texts += b"TXXX" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + b"\0\0" + body
    tagged = b"ID3\x04\0\0" + bytes([0, 0, len(texts) >> 7, len(texts) & 127]) + texts
    offsets = [len(tagged) + len(lead) + s for s in starts]
    kbps = sorted({rates[(f[2] >> 4) - 1] for f in frames})
    crc = zlib.crc32(b"".join(struct.pack("<Q", o) for o in offsets))
    words = f"frames={len(frames)};samples={1152 * len(frames)};rate=32000;kbps={kbps[0]}-{kbps[-1]};table=agrees;crc_errors=0;resyncs=0;first={offsets[0]};last={offsets[-1]};seek_crc={crc}"
    return tagged + lead + sound, words, Fraction(1152 * len(frames), 32000)


def test_the_stored_form_against_one_made_bit_by_bit(spark):
    rng = random.Random(2)
    texts = [None, "", "short", "x" * 64, "é" * 700, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(9000)), "long words " * 20_000]
    rows = {r.doc_id: r for r in audio.store_texts(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        media, words, seconds = plain_stream(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw))
        r = rows[i]
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), words)
        assert Fraction(r.duration_num, r.duration_den) == seconds and r.duration_s == float(seconds)
