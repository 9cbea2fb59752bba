import hashlib
import zlib
from fractions import Fraction

import pytest

from foliant.llm import archives, audio

from .conftest import documents

PAGES = [
    (3, "http://a/1", "<p>one</p>"), (1, "http://a/2", "<p>one</p>"), (2, None, None), (5, "http://b c/3", ""),
    (7, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 50), (8, "http://e", "x" * 300_000), (None, "http://f", "<p>one</p>"), (9, "http://g", "\n"),
    (9, "http://g", "\n"),
]


def test_arc_versions_round_trip():
    for version in (1, 2):
        data = archives.write_arc(version, "n.arc", "20010203040506", [("http://x y", "text/html", b"abc\n\n"), ("u", "t", b"")])
        found = list(archives.read_arc(data))
        assert [(r.url, r.body, r.version) for r in found] == [("http://xy", b"abc\n\n", version), ("u", b"", version)]
        assert found[0].status == (200 if version == 2 else None)
    assert archives.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError, match="cut short"):
        list(archives.read_arc(archives.write_arc(1, "n.arc", "20010203040506", [("u", "t", b"abcdef")])[:-3]))


def test_pages_read_back(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, sha string")
    rows = archives.archive_pages(pages).collect()
    assert len(rows) == len(PAGES) and all(r.digest_verified for r in rows)
    for r in rows:
        html = next((h or "").encode() for i, _, h in PAGES if i == r.page_id)
        same = [i for i, _, h in PAGES if (h or "").encode() == html and i is not None]
        assert (r.payload_bytes, r.payload_digest) == (len(html), archives.digest(html))
        first = r.page_id is None or r.page_id == min(same)
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", min(same)))


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = archives.archive_pages(pages, min_bytes=11).collect()
    assert {r.record_type for r in rows} == {"response"}
    assert archives.archive_pages(pages.limit(0)).collect() == []


def test_stream_round_trip_and_damage():
    for n in (0, 1, 64, 1417, 1418, 100_000):
        payload = bytes(i * 7 % 256 for i in range(n))
        data = audio.write_stream(payload)
        stream = audio.read_stream(data)
        assert audio.payload_of(data, stream) == payload
        assert stream.table_frames == len(stream.audio) and stream.crc_errors == 0 and stream.resyncs == 0
        assert stream.table_bytes == len(data) - audio._tags(data)[1]
        assert stream.duration == Fraction(len(stream.audio) * 1152, 32000)
    assert stream.seek(5 * 1152) == stream.offsets[6]
    hurt = bytearray(data)
    hurt[stream.offsets[5] : stream.offsets[5] + 4] = b"junk"
    hurt[stream.offsets[9] + 10] ^= 1
    again = audio.read_stream(bytes(hurt))
    assert again.resyncs == 1 and again.crc_errors == 1 and len(again.offsets) == len(stream.offsets) - 1
    assert audio.read_stream(b"no audio \xff\xfa at all").offsets == []


def test_crc16_against_bits():
    row = bytes(range(19))
    value = 0xFFFF
    for byte in row:
        for k in range(7, -1, -1):
            high = value >> 15 ^ (byte >> k & 1)
            value = (value << 1 & 0xFFFF) ^ (0x8005 if high else 0)
    import numpy as np

    assert audio.crc16(np.frombuffer(row, np.uint8)[None])[0] == value


def test_texts_as_media(edge_docs, no_docs):
    rows = audio.store_texts(edge_docs).collect()
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    assert len(rows) == edge_docs.count()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (5, 6)}) == 1
    assert audio.store_texts(no_docs).collect() == []


def test_every_frame_can_be_sought(spark):
    media = audio.encode_texts(documents(spark, [(1, "some words " * 2000, "en"), (2, None, None)])).cache()
    streams = {r.doc_id: audio.read_stream(bytes(r.media)) for r in media.collect()}
    found = {r.doc_id: r.seek_offsets for r in audio.read_media(media).collect()}
    assert found == {i: [s.offsets[k] for k in s.audio] for i, s in streams.items()}
    assert len(found["1"]) > 10


def test_warc_is_read_a_piece_at_a_time(monkeypatch):
    import gzip

    blocks = [b"x" * n for n in (0, 1, 7, 5000, 300, 0)]
    records = [b"WARC/1.1\r\nContent-Length: %d\r\nA: %d\r\n\r\n" % (len(x), k) + x + b"\r\n\r\n" for k, x in enumerate(blocks)]
    whole = b"".join(records)
    several = b"".join(gzip.compress(r) for r in records)
    small = archives._inflated
    for step in (1, 13, 1 << 20):
        monkeypatch.setattr(archives, "_inflated", lambda content, step=step: small(content, step))
        for content in (whole, gzip.compress(whole), several):
            assert [(f["a"], b) for f, b in archives.read_warc(content)] == [(str(k), x) for k, x in enumerate(blocks)]
        for broken in (whole[:-1], b"x" + whole, gzip.compress(whole)[:-20]):
            with pytest.raises(ValueError):
                list(archives.read_warc(broken))
