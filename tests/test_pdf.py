import random
import zlib

import pytest

from foliant.sources import pdf


def test_a_round_trip():
    pages = ["one\ntwo  words\n\nend", "", "ünï \U0001f600 東京\t\r(x) \\ <y>", "\n\n", "a" * 50_000]
    assert pdf.page_texts(pdf.write_pdf(pages)) == [(i, t, None) for i, t in enumerate(pages, 1)]
    assert pdf.page_texts(pdf.write_pdf([])) == []
    assert pdf.page_texts(pdf.write_pdf(["a", "b", "c"], frozenset({2}))) == [(1, "a", None), (2, "", "broken stream"), (3, "c", None)]


def made(objects, root=1, extra=b""):
    """A file without any cross-reference."""
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + extra + b"trailer <</Root %d 0 R>>" % root


def stream(data, head=b""):
    return b"<</Length %d%s>> stream\r\n%s\nendstream" % (len(data), head, data)


BASE = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</A 6 0 R/B 7 0 R>>>>>>", 3: b"<</Type/Page/Contents[4 0 R 5 0 R]>>"}


def test_text_operators_fonts_and_filters():
    one = rb"BT /A 12 Tf 10 700 Td (Hello \(wor\154d\)) Tj 0 -14 Td [(sp) -300 (lit) -20 (ted)] TJ T* (caf\351) Tj"
    two = rb"(next) ' 1 2 (third) " + b'" 5 0 Td (right) Tj 1 0 0 1 0 0 Tm (far) Tj /B 9 Tf <0102> Tj ET'
    table = b"2 beginbfchar <01> <0041> <03> <D83DDE00> endbfchar 1 beginbfrange <02> <02> [<00420043>] endbfrange"
    objects = BASE | {4: stream(zlib.compress(one), b"/Filter[/FlateDecode]"), 5: stream(two.hex().encode() + b">", b"/Filter/ASCIIHexDecode"), 6: b"<</Type/Font/Subtype/Type1>>", 7: b"<</Type/Font/ToUnicode 8 0 R>>", 8: stream(table)}
    assert pdf.page_texts(made(objects)) == [(1, "Hello (world)\nsp litted\ncafé\nnext\nthird right\nfarABC", None)]


def test_object_streams_and_compressed_cross_references():
    inner = {1: BASE[1], 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R>>"}
    bodies, offsets = b" ".join(inner.values()), []
    for body in inner.values():
        offsets.append(sum(len(b) + 1 for b in list(inner.values())[: len(offsets)]))
    head = b" ".join(b"%d %d" % (n, o) for n, o in zip(inner, offsets, strict=True)) + b" "
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n" + stream(b"BT (inside) Tj ET") + b"\nendobj\n"
    at5 = len(out)
    out += b"5 0 obj\n" + stream(zlib.compress(head + bodies), b"/Type/ObjStm/N 3/First %d/Filter/FlateDecode" % len(head)) + b"\nendobj\n"
    at6 = len(out)
    rows = [(0, 0, 0), (2, 5, 0), (2, 5, 1), (2, 5, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    raw, above, packed = [bytes([k]) + v.to_bytes(2, "big") + bytes([p]) for k, v, p in rows], bytes(4), b""
    for row in raw:
        packed += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    whole = out + b"6 0 obj\n" + stream(zlib.compress(packed), b"/Type/XRef/Size 7/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>") + b"\nendobj\n"
    for data in (whole + b"startxref\n%d\n%%%%EOF" % at6, whole + b"startxref\n7\n%%EOF", whole):
        assert pdf.page_texts(data) == [(1, "inside", None)]


@pytest.mark.parametrize("data, error", [(None, "no root"), (b"", "no root"), (b"no pdf at all", "no root"), (made(BASE, extra=b"trailer <</Encrypt 9 0 R>>"), "encrypted")])
def test_files_that_cannot_be_read(data, error):
    assert pdf.page_texts(data) == [(0, "", error)]


def test_pages_have_errors_of_their_own():
    kids = BASE | {2: b"<</Type/Pages/Kids[3 0 R 9 0 R 2 0 R 10 0 R]>>", 4: stream(b"BT (fine) Tj ET"), 5: stream(b""), 10: b"<</Type/Page/Contents 11 0 R>>", 11: stream(b"x", b"/Filter/DCTDecode")}
    assert pdf.page_texts(made(kids)) == [(1, "fine", None), (2, "", "no page"), (3, "", "filter DCTDecode")]


def test_damaged_bytes_never_crash():
    rng = random.Random(5)
    whole = pdf.write_pdf(["some text\nof two lines", "and a second page"])
    for _ in range(500):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 20)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        pdf.page_texts(bytes(data[: rng.randrange(len(data))] if rng.random() < 0.3 else data))
    assert pdf.page_texts(b"[" * 5000 + whole)[-1][2] is None


def test_files_as_rows(spark):
    files = spark.createDataFrame([("a", bytearray(pdf.write_pdf(["x", "y"]))), ("b", None), ("c", bytearray(pdf.write_pdf([])))], "file string, content binary")
    found = sorted(map(tuple, pdf.read_pages(files).collect()))
    assert found == [("a", 1, "x", None), ("a", 2, "y", None), ("b", 0, "", "no root")]


def test_a_map_is_read_once(monkeypatch):
    calls, mapped = [], pdf._mapped
    monkeypatch.setattr(pdf, "_mapped", lambda *a: calls.append(a) or mapped(*a))
    pdf._known_map.cache_clear()
    for k in range(3):
        assert [r[1:] for r in pdf.page_texts(pdf.write_pdf(["añ\U0001F600", "b", f"c{k}"]))] == [("añ\U0001F600", None), ("b", None), (f"c{k}", None)]
    assert len(calls) == 1


def test_hexadecimal_strings_and_maps_with_odd_codes():
    for raw, value in ((b"<4 1\n42>", b"AB"), (b"<414>", b"A@"), (b"<4x1\xff42>", b"AB"), (b"<>", b"")):
        assert pdf.parse(raw, 0) == (value, len(raw))
    table = b"1 beginbfchar <0001> <00410042> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    assert pdf._mapped(table, 2)(b"\0\1\0\x11\0\x20\x10") == "ABb\ufffda"
    assert pdf._mapped(table, 1)(b"\1\x12") == "ABc"
