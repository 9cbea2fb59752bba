"""Page text out of PDF bytes, and pages into PDF bytes; both run in Arrow tasks, a file at a time.

Read are classic and compressed cross-references (and, where they are broken,
the objects themselves), object streams, Flate and hexadecimal filters, page
trees, and the text operators, with a font's ToUnicode map. A page that can't be
read has an error and no text; the others of its file are not touched. What is
not read: encrypted files, pictures, and the layout of columns.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

PAGES = "file {file}, page_number int, text string, error string"
#: A page's streams are unpacked to so many bytes at most; beyond, the page is an error and no memory is at risk.
MOST_BYTES = 1 << 28
#: Maps of codes to text that are no longer than this are remembered from file to file.
KNOWN_BYTES = 1 << 16

_SPACE = b"\0\t\n\f\r "
_TOKEN = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")
_NO_DIGIT = re.compile(rb"[^0-9A-Fa-f]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Damaged(Exception):
    """What can't be read, in a few words."""


class Ref(int):
    """The number of an object."""


class Name(str):
    """A name, without its slash."""


class Word(str):
    """An operator or keyword."""


class Stream:
    def __init__(self, head: dict, raw: bytes):
        self.head, self.raw = head, raw


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins at ``at``."""
    out, depth = bytearray(), 0
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            else:
                e = data[at : at + 1]
                at += 1
                if e == b"\r" and data[at : at + 1] == b"\n":
                    at += 1
                out += b"" if e in (b"\r", b"\n") else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at
        if depth > 1 or c != b"(":
            out += c
    raise Damaged("open string")


def parse(data: bytes, at: int) -> tuple[object, int]:
    """The value at ``at`` and where it ends; None at the end of the data."""
    at = _SKIP.match(data, at).end()
    if at >= len(data):
        return None, at
    two, one = data[at : at + 2], data[at : at + 1]
    if two == b"<<" or one == b"[":
        close, items, at = (b">>", [], at + 2) if two == b"<<" else (b"]", [], at + 1)
        while True:
            at = _SKIP.match(data, at).end()
            if data.startswith(close, at):
                break
            value, at = parse(data, at)
            if value is None and at >= len(data):
                raise Damaged("open list")
            if isinstance(value, Word) and value == "R" and len(items) > 1 and all(isinstance(x, int) for x in items[-2:]):
                value, items = Ref(items[-2]), items[:-2]
            items.append(value)
        at += len(close)
        return (dict(zip(items[::2], items[1::2], strict=False)) if close == b">>" else items), at
    if one == b"(":
        return _string(data, at)
    if one == b"<":
        end = data.find(b">", at)
        if end < 0:
            raise Damaged("open string")
        digits = data[at + 1 : end]
        try:
            return bytes.fromhex(digits.decode()), end + 1
        except ValueError:  # an odd number of digits, or what isn't one
            digits = _NO_DIGIT.sub(b"", digits)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if one == b"/":
        found = _TOKEN.match(data, at + 1)
        name = found[0] if found else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), name).decode("latin-1")), at + 1 + len(name)
    found = _TOKEN.match(data, at)
    if not found:
        return Word(one.decode("latin-1")), at + 1
    text = found[0].decode("latin-1")
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text), found.end()
    if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+)", text):
        return float(text), found.end()
    return {"true": True, "false": False}.get(text, Word(text)), found.end()


class Document:
    """The objects of a file by number, read when they are asked for."""

    def __init__(self, data: bytes):
        self._data, self._known = data, {}
        self._maps: dict[tuple[int, int], object] = {}  # decoders by ToUnicode stream and width of codes
        self._at: dict[int, int] = {}  # byte offsets
        self._inside: dict[int, tuple[int, int]] = {}  # object stream and place there
        self.trailer: dict = {}
        try:
            self._cross_references()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise Damaged("no root")
        except (Damaged, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError, zlib.error):
            self._scan()
        if "Encrypt" in self.trailer:
            raise Damaged("encrypted")

    def _cross_references(self) -> None:
        starts = re.findall(rb"startxref\s+(\d+)", self._data[-2048:])
        at, seen = int(starts[-1]), set()
        while at is not None and at not in seen:
            seen.add(at)
            head = self._table(at) if self._data[at : at + 4] == b"xref" else self._reference_stream(at)
            self.trailer = head | self.trailer
            at = head.get("Prev")

    def _table(self, at: int) -> dict:
        at += 4
        while True:
            first, at = parse(self._data, at)
            if first == "trailer":
                return parse(self._data, at)[0]
            count, at = parse(self._data, at)
            if not isinstance(first, int) or not isinstance(count, int) or count < 0:
                raise Damaged("broken table")
            for k in range(count):
                offset, at = parse(self._data, at)
                _, at = parse(self._data, at)
                state, at = parse(self._data, at)
                if state == "n":
                    self._at.setdefault(first + k, offset)

    def _reference_stream(self, at: int) -> dict:
        stream = self._object(at, None)
        head, rows = stream.head, self.unpacked(stream)
        widths = head["W"]
        index = head.get("Index", [0, head["Size"]])
        step, place = sum(widths), 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for k in range(first, first + min(count, len(rows) // step)):
                cells, p = [], place
                for w in widths:
                    cells.append(int.from_bytes(rows[p : p + w], "big") if w else 1)
                    p += w
                place += step
                if cells[0] == 1 and k not in self._inside:
                    self._at.setdefault(k, cells[1])
                elif cells[0] == 2 and k not in self._at:
                    self._inside.setdefault(k, (cells[1], cells[2]))
        return head

    def _scan(self) -> None:
        """Where no table helps: every object that stands in the file; of one number the last."""
        self._known, self._inside = {}, {}
        self._at = {int(m[1]): m.start() for m in _OBJECT.finditer(self._data)}
        for m in re.finditer(rb"trailer", self._data):
            try:
                head = parse(self._data, m.end())[0]
                self.trailer |= head if isinstance(head, dict) else {}
            except Damaged:
                continue
        for number in list(self._at):
            try:
                value = self.get(Ref(number))
            except Damaged:
                continue
            if isinstance(value, Stream) and value.head.get("Type") == "ObjStm":
                for place, inner in enumerate(self._numbers(value)):
                    if inner not in self._at:
                        self._inside[inner] = (number, place)
            kind = value.get("Type") if isinstance(value, dict) else value.head.get("Type") if isinstance(value, Stream) else None
            if kind == "Catalog":
                self.trailer["Root"] = Ref(number)
            if kind == "XRef":
                self.trailer = {k: v for k, v in value.head.items() if k in ("Root", "Encrypt")} | self.trailer
        for number in list(self._inside):
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(number)

    def get(self, value):
        """What a reference points to; other values are themselves."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self._read(value)
        raise Damaged("endless reference")

    def _read(self, number: int):
        if number not in self._known:
            if number in self._at:
                self._known[number] = self._object(self._at[number], number)
            elif number in self._inside:
                holder, place = self._inside[number]
                stream = self.get(Ref(holder))
                if not isinstance(stream, Stream) or holder in self._inside:
                    raise Damaged("broken object stream")
                body = self.unpacked(stream)
                offsets = self._numbers(stream, 1)
                self._known[number] = parse(body, self.get(stream.head.get("First")) + offsets[place])[0] if place < len(offsets) else None
            else:
                self._known[number] = None
        return self._known[number]

    def _numbers(self, stream: Stream, which: int = 0) -> list[int]:
        first = self.get(stream.head.get("First"))
        return [int(x) for x in self.unpacked(stream)[:first].split()][which::2]

    def _object(self, at: int, number: int | None):
        found = _OBJECT.match(self._data, _SKIP.match(self._data, at).end())
        if not found or number is not None and int(found[1]) != number:
            raise Damaged("object not in its place")
        value, at = parse(self._data, found.end())
        word, after = parse(self._data, at)
        if word == "stream" and isinstance(value, dict):
            start = after + (2 if self._data[after : after + 2] == b"\r\n" else 1)
            length = self.get(value.get("Length")) if not isinstance(value.get("Length"), Ref) or self._at else None
            if not isinstance(length, int) or not self._data[start + length : start + length + 20].lstrip(_SPACE).startswith(b"endstream"):
                end = self._data.find(b"endstream", start)
                length = (len(self._data) if end < 0 else end) - start
            return Stream(value, self._data[start : start + length])
        return value

    def unpacked(self, stream: Stream) -> bytes:
        """A stream's bytes without its filters."""
        filters, settings = (self.get(stream.head.get(k)) for k in ("Filter", "DecodeParms"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        settings = settings if isinstance(settings, list) else [settings]
        data = stream.raw
        for i, name in enumerate(self.get(f) for f in filters):
            setting = self.get(settings[i]) if i < len(settings) else None
            if name in ("FlateDecode", "Fl"):
                unpack = zlib.decompressobj()
                try:
                    data = unpack.decompress(data, MOST_BYTES)
                except zlib.error:
                    raise Damaged("broken stream") from None
                if unpack.unconsumed_tail or not unpack.eof:
                    raise Damaged("stream too long" if unpack.unconsumed_tail else "broken stream")
                data = _unpredicted(data, setting) if isinstance(setting, dict) else data
            elif name in ("ASCIIHexDecode", "AHx"):
                data = parse(b"<" + data.split(b">")[0] + b">", 0)[0]
            else:
                raise Damaged(f"filter {name}")
        return data

    def pages(self) -> list[dict | None]:
        """The pages in order, with what they inherit; None for a kid that isn't there."""
        out: list[dict | None] = []
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict):
            raise Damaged("no root")
        stack, seen = [(root.get("Pages"), {})], set()
        while stack:
            ref, above = stack.pop()
            if isinstance(ref, Ref) and ref in seen:
                continue
            seen.add(ref) if isinstance(ref, Ref) else None
            try:
                node = self.get(ref)
            except Damaged:
                node = None
            if not isinstance(node, dict):
                out.append(None)
                continue
            node = {k: v for k, v in above.items() if k == "Resources"} | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(kid, node) for kid in reversed(kids)]
            else:
                out.append(node)
        return out

    def text(self, page: dict) -> str:
        """What the text operators of a page show, a line for each new height."""
        contents = self.get(page.get("Contents"))
        streams = [self.get(c) for c in (contents if isinstance(contents, list) else [contents])]
        data = b"\n".join(self.unpacked(s) for s in streams if isinstance(s, Stream))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps, decode, out, held, at = {}, _latin, [], [], 0
        while True:
            value, at = parse(data, at)
            if value is None:
                return "".join(out)
            if not isinstance(value, Word):
                held.append(value)
                continue
            if value == "Tf" and len(held) > 1:
                name = held[-2]
                if name not in maps:
                    maps[name] = self._decoder(self.get(fonts.get(name)))
                decode = maps[name]
            elif value in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
                out += ([] if value == "Tj" else ["\n"]) + [decode(held[-1])]
            elif value == "TJ" and held and isinstance(held[-1], list):
                out += [decode(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in held[-1]]
            elif value == "T*" or value in ("Td", "TD") and len(held) > 1 and held[-1] != 0 and out:
                out.append("\n")
            elif value in ("Td", "TD") and out or value == "Tm" and out and not out[-1].endswith("\n"):
                out.append(" " if value != "Tm" else "\n")
            held = []

    def _decoder(self, font):
        """From a font's codes to text: by its ToUnicode map, else as Latin text; two-byte codes without a map can't be read."""
        font = font if isinstance(font, dict) else {}
        table = self.get(font.get("ToUnicode"))
        wide = font.get("Subtype") == "Type0"
        if isinstance(table, Stream):
            key = id(table), 2 if wide else 1  # read objects stay, so that an id is one stream's
            if key not in self._maps:
                data = self.unpacked(table)
                self._maps[key] = (_known_map if len(data) <= KNOWN_BYTES else _mapped)(data, key[1])
            return self._maps[key]
        return (lambda s: "�" * (len(s) // 2)) if wide else _latin


def _latin(codes: bytes) -> str:
    return codes.decode("cp1252", "replace")


def _mapped(table: bytes, width: int):
    """A decoder from the bfchar and bfrange entries of a map; codes that it lacks are the replacement character."""
    chars: dict[int, bytes] = {}
    ranges: list[tuple[int, int, bytes]] = []
    held, at = [], 0
    while True:
        value, at = parse(table, at)
        if value is None:
            break
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == "endbfchar":
            chars |= {int.from_bytes(a, "big"): b for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif value == "endbfrange":
            for a, z, b in zip(held[::3], held[1::3], held[2::3], strict=False):
                first, last = int.from_bytes(a, "big"), int.from_bytes(z, "big")
                if isinstance(b, list):
                    chars |= {first + k: x for k, x in enumerate(b) if isinstance(x, bytes)}
                elif isinstance(b, bytes):
                    ranges.append((first, last, b))
        held = []

    class Units(dict):
        def __missing__(self, code: int) -> bytes:
            hit = next(((f, b) for f, z, b in ranges if f <= code <= z), None)
            self[code] = (int.from_bytes(hit[1], "big") + code - hit[0]).to_bytes(max(2, len(hit[1])), "big") if hit else b"\xff\xfd"
            return self[code]

    unit = Units(chars).__getitem__

    def decode(codes: bytes) -> str:
        whole = len(codes) - len(codes) % width
        each = codes if width == 1 else [*struct.unpack(f">{whole // 2}H", codes[:whole]), *codes[whole:]]
        return b"".join(map(unit, each)).decode("utf-16-be", "replace")

    return decode


@lru_cache(maxsize=8)
def _known_map(table: bytes, width: int):
    """_mapped() of a table that many files share, as those of one writer do."""
    return _mapped(table, width)


def _unpredicted(data: bytes, setting: dict) -> bytes:
    """Rows of PNG predictors undone (of the kinds that cross-references use: none, left and up)."""
    if setting.get("Predictor", 1) < 10:
        return data
    width, out, above = setting.get("Columns", 1), bytearray(), bytes(setting.get("Columns", 1))
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if kind == 1:
            for i in range(1, len(row)):
                row[i] = (row[i] + row[i - 1]) & 255
        elif kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, above, strict=False))
        elif kind:
            raise Damaged("predictor")
        out += row
        above = bytes(row)
    return bytes(out)


def page_texts(data: bytes | None) -> list[tuple[int, str, str | None]]:
    """(page_number, text, error) of a file's pages; a file that can't be read at all is page 0 with an error."""
    faults = (Damaged, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError, OverflowError)
    try:
        document = Document(data or b"")
        pages = document.pages()
    except faults as e:
        return [(0, "", str(e) if isinstance(e, Damaged) else "broken file")]
    out = []
    for number, page in enumerate(pages, 1):
        try:
            out.append((number, "", "no page") if page is None else (number, document.text(page), None))
        except faults as e:
            out.append((number, "", str(e) if isinstance(e, Damaged) else "broken page"))
    return out


def read_pages(files: DataFrame) -> DataFrame:
    """(file, page_number, text, error) of PDF files (file, content), as ``binaryFile`` reads them, say; null content is a broken file."""

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):  # a file at a time: its bytes and pages are what a task holds
                rows = page_texts(b.column("content")[i].as_py())
                columns = [b.column("file").slice(i, 1).take(pa.array([0] * len(rows))), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string()), strict=True))] if rows else None
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, ["file", "page_number", "text", "error"])

    kind = files.schema["file"].dataType.simpleString()
    return files.select("file", "content").mapInArrow(work, PAGES.format(file=kind))


@lru_cache(maxsize=1)
def _own_map() -> bytes:
    """The stream that maps every code of two bytes to itself."""
    parts = [range(k, min(k + 100, 256)) for k in (0, 100, 200)]
    return _packed(b"".join(b"%d beginbfrange\n" % len(part) + b"".join(b"<%02X00> <%02XFF> <%02X00>\n" % (h, h, h) for h in part) + b"endbfrange\n" for part in parts))


def write_pdf(pages: list[str], damaged: frozenset[int] = frozenset()) -> bytes:
    """A file whose pages show the lines of ``pages``, in a font whose codes are UTF-16; the streams of ``damaged`` page numbers are cut off."""
    bodies = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type0/BaseFont/F/Encoding/Identity-H/ToUnicode 4 0 R>>", _own_map()]
    kids = []
    for number, text in enumerate(pages, 1):
        lines = b" T*\n".join(b"<%s> Tj" % x.encode("utf-16-be", "surrogatepass").hex().encode() for x in text.split("\n"))
        stream = _packed(b"BT /F 9 Tf 11 TL 40 800 Td\n" + lines + b"\nET", number in damaged)
        kids.append(len(bodies) + 1)
        bodies += [b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F 3 0 R>>>>/Contents %d 0 R>>" % (len(bodies) + 2), stream]
    bodies[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for number, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


def write_files(rows: DataFrame) -> DataFrame:
    """(file, content) of rows (file, pages array<string>, damaged array<int>): a PDF each, by write_pdf()."""

    def work(batches):
        for b in batches:
            made = [write_pdf(pages, frozenset(bad)) for pages, bad in zip(b.column("pages").to_pylist(), b.column("damaged").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(made, pa.binary())], ["file", "content"])

    return rows.select("file", "pages", "damaged").mapInArrow(work, f"file {rows.schema['file'].dataType.simpleString()}, content binary")


def _packed(data: bytes, damaged: bool = False) -> bytes:
    packed = zlib.compress(data)
    packed = packed[: len(packed) // 2] if damaged else packed
    return b"<</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream" % (len(packed), packed)
