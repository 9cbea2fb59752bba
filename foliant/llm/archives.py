"""Legacy ARC archives: reading, conversion to WARC, writing and reading WARC files.

An ARC file starts with a version block that declares the fields of every later
header line. Version 1 lines have five fields, version 2 lines ten; the last one
is the length in bytes of the record's body. The converter reads by declared
lengths only and makes for each record what WARC needs: an identifier, an ISO
timestamp, a type, and SHA-1 digests in base32.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch_path

# Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL",
        "IP-address",
        "Archive-date",
        "Content-type",
        "Result-code",
        "Checksum",
        "Location",
        "Offset",
        "Filename",
        "Archive-length",
    ],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

PAGE_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "warc_record_id string, warc_date string, target_uri string, digest_verified boolean"
)


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    content_type: str
    status: int | None
    body: bytes


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as WARC writes after ``sha1:``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """Records of one ARC file, by their declared lengths; the version block is read, not returned.

    A header line with the wrong number of fields, or a length that runs past
    the end, raises ValueError: nothing after it could be placed.
    """
    at, version = 0, 1
    first = True
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):  # the blank line between records
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at byte {at} has no end")
        fields = content[at:end].rstrip(b"\r").decode("utf-8").split(" ")
        if not fields[-1].isdigit():
            raise ValueError(f"no length in the header line at byte {at}")
        length = int(fields[-1])
        start = end + 1
        if start + length > len(content):
            raise ValueError(f"record at byte {at} is cut short")
        body = content[start : start + length]
        at = start + length
        if first and fields[0].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            first = False
            continue
        first = False
        names = ARC_FIELDS[version]
        if len(fields) != len(names):
            raise ValueError(f"{len(fields)} fields where version {version} has {len(names)}")
        row = dict(zip(names, fields, strict=True))
        code = row.get("Result-code", "")
        yield ArcRecord(
            version,
            row["URL"],
            row["IP-address"],
            row["Archive-date"],
            row["Content-type"],
            int(code) if code.isdigit() else None,
            body,
        )


def write_arc(version: int, name: str, date: str, records: list[tuple[str, str, bytes]]) -> bytes:
    """One ARC file; ``records`` are (url, content type, body). URLs lose their white space, as the format has it."""
    head = f"{version} 0 origin\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    extra = "200 - - 0 " + name + " " if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(head)}\n".encode(), head, b"\n"]
    for url, kind, body in records:
        line = f"{''.join(url.split()) or '-'} 0.0.0.0 {date} {kind} {extra}{len(body)}\n"
        out += [line.encode(), body, b"\n"]
    return b"".join(out)


def http_payload(body: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) of an HTTP response and what follows them; no headers: all is payload."""
    if not body.startswith(b"HTTP/"):
        return {}, body
    head, gap, payload = body.partition(b"\r\n\r\n")
    if not gap:
        return {}, body
    pairs = (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, payload


def iso_date(arc_date: str) -> str:
    """ARC's 14 digits as WARC's UTC timestamp; a malformed date is the epoch."""
    try:
        moment = datetime.strptime(arc_date[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        moment = datetime.fromtimestamp(0, UTC)
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def to_warc(record: ArcRecord, refers_to: int | None = None) -> bytes:
    """The equivalent WARC record without its closing blank lines.

    With ``refers_to`` it is a revisit: the HTTP headers stay, with the full
    length of the payload, and the payload is that of the response named.
    """
    headers, payload = http_payload(record.body)
    page = headers.get("x-page-id", "")
    value = digest(payload)
    block = record.body if refers_to is None else record.body[: len(record.body) - len(payload)]
    ident = f"<urn:page:{page}>" if page else f"<urn:sha1:{digest(record.url.encode() + b' ' + payload)}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {ident}",
        f"WARC-Date: {iso_date(record.date)}",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Payload-Digest: sha1:{value}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, of all its gzip members if it is compressed, ``step`` at a time."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[at : at + step] for at in range(0, len(content), step))
        return
    while content:
        member, rest = zlib.decompressobj(31), content
        while not member.eof:
            made = member.decompress(rest, step)
            rest = member.unconsumed_tail
            if not made and not rest and not member.eof:
                raise ValueError("a compressed file ends too early")
            yield made
        content = member.unused_data


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by Content-Length; gzip members are opened as they are read.

    No more than a record and a megabyte is held beside ``content``.
    """
    held, at, least, done = bytearray(), 0, 0, 0  # ``at`` is where the next record begins in ``held``
    for chunk in _inflated(content):
        held += chunk
        while len(held) - at > least:
            end = held.find(b"\r\n\r\n", at)
            if not held.startswith(b"WARC/"[: len(held) - at], at):
                raise ValueError(f"no record at byte {done}")
            if end < 0:
                break
            pairs = (x.partition(": ") for x in held[at:end].decode("utf-8").split("\r\n")[1:])
            fields = {k.lower(): v for k, _, v in pairs}
            start = end + 4
            stop = start + int(fields["content-length"])
            if len(held) < stop + 4:
                least = stop + 3 - at  # nothing to do before all of the record is there
                break
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {done} doesn't end where it says")
            yield fields, bytes(held[start:stop])
            done, at, least = done + stop + 4 - at, stop + 4, 0
        del held[:at]
        at = 0
    if held:
        raise ValueError(f"the record at byte {done} doesn't end where it says")


def _page_arc(page_id, url, html, date: str, name: str) -> bytes:
    """A page as an ARC file of one record; even ids are version 1, odd ones version 2."""
    payload = html.encode("utf-8") if isinstance(html, str) else b""
    known = page_id is not None
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += f"Content-Length: {len(payload)}\r\n" + (f"X-Page-Id: {int(page_id)}\r\n" if known else "") + "\r\n"
    version = 2 if known and int(page_id) % 2 else 1
    address = url if isinstance(url, str) else "-"
    return write_arc(version, name, date, [(address, "text/html", head.encode() + payload)])


def legacy_archives(pages: DataFrame, date: str = "20080430204825") -> DataFrame:
    """Pages (page_id, url, html, and refers_to to be passed on) as ARC files: (refers_to, content binary)."""

    def build(batches):
        for b in batches:
            made = [
                _page_arc(*row, date, "pages.arc")
                for row in zip(b["page_id"], b["url"], b["html"], strict=True)
            ]
            yield pd.DataFrame({"refers_to": b["refers_to"], "content": pd.Series(made, dtype=object)})

    text = [F.col(c).cast("string") for c in ("page_id", "url", "html", "refers_to")]  # ids stay exact beside nulls
    return pages.select(*text).mapInPandas(build, "refers_to string, content binary")


def convert(archives: DataFrame) -> DataFrame:
    """ARC files (refers_to, content) as WARC records: (record string).

    ``refers_to``, if not null, makes the file's records revisits of that page.
    Records are text, as the sink writes lines; a body that isn't UTF-8 raises.
    """

    def change(batches):
        for b in batches:
            out = []
            for refers, content in zip(b["refers_to"], b["content"], strict=True):
                target = None if refers is None else int(refers)
                out += [to_warc(r, target).decode("utf-8") for r in read_arc(content)]
            yield pd.DataFrame({"record": pd.Series(out, dtype=object)})

    return archives.mapInPandas(change, "record string")


FILE_BYTES = 64 << 20


def records_per_file(pages: DataFrame, most: int = 4000) -> int:
    """So many records keep a file at about FILE_BYTES before compression, by the mean size of all pages; ``most`` at most."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 1024)).first()[0] or 1
    return max(1, min(most, int(FILE_BYTES / mean)))


def write_warc(records: DataFrame, path: str, records_per_file: int = 4000) -> None:
    """Write gzipped WARC files through Spark's committed text sink; a file has so many records at most."""
    (
        records.write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def read_pages(spark, path: str) -> DataFrame:
    """Read WARC files of pages again, one row a record; block and payload digests are checked."""

    def parse(batches):
        for b in batches:
            for content in b["content"]:
                rows = []
                for fields, block in read_warc(bytes(content)):
                    rows.append(_page_row(fields, block))  # no payload stays
                    if len(rows) == 4000:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
                yield pd.DataFrame(rows, columns=_COLUMNS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > 0).select("content").mapInPandas(parse, PAGE_SCHEMA)


_COLUMNS = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]


def _page_row(fields: dict[str, str], block: bytes) -> tuple:
    headers, payload = http_payload(block)
    revisit = fields["warc-type"] == "revisit"
    value = fields["warc-payload-digest"].removeprefix("sha1:")
    good = digest(block) == fields["warc-block-digest"].removeprefix("sha1:")
    good = good and (revisit or digest(payload) == value)
    page = headers.get("x-page-id")
    target = fields["warc-refers-to"].strip("<>").rpartition(":")[2] if revisit else None
    return (
        int(page) if page else None,
        int(headers["content-length"]) if revisit else len(payload),
        value,
        fields["warc-type"],
        int(target) if target else None,
        fields["warc-record-id"],
        fields["warc-date"],
        fields["warc-target-uri"],
        good,
    )


def with_revisits(pages: DataFrame, min_bytes: int = 0, salts: int = 8) -> DataFrame:
    """Add ``refers_to``: of pages with equal payloads, the smallest page_id; null on that page itself.

    Digests are counted with map-side partial sums; the small (page, digest)
    rows then look up their group by (digest, salt), so that a payload that a
    third of the pages share is spread over ``salts`` tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("sha", F.sha1(payload))
    small = keyed.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes).select(
        "page_id", "sha", F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt")
    )
    groups = small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    groups = groups.select("sha", F.col("salt").cast("long").alias("salt"), "first")
    revisits = small.join(groups, ["sha", "salt"]).filter("page_id > first")
    revisits = revisits.select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    return keyed.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write every page as a record of a legacy archive, convert it to WARC, and read the WARC files back.

    Null html is an empty payload, a null url ``-``. A page without page_id
    is a response and reads back as null. If several rows have the smallest
    page_id and the same html, each is a response. No pages, no rows.
    """
    spark = pages.sparkSession
    place = path or scratch_path(spark, "warc")
    write_warc(convert(legacy_archives(with_revisits(pages, min_bytes))), place, records_per_file(pages))
    return read_pages(spark, place)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(url, '-') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to,
  '<urn:page:' || page_id || '>' AS warc_record_id, '2008-04-30T20:48:25Z' AS warc_date, regexp_replace(url, '\\s', '', 'g') AS target_uri, true AS digest_verified
FROM p JOIN f USING (h)
"""
