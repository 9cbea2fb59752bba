"""Chunks from cleaned pages: structural units in SQL, packing within sections, stable hashes.

Units are found by expressions; the section that holds is handed on from one
block of pages to the next. Packing, borrowing and overlap look at whole units
one after the other, but never beyond a section, so the run of units under one
section is what a task packs: a long file is spread over as many tasks as it has
sections, and its chunks are numbered by the counts of the runs before. A file
that is a row with all its pages is chunked where it is read, and nothing of it
is written or dealt out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import cached_property, lru_cache, reduce
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..tables import stored
from .numbering import carried, sums_before

_WORD, _MARK = r"[\p{L}\p{N}_]", r"[^\s\p{L}\p{N}_]"
_PIECE = regex.compile(f"{_WORD}+|{_MARK}")
#: The characters of Latin-1 as a letter, a comma for a mark, or a space.
_KINDS = bytes(ord("a" if regex.match(_WORD, c) else "," if regex.match(_MARK, c) else " ") for c in map(chr, range(256)))
VERSION = "structure-pieces-1"
PAGES_PER_BLOCK = 256
#: Characters of passages in a row or a batch of chunk_files(), if no single passage has more.
CHARACTERS = 1 << 22


@dataclass(frozen=True)
class ChunkSize:
    """Sizes in pieces (words and marks): of a chunk with its label, of what it repeats, and below which it borrows."""

    most: int = 200
    overlap: int = 30
    least: int = 40

    def __post_init__(self):
        if self.most <= 0 or self.overlap < 0 or self.least < 0:
            raise ValueError("sizes must be positive")
        if self.overlap >= self.most or self.least >= self.most:
            raise ValueError("overlap and least must be smaller than most")


@dataclass(frozen=True)
class Unit:
    text: str
    page_start: int
    page_end: int
    section: str | None
    kind: str

    @cached_property
    def pieces(self) -> int:
        return count(self.text)

    @cached_property
    def sentences(self) -> list[Unit]:
        parts = [p.strip() for p in regex.split(T.SENTENCE_END, self.text.strip())]
        return [Unit(p, self.page_start, self.page_end, self.section, "sentence") for p in parts if p]


def units(pages: DataFrame) -> DataFrame:
    """(file, page_number, paragraph, item, text, section, run, kind) from (file, page_number, cleaned_text).

    A paragraph's leading heading lines (together no longer than a heading)
    set the section from there on, across pages; paragraphs of list items are
    a unit an item, others one. ``run`` is where the section began: it is the
    same for all units between two headings that differ.
    """
    # Sections take several passes; the texts are parsed in one, which is written.
    rows = stored(_paragraphs(pages, "file", "page_number"), "paragraphs")
    order, block = ["page_number", "paragraph"], F.floor(F.col("page_number") / PAGES_PER_BLOCK)
    rows = carried(rows, "file", block, order, F.col("title"), "section")
    new = F.when(~F.col("section").eqNullSafe(F.col("section_before")), F.struct("page_number", "paragraph"))
    rows = carried(rows, "file", block, order, new, "run").filter(F.size("rest") > 0)
    items = _listed()
    texts = F.when(items, F.col("rest")).otherwise(F.array(F.array_join("rest", "\n")))
    kind = F.when(items, "list-item").otherwise("paragraph")
    begin = F.coalesce("run", F.struct(F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("paragraph")))
    return rows.select("file", "page_number", "paragraph", "section", begin.alias("run"), kind.alias("kind"), F.posexplode(texts).alias("item", "text"))


def _paragraphs(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, paragraph, title, rest): paragraphs with lines, what their leading heading lines say, if any, and the other lines."""
    paragraphs = F.posexplode(F.split("cleaned_text", r"\n\s*\n", -1)).alias("paragraph", "body")
    rows = pages.select(*keys, paragraphs).filter(F.col("body").rlike("[^ \\n]")).withColumn("lines", T.lines(F.col("body")))
    start = F.struct(F.array().cast("array<string>").alias("heads"), F.lit(True).alias("going"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.array_join(F.concat(acc["heads"], F.array(line)), " ")
        label = line.rlike(r"(?i)^(?:table|figure|source|note)\b") & (F.size(acc["heads"]) > 0)
        fits = (F.length(joined) <= T.HEADING_CHARS) & (F.size(T.pieces(joined)) <= T.HEADING_TOKENS)
        more = acc["going"] & T.is_heading(line) & ~label & fits
        longer = F.struct(F.concat(acc["heads"], F.array(line)).alias("heads"), F.lit(True).alias("going"))
        return F.when(more, longer).otherwise(F.struct(acc["heads"].alias("heads"), F.lit(False).alias("going")))

    rows = rows.withColumn("heads", F.aggregate("lines", start, step, lambda acc: acc["heads"]))
    rows = rows.withColumn("rest", F.slice("lines", F.size("heads") + 1, F.size("lines")))
    title = F.when(F.size("heads") > 0, F.array_join("heads", " "))
    return rows.select(*keys, "paragraph", title.alias("title"), "rest")


def _listed() -> Column:
    """Whether all lines of a paragraph are list items."""
    return F.forall("rest", T.is_list_item)


def label(first: int, last: int, section: str | None) -> str:
    pages = f"[Source page {first}]" if first == last else f"[Source pages {first}-{last}]"
    return pages + (f"\n[Section: {section}]" if section else "")


def count(text: str) -> int:
    """The number of pieces of a text."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return len(_PIECE.findall(text))
    return len(kinds.replace(b",", b" ").split()) + kinds.count(b",")


def spots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a text begin, and where they end."""
    try:
        kinds = np.frombuffer(text.encode("latin-1").translate(_KINDS), np.uint8)
    except UnicodeEncodeError:
        spans = np.array([m.span() for m in _PIECE.finditer(text)], np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]
    marks, words = kinds == ord(","), np.zeros(len(kinds) + 2, bool)
    words[1:-1] = kinds == ord("a")
    begins, ends = words[1:-1] > words[:-2], words[1:-1] > words[2:]
    return np.flatnonzero(begins | marks), np.flatnonzero(ends | marks) + 1


def last_begin(text: str, n: int) -> int:
    """Where the last ``n`` pieces of a text begin. It is looked for in the last characters; pieces that are longer take the whole text."""
    for most in (16 * n, len(text)):
        part = text[-most:]
        starts, _ = spots(part)
        if len(starts) > n or most >= len(text):  # the first piece of a part may be cut
            return len(text) - len(part) + int(starts[-n])
    raise ValueError("no text")


@lru_cache(maxsize=1 << 14)
def _label_size(first: int, last: int, section: str | None) -> int:
    return count(label(first, last, section))


def _parts(group: list[Unit]) -> list[str]:
    """The texts of a group, each but the first with what parts it from the one before."""
    listed = group[0].kind == "list-item"
    between = ("\n" if listed and unit.kind == before.kind == "list-item" else "\n\n" for before, unit in zip(group, group[1:], strict=False))
    return [group[0].text, *(mark + unit.text for mark, unit in zip(between, group[1:], strict=True))]


def _joined(group: list[Unit]) -> str:
    return "".join(_parts(group))


def _span(group: list[Unit]) -> tuple[int, int]:
    """The first and the last page of a group."""
    return min([u.page_start for u in group]), max([u.page_end for u in group])


def _size(group: list[Unit]) -> int:
    """Pieces of the chunk with its label; they add up, as units are joined by white space."""
    return _label_size(*_span(group), group[-1].section) + sum([u.pieces for u in group])


def split_large(unit: Unit, size: ChunkSize) -> list[Unit]:
    """A unit that fits by itself, else its sentences, else runs of pieces."""
    room = size.most - _label_size(unit.page_start, unit.page_end, unit.section)
    if unit.pieces <= room:
        return [unit]
    if len(unit.sentences) > 1:
        return [u for part in unit.sentences for u in split_large(part, size)]
    if room < 1:
        raise ValueError("most is too small for the label")
    starts, ends = spots(unit.text)
    cuts = [unit.text[starts[i] : ends[min(i + room, len(ends)) - 1]] for i in range(0, len(starts), room)]
    return [Unit(text, unit.page_start, unit.page_end, unit.section, "hard-boundary") for text in cuts]


def pack(found: list[Unit], size: ChunkSize) -> list[list[Unit]]:
    """Units in order, as many to a group as fit beside the overlap; a short group takes units from the one before it.

    Groups don't cross sections, and no group is made shorter than ``least`` to help another.
    """
    room, groups = size.most - size.overlap, []
    first = last = pieces = 0  # of the last group
    for unit in found:
        if groups and groups[-1][-1].section == unit.section:
            pages, more = (min(first, unit.page_start), max(last, unit.page_end)), pieces + unit.pieces
            if _label_size(*pages, unit.section) + more <= room:
                (first, last), pieces = pages, more
                groups[-1].append(unit)
                continue
        groups.append([unit])
        first, last, pieces = unit.page_start, unit.page_end, unit.pieces
    for i in range(len(groups) - 1, 0, -1):
        before, own = groups[i - 1], groups[i]
        if before[-1].section != own[0].section:
            continue
        while _size(own) < size.least and len(before) > 1 and _size(before[:-1]) >= size.least and _size([before[-1], *own]) <= room:
            own.insert(0, before.pop())
    return groups


def _tail(group: list[Unit], own: list[Unit], size: ChunkSize) -> tuple[list[Unit], int]:
    """What a chunk repeats of the group before it: as many of its last pieces as fit, within one section."""
    section, page = own[0].section, group[-1].page_end
    if not size.overlap or group[-1].section != section:
        return [], 0
    first, last = _span(own)
    free = size.most - _label_size(min(first, page), max(last, page), own[-1].section) - sum([u.pieces for u in own])
    n = min(size.overlap, sum([u.pieces for u in group]), free)
    if n <= 0:
        return [], 0
    at, behind = len(group) - 1, 0  # the unit that holds the first of the n pieces, and how many are behind it; no piece goes beyond a unit
    while behind + group[at].pieces < n:
        behind += group[at].pieces
        at -= 1
    begin = last_begin(group[at].text, n - behind)
    return [Unit("".join([group[at].text[begin:], *_parts(group)[at + 1 :]]), page, page, section, "overlap")], n


CHUNK = (
    "setting int, file string, run_page int, run_paragraph int, chunk_index int, passage_text string, content string, page_start int, page_end int, section_title string, "
    "token_count int, overlap_token_count int, boundary_kinds array<string>"
)


def _chunks(found: list[Unit], size: ChunkSize) -> list[tuple]:
    """Chunks of a run's units in order: (index, passage, content, first page, last page, section, pieces, pieces repeated, kinds)."""
    every = [u for unit in found for u in split_large(unit, size) if u.text.strip()]
    groups, out = pack(every, size), []
    for i, own in enumerate(groups):
        extra, n = _tail(groups[i - 1], own, size) if i else ([], 0)
        whole, section = [*extra, *own], own[-1].section
        first, last = _span(whole)
        passage, pieces = _joined(whole), n + sum([u.pieces for u in own])
        content = label(first, last, section) + "\n" + passage
        out.append((i, passage, content, first, last, section, _label_size(first, last, section) + pieces, n, list(dict.fromkeys(u.kind for u in whole))))
    return out


def _run_units(rows: list[tuple]) -> list[Unit]:
    """Units of (page_number, text, section, kind) rows."""
    return [Unit(text, page, page, section, kind) for page, text, section, kind in rows]


def _chunk_run(key: tuple, rows: list[tuple], size: ChunkSize) -> list[tuple]:
    """Chunks of a run (file, page and paragraph where it begins) from its (page_number, text, section, kind) rows in order."""
    return [(*key, *chunk) for chunk in _chunks(_run_units(rows), size)]


def content_hash(passage: Column, first: Column, last: Column, section: Column, version: Column) -> Column:
    """SHA-256 of canonical JSON: keys in order, nothing between them, nulls written."""
    fields = F.struct(version.alias("chunking_version"), last.alias("page_end"), first.alias("page_start"), passage.alias("passage_text"), section.alias("section_title"))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    whole, text = pa.int32(), pa.string()
    types = [whole, text, whole, whole, whole, text, text, whole, whole, text, whole, whole, pa.list_(text)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def chunk_pages(pages: DataFrame, size: ChunkSize = ChunkSize()) -> DataFrame:
    """Chunks of (file, page_number, cleaned_text): passages with label, pages, section, counts, kinds and hash.

    Of chunks of a file with one hash the first stays. Runs of units under one
    section are read one after the other from sorted rows, so a task holds one
    run at a time.
    """
    return chunk_sweep(pages, [size]).drop("setting")


def chunk_sweep(pages: DataFrame, sizes: list[ChunkSize]) -> DataFrame:
    """chunk_pages() of several sizes, with ``setting``, a size's place in the list; pages are parsed, dealt and sorted once for all."""
    settings = [asdict(size) for size in sizes]
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def work(batches):
        own, key, rows = [ChunkSize(**s) for s in settings], None, []
        every = lambda: [(k, *key, *chunk) for units in [_run_units(rows)] for k, size in enumerate(own) for chunk in _chunks(units, size)]
        for b in batches:
            out = []
            for file, page, paragraph, *row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (file, page, paragraph) != key and rows:
                    out += every()
                    rows = []
                key = file, page, paragraph
                rows.append(row)
            yield _batch(out, names)
        if rows:
            yield _batch(every(), names)

    run = [F.col(f"run.{c}").cast("int").alias(f"run_{n}") for c, n in (("page_number", "page"), ("paragraph", "paragraph"))]
    flat = units(pages).select("file", *run, F.col("page_number").cast("int"), "text", "section", "kind", "paragraph", "item")
    ordered = flat.repartition("file", "run_page", "run_paragraph").sortWithinPartitions("file", "run_page", "run_paragraph", "page_number", "paragraph", "item")
    made = _numbered(stored(ordered.drop("paragraph", "item").mapInArrow(work, CHUNK), "chunks"))
    own = content_hash(F.col("passage_text"), F.col("page_start"), F.col("page_end"), F.col("section_title"), F.lit(VERSION))
    first = Window.partitionBy("setting", "file", "content_hash").orderBy("chunk_index")
    rows = made.withColumn("content_hash", own).withColumn("__n", F.row_number().over(first))
    return rows.filter("__n = 1").drop("__n").withColumn("chunking_version", F.lit(VERSION))


def _numbered(made: DataFrame) -> DataFrame:
    """Chunks with their index in the file instead of in their run."""
    key = ["setting", "file", "run_page", "run_paragraph"]
    counts = made.groupBy(*key).agg(F.count(F.lit(1)).alias("chunks")).withColumn("of", F.struct("setting", "file"))
    block = F.floor(F.coalesce("run_page", F.lit(-1)) / PAGES_PER_BLOCK)
    starts = sums_before(counts, "of", block, ["run_page", "run_paragraph"], "chunks", "start")  # nulls come first
    starts = starts.select(*[F.col(c).alias(f"{c}#") for c in key], "start")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}#")) for c in key])
    rows = made.join(starts, same)
    return rows.withColumn("chunk_index", (F.col("chunk_index") + F.col("start")).cast("int")).select(*[c for c in made.columns if c not in key[2:]])


PASSAGE = (
    "chunk_index int, passage_text string, page_start int, page_end int, section_title string, token_count int, overlap_token_count int, "
    "boundary_kinds array<string>"
)


def _file_chunks(paragraphs: Iterable[tuple], sizes: list[ChunkSize]) -> Iterator[list[tuple]]:
    """For each size the chunks of a file, without copies, from its (page_number, title, listed, rest) paragraphs in order."""
    runs, section = [[]], None
    for page, title, listed, rest in paragraphs:
        if title is not None and title != section:
            section = title
            runs.append([])
        kind, texts = ("list-item", rest) if listed else ("paragraph", ["\n".join(rest)])
        runs[-1] += [Unit(text, page, page, section, kind) for text in texts]
    for size in sizes:
        kept: dict[tuple, tuple] = {}  # by what content_hash() is made of
        for i, (_, passage, _, *places, pieces, repeated, kinds) in enumerate(chunk for run in runs for chunk in _chunks(run, size)):
            kept.setdefault((passage, *places), (i, passage, *places, pieces, repeated, kinds))
        yield list(kept.values())


def _stretches(chunks: list[tuple], characters: int) -> Iterator[tuple[list[tuple], str | None]]:
    """Chunks in order, of about so many characters together, with the passage that comes next."""
    begin = held = 0
    for i, chunk in enumerate(chunks):
        if held >= characters:
            yield chunks[begin:i], chunk[1]
            begin, held = i, 0
        held += len(chunk[1])
    if chunks:
        yield chunks[begin:], None


def _file_batch(out: list[tuple[int, str, list[tuple], str | None]]) -> pa.RecordBatch:
    whole, text = pa.int32(), pa.string()
    types, names = [whole, text, whole, whole, text, whole, whole, pa.list_(text)], [c.split()[0] for c in PASSAGE.split(", ")]
    rows = [chunk for row in out for chunk in row[2]]
    flat = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
    chunks = pa.ListArray.from_arrays(pa.array(accumulate((len(row[2]) for row in out), initial=0), whole), flat)
    setting, file, after = (pa.array([row[k] for row in out], t) for k, t in ((0, whole), (1, text), (3, text)))
    return pa.RecordBatch.from_arrays([setting, file, chunks, after], ["setting", "file", "chunks", "after"])


def chunk_files(files: DataFrame, sizes: list[ChunkSize], characters: int = CHARACTERS) -> DataFrame:
    """(setting, file, chunks, after) from (file, pages): chunk_sweep()'s chunks of each file, without label and hash, in their order.

    A row is a file with all its pages and is chunked by the task that reads
    it, so no text is written or dealt out; a task holds the units of one file.
    Of long files a row has some ``characters``; ``after`` is the passage that
    the next row begins with.
    """
    settings = [asdict(size) for size in sizes]

    def work(batches):
        own, out, held = [ChunkSize(**s) for s in settings], [], 0
        rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
        for (_, file), paragraphs in groupby(rows, itemgetter(0, 1)):
            for k, every in enumerate(_file_chunks((p[2:] for p in paragraphs), own)):
                for chunks, after in _stretches(every, characters):
                    out.append((k, file, chunks, after))
                    held += sum([len(c[1]) for c in chunks])
                    if held >= characters:
                        yield _file_batch(out)
                        out, held = [], 0
        yield _file_batch(out)

    rows = files.select("file", "pages", F.monotonically_increasing_id().alias("row"))  # while a file is a row
    pages = rows.select("row", "file", F.posexplode("pages").alias("at", "cleaned_text")).withColumn("page_number", F.col("at") + 1)
    found = _paragraphs(pages, "row", "file", "page_number").select("row", "file", "page_number", "title", _listed().alias("listed"), "rest")
    return found.mapInArrow(work, f"setting int, file string, chunks array<struct<{PASSAGE}>>, after string")


def summarize(chunks: DataFrame, configuration: Column) -> DataFrame:
    """By configuration: counts, token range, pages crossed, headings, and how alike neighbouring chunks are."""
    words = chunks.withColumn("configuration", configuration).withColumn("words", T.word_set(F.col("passage_text"))).drop("passage_text", "content")
    beside = Window.partitionBy("configuration", "file").orderBy("chunk_index")
    pairs = words.withColumn("after", F.lead("words").over(beside)).withColumn("alike", _alike(F.col("words"), F.col("after"))).drop("words", "after")
    return _summary(pairs, F.count(F.lit(1)) - F.count_distinct(F.struct("file", "content_hash")))


def summarize_files(found: DataFrame, configuration: Column) -> DataFrame:
    """summarize() of chunk_files(): neighbours are side by side in a row, and copies were dropped there."""
    words = F.transform("chunks", lambda c: T.word_set(c["passage_text"]))
    words = F.concat(words, F.when(F.col("after").isNotNull(), F.array(T.word_set(F.col("after")))).otherwise(F.array()))
    alike = T.once(words, lambda w: F.zip_with(F.slice(w, 1, F.size("chunks")), F.slice(w, 2, F.size("chunks")), _alike))
    fields = [c.split()[0] for c in PASSAGE.split(", ")]
    plain = [F.col(f"chunks.{c}").alias(c) for c in fields if c not in ("passage_text", "boundary_kinds")]
    rows = found.select(configuration.alias("configuration"), F.inline(F.arrays_zip(*plain, alike.alias("alike"))))
    return _summary(rows, F.lit(0).cast("long"))


def _alike(words: Column, after: Column) -> Column:
    """The similarity of a chunk's words and the next chunk's, 0 for two without words; null if there is no next."""
    both = F.size(words) + F.size(after)
    share = T.once(F.size(F.array_intersect(words, after)), lambda common: common / F.when(both > common, both - common))
    return F.when(after.isNotNull(), F.coalesce(share, F.lit(0.0)))


def _summary(chunks: DataFrame, copies: Column) -> DataFrame:
    return chunks.groupBy("configuration").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.sum((F.col("page_end") > F.col("page_start")).cast("int")).alias("cross_page"),
        F.count("section_title").alias("with_heading"), F.round(F.avg("alike"), 6).alias("mean_alike"), F.round(F.max("alike"), 6).alias("max_alike"),
        F.count(F.when(F.col("alike") >= 0.8, 1)).alias("near_pairs"), copies.alias("duplicate_hashes"),
        F.round(F.avg("overlap_token_count"), 6).alias("mean_overlap"), F.max("overlap_token_count").alias("max_overlap"),
    )


def best_size(summaries: DataFrame, scores: DataFrame, near: int = 300) -> DataFrame:
    """(configuration) of summarize() to choose, if any: it keeps all evidence whole and has no copies.

    Of several that with the fewest near copies side by side, then the one
    nearest to ``near`` pieces, then the smaller. ``scores`` is (configuration,
    most, cases, preserved).
    """
    fit = summaries.join(scores, "configuration").filter((F.col("preserved") == F.col("cases")) & (F.col("duplicate_hashes") == 0))
    return fit.agg(F.min_by("configuration", F.struct("near_pairs", F.abs(F.col("most") - near), "most")).alias("configuration")).filter("configuration is not null")


def break_point(text: str, start: int, end: int, window: int = 200) -> int:
    """Where a chunk of characters ends: behind the last paragraph, else sentence, else line within its last ``window``."""
    low = max(start, end - window)
    for mark in ("\n\n", ". ", "! ", "? ", "\n"):
        at = text.rfind(mark, low, end)
        if at >= 0:
            return at + len(mark)
    return end


def character_chunks(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(file, page_number, chunk_index, content): sliding windows of each page, with the page's label; a tail of overlap alone is kept."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size, and size positive")

    def cut(text: str) -> list[str]:
        out, start = [], 0
        while start < len(text):
            end = min(start + size, len(text))
            end = break_point(text, start, end) if end < len(text) else end
            out += [text[start:end].strip()] if text[start:end].strip() else []
            start = end - overlap if end - overlap > start else end
        return out

    def work(batches):
        for b in batches:
            rows = [(f, p, i, c) for f, p, t in zip(b["file"], b["page_number"], b["cleaned_text"], strict=True) for i, c in enumerate(cut(t or ""))]
            yield pd.DataFrame(rows, columns=["file", "page_number", "chunk_index", "content"])

    made = pages.select("file", "page_number", "cleaned_text").mapInPandas(work, "file string, page_number int, chunk_index int, content string")
    return made.withColumn("content", F.concat(F.lit("[Source page "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("content")))


def matching_chunks(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, file, chunk_index): chunks on an evidence row's pages that have all patterns of one of its groups.

    ``evidence`` is (id, file, pages array<int>, pattern_groups array<array<string>>). Pages are
    exploded on both sides, so the range join is an equality join.
    """
    wanted = evidence.withColumn("page", F.explode("pages"))
    spread = chunks.withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    plain = T.casefold(F.regexp_replace("passage_text", "[–—]", "-"))
    fits = F.exists("pattern_groups", lambda g: F.forall(g, lambda p: F.call_function("regexp", plain, T.casefold(p))))
    found = spread.join(wanted, ["file", "page"]).filter(fits)
    return found.select("id", "file", "chunk_index").distinct()
