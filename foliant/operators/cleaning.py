"""Page cleaning: recurring edge lines, wrapped lines, repeated paragraphs, warnings and summaries.

Pages are rows (file, page_number, raw_text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .. import tables

# What counts as a page's edge, as recurring, as little text, and as a long paragraph.
EDGE_LINES = 2
LONGEST_EDGE_LINE = 120
#: More characters than the key of such a line can have: folding case makes two of one at most.
TOO_LONG = rf"^(?:\s*+\S){{{2 * LONGEST_EDGE_LINE + 1}}}"
FEWEST_PAGES = 3
PAGE_SHARE = 0.25
LOW_TEXT = 40
LONG_PARAGRAPH = 80


def best_text(plain: Column, layout: Column) -> Column:
    """The layout extraction only where it is less damaged than the plain one."""
    better = (T.quality_penalty(plain) > 0) & (T.quality_penalty(layout) < T.quality_penalty(plain))
    return F.when(better, layout).otherwise(plain)


def _edge(lines: Column, from_start: bool) -> Column:
    n = F.size(lines)
    return F.slice(lines, 1, EDGE_LINES) if from_start else F.slice(lines, F.greatest(F.lit(1), n - EDGE_LINES + 1), EDGE_LINES)


def _split(raw_text: Column) -> Column:
    return F.split(T.normalized_spacing(F.coalesce(raw_text, F.lit(""))), "\n", -1)


def with_edges(pages: DataFrame) -> DataFrame:
    """Add ``edges``: ``page`` (a hash) and, for ``head`` and ``foot``, the place, stripped line and key of a page's edge lines; pages that have them stay as they are.

    A text is split once for all of it, and what compares pages needs no text behind this.
    A line that is too long to have the key of a recurring one has neither line nor key.
    """
    if "edges" in pages.columns:
        return pages

    def sides(every: Column) -> Column:
        full = F.filter(F.transform(every, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
        may_recur = lambda x: ~x.rlike(TOO_LONG)
        keyed = lambda x, i: F.struct(i.alias("at"), F.when(may_recur(x), x).alias("line"), F.when(may_recur(x), T.furniture_key(x)).alias("key"))
        side = lambda at: F.transform(at, lambda i: keyed(F.trim(F.get(every, i)), i))
        return T.once(full, lambda at: F.struct(page.alias("page"), side(_edge(at, True)).alias("head"), side(_edge(at, False)).alias("foot")))

    page = F.xxhash64("page_number", "raw_text")  # pages with the same hash share their keys, which are all the file's
    return pages.withColumn("edges", T.once(_split(F.col("raw_text")), sides))


def repeated_edges(pages: DataFrame, from_start: bool, fewest: int = FEWEST_PAGES, share: float = PAGE_SHARE) -> DataFrame:
    """(file, key, pages, line): edge lines on enough of a file's pages, with the spelling of the first page that has it.

    Only keys and counts are shuffled. Enough is ``fewest`` pages and
    ``share`` of the pages with text; files with fewer pages have none.
    ``pages`` may have the column of with_edges().
    """
    edge = F.filter(F.col("edges.head" if from_start else "edges.foot"), lambda e: F.length(e["line"]) <= LONGEST_EDGE_LINE)
    rows = with_edges(pages).select("file", "page_number", edge.alias("edge")).filter(F.size("edge") > 0)
    totals = rows.groupBy("file").agg(F.count(F.lit(1)).alias("eligible"))
    each = rows.select("file", "page_number", F.posexplode("edge").alias("at", "e")).select("file", "page_number", "at", "e.line", "e.key")
    found = each.filter("key <> ''").groupBy("file", "key").agg(
        F.countDistinct("page_number").alias("pages"), F.min_by("line", F.struct("page_number", "at")).alias("line")
    )
    least = F.greatest(F.lit(fewest), F.ceil(F.col("eligible") * share))
    return found.join(totals, "file").filter((F.col("eligible") >= fewest) & (F.col("pages") >= least)).select("file", "key", "pages", "line")


def remove_edges(pages: DataFrame, heads: DataFrame, feet: DataFrame) -> DataFrame:
    """Add ``kept`` (lines), ``removed_headers`` and ``removed_footers``; the first page of a file loses nothing.

    A line goes only from the edge at which it recurs, and as a header if it could be either.
    A page's own edge lines, four at most, are looked up among the repeated
    ones by (file, key), and only those found go back to the page.
    ``pages`` may have the column of with_edges(), which isn't returned.
    """
    columns = [c for c in pages.columns if c != "edges"]
    pages = with_edges(pages).withColumn("__page", F.col("edges.page"))
    found = {"head": heads, "foot": feet}
    edge = lambda side: F.transform(F.col(f"edges.{side}"), lambda e: F.struct(F.lit(side).alias("side"), e["key"].alias("key")))
    own = pages.select("file", "__page", F.explode(F.array_distinct(F.concat(edge("head"), edge("foot")))).alias("e")).filter("e.key is not null").distinct()
    own = own.select("__page", F.struct("file", "e.side", "e.key").alias("edge"))
    known = [rows.select(F.struct("file", F.lit(side).alias("side"), "key").alias("edge"), "pages") for side, rows in found.items()]
    matched = tables.lookup(own, tables.stored(tables.stacked(*known), "edges"), "edge", "pages").filter(F.col("pages").isNotNull())
    of_side = lambda side: F.collect_set(F.when(F.col("edge.side") == side, F.col("edge.key")))
    keys = matched.groupBy(F.col("edge.file").alias("file"), "__page").agg(of_side("head").alias("head_keys"), of_side("foot").alias("foot_keys"))
    rows = pages.join(keys, ["file", "__page"], "left")
    spared = F.coalesce(F.col("page_number") == 1, F.lit(False))
    hit = lambda side: F.filter(F.col(f"edges.{side}"), lambda e: ~spared & F.coalesce(F.array_contains(f"{side}_keys", e["key"]), F.lit(False)))
    rows = rows.withColumns({"__head": hit("head"), "__foot": hit("foot")})
    foot = F.filter("__foot", lambda e: ~F.exists("__head", lambda h: h["at"] == e["at"]))
    rows = rows.withColumn("__foot", foot)
    gone = F.transform(F.concat("__head", "__foot"), lambda e: e["at"])
    every = _split(F.col("raw_text"))
    out = {
        "kept": T.once(gone, lambda at: F.filter(every, lambda x, i: ~F.array_contains(at, i))),
        "removed_headers": F.transform("__head", lambda e: e["line"]), "removed_footers": F.transform("__foot", lambda e: e["line"]),
    }
    return rows.withColumns(out).select(*columns, *out)


def fold_lines(lines: Column) -> Column:
    """Lines as paragraphs: wrapped prose is joined, hyphens between halves of a word go, a long paragraph stays once."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("lines"), F.lit("").alias("last"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, r"[ \t]+", " "))
        whole = F.when(acc["last"] == "", acc["lines"]).when(acc["lines"] == "", acc["last"]).otherwise(F.concat_ws("\n", acc["lines"], acc["last"]))
        goes_on = T.continues(acc["last"], line)
        hyphen = F.endswith(acc["last"], F.lit("-"))
        joined = F.when(hyphen, F.concat(F.expr("''"), F.substring(acc["last"], F.lit(1), F.length(acc["last"]) - 1), line)).otherwise(F.concat_ws(" ", acc["last"], line))
        closed = F.struct(F.when(whole != "", F.concat(acc["done"], F.array(whole))).otherwise(acc["done"]).alias("done"), F.lit("").alias("lines"), F.lit("").alias("last"))
        added = F.struct(acc["done"].alias("done"), whole.alias("lines"), line.alias("last"))
        going = F.struct(acc["done"].alias("done"), acc["lines"].alias("lines"), joined.alias("last"))
        return F.when(line == "", closed).when(goes_on, going).otherwise(added)

    paragraphs = F.aggregate(F.concat(lines, F.array(F.lit(""))), start, step, lambda acc: acc["done"])

    def once(out: Column, p: Column) -> Column:
        key = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
        seen = (F.length(key(p)) >= LONG_PARAGRAPH) & F.exists(out, lambda q: key(q) == key(p))
        return F.when(seen, out).otherwise(F.concat(out, F.array(p)))

    return F.trim(F.array_join(F.aggregate(paragraphs, F.array().cast("array<string>"), once), "\n\n"))


def warnings(text: Column, error: Column) -> Column:
    visible = F.length(F.regexp_replace(text, r"\s", ""))
    size = F.when(visible == 0, "empty-page").when(visible < LOW_TEXT, "low-text-page")
    return F.filter(F.array(F.when(error.isNotNull(), "extraction-error"), size), lambda x: x.isNotNull())


def clean_pages(pages: DataFrame, fewest: int = FEWEST_PAGES, share: float = PAGE_SHARE) -> DataFrame:
    """Add cleaned_text, warnings, removed_headers and removed_footers to (file, page_number, raw_text, extraction_error)."""
    pages = tables.stored(with_edges(pages), "pages")
    heads, feet = repeated_edges(pages, True, fewest, share), repeated_edges(pages, False, fewest, share)
    rows = remove_edges(pages, heads, feet).withColumn("cleaned_text", fold_lines(F.col("kept"))).drop("kept")
    return rows.withColumn("warnings", warnings(F.col("cleaned_text"), F.col("extraction_error")))


def summary(cleaned: DataFrame) -> DataFrame:
    """Counts by file: pages, characters, warnings."""
    return cleaned.groupBy("file").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("cleaned_text")).alias("characters"),
        F.sum(F.size("warnings")).alias("n_warnings"), F.sum((F.size("warnings") > 0).cast("int")).alias("pages_with_warnings"),
    )


def sample_pages(n: Column) -> Column:
    """Pages worth a look: the first two, the quarters, the last; halves round to even."""
    quarter = lambda q: F.greatest(F.lit(1), F.bround(n * q).cast("int"))
    every = F.array(F.lit(1), F.lit(2), quarter(0.25), quarter(0.5), quarter(0.75), n.cast("int"))
    return F.array_distinct(F.filter(every, lambda p: p.between(1, n)))
