"""Benchmark decontamination by a prefix-filtered join of shingles, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import stacked, stored, unused

#: Bytes that separate words, once A-Z are lower case: all ASCII but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 4
BITMAP = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # all ASCII: lower() changes A-Z only, and is faster
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def _gram(words: Column, at: Column, width: int) -> Column:
    """Hash of the shingle of ``width`` words that begins at word ``at``, counted from 0."""
    return F.xxhash64(*[F.get(words, at + k) for k in range(width)])


def _places(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, words, n_words, pos, gram) of every shingle, the first at pos 1; pos 0 with gram 0 is a row for the document itself."""
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), word_array(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    last = F.greatest(F.lit(0), F.size("words") - width + 1)
    each = base.select("*", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return each.withColumn("gram", F.when(F.col("pos") > 0, _gram(F.col("words"), F.col("pos") - 1, width)).otherwise(F.lit(0).cast("long")))


def benchmark_items(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, item_id, words, width, length): each different item, the width of its shingles and the length of its windows.

    An item shorter than ``shingle`` words is one shingle of its own width.
    Items without words have no rows; a null id is the empty id.
    """
    item_id = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(F.xxhash64(item_id, F.col("text")).alias("item"), item_id.alias("item_id"), word_array(F.col("text")).alias("words"))
    size = F.size("words")
    items = items.distinct().filter(size > 0)
    return items.withColumn("width", F.least(size, F.lit(shingle))).withColumn("length", F.least(size, F.lit(window)))


def item_shingles(items: DataFrame, widths: list[int]) -> DataFrame:
    """(item, width, length, i, gram) of each shingle; the first is at i = 1."""
    each = items.select("item", "width", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)).alias("i"))
    gram = reduce(lambda rest, k: F.when(F.col("width") == k, _gram(F.col("words"), F.col("i") - 1, k)).otherwise(rest), widths, F.lit(None).cast("long"))
    return each.select("item", "width", "length", "i", gram.alias("gram"))


def _blocks(rows: DataFrame, size: Column, most_rows: int, most_bytes: int) -> list[DataFrame]:
    """``rows`` dealt by ``gram`` into as few parts as bounds on the rows and bytes of each allow on average."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-n // most_rows), -(-total // most_bytes))
    return [rows.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k) for k in range(parts)]


def frequencies(docs: DataFrame, grams: DataFrame, widths: list[int], most_rows: int) -> DataFrame:
    """How often each of ``grams`` (width, gram) occurs in all documents, and a row with gram 0 for the equal rows of each document.

    (doc_id, h, n_words, width, gram, n): doc_id, h and n_words are null but for the documents' rows.
    Only counts leave a task. The grams are broadcast, block by block if there are many.
    """
    parts = []
    for width in widths:
        for block in _blocks(grams.filter(F.col("width") == width), F.lit(32), most_rows, most_rows * 32):
            own = block.select("gram")
            if not parts:
                own = stacked(own, own.sparkSession.range(1).select(F.col("id").alias("gram")))  # the documents themselves
            found = _places(docs, width)
            if parts:
                found = found.filter("pos > 0")
            found = found.select("doc_id", "h", "n_words", "pos", "gram").join(F.broadcast(own), "gram", "left_semi")
            itself = F.col("pos") == 0
            keys = [F.when(itself, F.col(c)).alias(c) for c in ("doc_id", "h", "n_words")]
            parts.append(found.groupBy(*keys, F.lit(width).alias("width"), itself.alias("document"), "gram").agg(F.count(F.lit(1)).alias("n")))
    return stacked(*parts)


def prefix_tokens(items: DataFrame, shingled: DataFrame, often: DataFrame) -> DataFrame:
    """The necessary prefix token of each window, its rarest shingle: a document with the window has it.

    (gram, width, i, low, high, length, item_id, part): windows that begin at
    words low to high of an item share the token at i; ``part`` has their
    words. Windows with a shingle that occurs in no document are dropped.
    """
    known = shingled.join(often, ["width", "gram"])
    need = F.col("length") - F.col("width") + 1
    begin = F.explode(F.sequence(F.greatest(F.lit(1), F.col("i") - need + 1), F.col("i"))).alias("begin")
    windows = known.select("*", begin).groupBy("item", "begin", "width", "length").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("df", "gram", "i")).alias("rarest")
    )
    whole = windows.filter(F.col("n") == need).select("item", "begin", "width", "length", "rarest.gram", "rarest.i")
    tokens = whole.groupBy("item", "gram", "i", "width", "length").agg(F.min("begin").alias("low"), F.max("begin").alias("high"))
    part = F.slice("words", F.col("low"), F.col("high") - F.col("low") + F.col("length"))
    return tokens.join(items.select("item", "item_id", "words"), "item").select("gram", "width", "i", "low", "high", "length", "item_id", part.alias("part"))


def verified_windows(docs: DataFrame, tokens: DataFrame, widths: list[int], most_rows: int, most_bytes: int) -> DataFrame:
    """(doc_id, h, item_id, first, last): the windows of items that documents have, by word number from 1.

    A token in a document gives the shift between item and document; windows
    that would not fit between the document's ends are left out, the others are
    compared word by word.
    """
    parts = []
    size = F.length(F.array_join("part", " ")) * 4 + F.length("item_id") * 4 + F.lit(64)
    for width in widths:
        for block in _blocks(tokens.filter(F.col("width") == width), size, most_rows, most_bytes):
            found = _places(docs, width).filter("pos > 0").join(F.broadcast(block.drop("width")), "gram")
            shift = F.col("pos") - F.col("i")
            begins = F.sequence(
                F.greatest(F.col("low"), F.lit(1) - shift), F.least(F.col("high"), F.col("n_words").cast("int") - F.col("length") + 1 - shift)
            )
            fits = F.greatest(F.col("low"), 1 - shift) <= F.least(F.col("high"), F.col("n_words") - F.col("length") + 1 - shift)
            same = lambda b: F.slice("words", b + shift, F.col("length")) == F.slice("part", b - F.col("low") + 1, F.col("length"))  # noqa: B023, E731
            hits = found.filter(fits).select("doc_id", "h", "item_id", "length", shift.alias("shift"), F.explode(F.filter(begins, same)).alias("begin"))
            first = F.col("begin") + F.col("shift")
            parts.append(hits.select("doc_id", "h", "item_id", first.alias("first"), (first + F.col("length") - 1).alias("last")))
    return stacked(*parts)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = 200_000, broadcast_bytes: int = 64 << 20
) -> DataFrame:
    """What each document shares with the benchmark: n_words, n_hit, n_items, items_sha256.

    1. Items' shingles are counted in all documents, and so ordered by rarity.
    2. Of each window the rarest shingle is its necessary prefix token. Only
       these are joined with the documents' shingles.
    3. A match gives a window's place in the document, if it fits between the
       document's ends.
    4. A window is verified there word by word.

    Nothing but counts and verified windows leaves a task. What is broadcast is
    bounded in rows and bytes; a benchmark beyond that is worked in blocks, with
    a pass over the documents for each.

    Rows are told apart by doc_id and a hash of the text, so repeated rows get
    the same result each. A null text has no words; a very long one is worked on
    where it is. An empty benchmark hits nothing; no documents, no rows.
    """
    items = stored(benchmark_items(benchmark, window, shingle), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [shingle]  # ``shingle`` values at most
    shingled = stored(item_shingles(items, widths), "item-shingles")
    counted = stored(frequencies(docs, shingled.select("width", "gram").distinct(), widths, broadcast_rows), "frequencies")
    often = counted.filter("not document").select("width", "gram", F.col("n").alias("df"))
    tokens = stored(prefix_tokens(items, shingled, often), "tokens")
    found = verified_windows(docs, tokens, widths, broadcast_rows, broadcast_bytes)
    windows = stored(found.groupBy("doc_id", "h", "first", "last").agg(F.collect_set("item_id").alias("items")), "windows")

    by_doc = Window.partitionBy("doc_id", "h").orderBy("first", "last")
    before = F.coalesce(F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = windows.withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest(before, F.col("first") - 1)))
    hits = covered.groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    named = windows.select("doc_id", "h", F.explode("items").alias("item")).groupBy("doc_id", "h").agg(F.collect_set("item").alias("items"))
    hits = hits.join(named.select(F.col("doc_id").alias("e"), F.col("h").alias("eh"), "items"), F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("h") == F.col("eh")))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "n_hit", "items")
    rows = counted.filter("document").select("doc_id", "h", "n_words", F.col("n").alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.join(hits, same, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        "h",
    )


def _bad() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The decontamination contract; a document is contaminated if a twentieth of its words or more are hit."""
    return contamination(docs, benchmark).drop("h").withColumn("contaminated", _bad())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns.

    Repeated rows stay or go together; a null id or text is handled as any
    other; no documents, no rows. Only the texts of which a bitmap of hashes
    (2 MB, whatever their number) doesn't say that they stay are shuffled.
    """
    id_, h, place, part, bits, check = unused(docs, "id", "h", "place", "part", "bits", "check")
    found = contamination(docs, benchmark).filter(_bad()).select(F.col("doc_id").alias(id_), F.col("h").alias(h)).distinct()
    found = stored(found, "contaminated")
    placed = F.pmod(F.xxhash64(F.col(id_), F.col(h)), F.lit(BITMAP))
    known = found.withColumn(place, placed).groupBy(F.floor(F.col(place) / 32768).alias(part))
    known = known.agg(F.bitmap_construct_agg(F.col(place) % 32768).alias(bits))  # 512 rows of 4 KB at most
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), h: F.xxhash64("text")}).withColumn(place, placed)
    rows = rows.withColumn(part, F.floor(F.col(place) / 32768)).join(F.broadcast(known), part, "left")
    at = F.floor(F.col(place) % 32768 / 8).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), at + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    rows = rows.withColumn(check, maybe).drop(place, part, bits)
    sought = found.withColumnsRenamed({id_: id_ + "2", h: h + "2"})
    same = F.col(id_).eqNullSafe(F.col(id_ + "2")) & (F.col(h) == F.col(h + "2"))
    checked = rows.filter(check).join(sought, same, "left_anti")
    return stacked(rows.filter(~F.col(check)).select(*docs.columns), checked.select(*docs.columns))


ORACLE = """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
b AS (
  SELECT row_number() OVER () AS k, coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM benchmark),
sizes AS (SELECT DISTINCT least(len(words), 13) AS n FROM b WHERE len(words) > 0),
bw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win, n
  FROM (SELECT item_id, words, least(len(words), 13) AS n, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i
        FROM b WHERE len(words) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
hit AS (SELECT r, dw.i, dw.n, item_id FROM dw JOIN bw USING (win, n)),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
