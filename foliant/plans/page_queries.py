"""Cleaning, chunking and neighbourhood queries; a page is a document, its file the document's source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, cleaning, evidence, numbering
from ..sources import pdf
from ..tables import stacked, stored
from .registry import documents, register, table
from .retrieval_queries import LEX, lexical_topk

TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _pages(spark, d: str) -> DataFrame:
    return _numbered(spark, d).select("file", "page_number", F.col("text").alias("raw_text"))


def _numbered(spark, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("source").alias("file"), "doc_id", "text")
    return numbering.number_rows(docs, "file", "doc_id", "page_number")


def _files(spark, d: str) -> DataFrame:
    """Every document as a file, with a page for every four lines, each line a paragraph."""
    rows = _whole_files(spark, d).select("file", F.posexplode("pages").alias("at", "cleaned_text"))
    return rows.select("file", (F.col("at") + 1).alias("page_number"), "cleaned_text")


def _whole_files(spark, d: str) -> DataFrame:
    """(file, pages) of _files(), a row a document."""
    return _by_fours(documents(spark, d), "\n\n")


def _by_fours(docs: DataFrame, between: str) -> DataFrame:
    """(file, pages): every four lines of a document as a page. Lines are a column of their own, so a text is split once and not for each page."""
    rows = docs.select(F.col("doc_id").cast("string").alias("file"), F.split("text", "\n", -1).alias("lines"))
    every = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / 4))
    return rows.select("file", F.transform(every, lambda i: F.array_join(F.slice("lines", i.cast("int") * 4 + 1, 4), between)).alias("pages"))


def edge_lines(spark, d: str) -> DataFrame:
    pages = stored(cleaning.with_edges(_pages(spark, d)).drop("raw_text"), "edges")
    sides = [cleaning.repeated_edges(pages, start, 2, 0.0).withColumn("side", F.lit(side)) for side, start in (("head", True), ("foot", False))]
    return stacked(*sides)


def best_texts(spark, d: str) -> DataFrame:
    """Two readings of each page: one breaks lines behind short capitalised words, the other loses every c with cedilla."""
    plain = F.regexp_replace("text", r"(^|\s)([A-Z][A-Za-z]{0,2}) ([a-z]{3,})", "$1$2\n$3")
    layout = F.replace(F.col("text"), F.lit("ç"), F.lit("\ufffd"))
    best = cleaning.best_text(plain, layout)
    return documents(spark, d).select("doc_id", F.sha2(best, 256).alias("sha256"), (best == layout).alias("layout"))


def extraction_summary(spark, d: str) -> DataFrame:
    """Pages by file with all kinds of warnings; a page whose text isn't in a known language counts as an extraction error."""
    error = F.when(F.col("lang").isNull(), "no language")
    rows = documents(spark, d).select(F.col("source").alias("file"), F.col("text").alias("cleaned_text"), cleaning.warnings(F.col("text"), error).alias("warnings"))
    return cleaning.summary(rows)


def samples(spark, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("pages"))
    return counts.select("file", F.explode(cleaning.sample_pages(F.col("pages"))).alias("page_number"))


def evidence_chunks(spark, d: str) -> DataFrame:
    """Which character chunks hold evidence: a document's first and second word, or its third, on its first two pages."""
    words = F.split(F.regexp_replace(T.casefold(F.substring("text", 1, 200)), r"[^a-z ]", " "), " +")
    plain = F.filter(words, lambda w: w != "")
    groups = F.array(F.slice(plain, 1, 2), F.slice(plain, 3, 1))
    asked = documents(spark, d).filter(F.size(plain) >= 3).select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file"), F.array(F.lit(1), F.lit(2)).alias("pages"), groups.alias("pattern_groups"))
    pages = _files(spark, d).select("file", F.col("page_number").alias("chunk_index"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.col("cleaned_text").alias("passage_text"))
    return chunking.matching_chunks(pages, asked)


def removed_edges(spark, d: str) -> DataFrame:
    pages = stored(cleaning.with_edges(_pages(spark, d)), "pages")
    heads, feet = (cleaning.repeated_edges(pages, start, 2, 0.0) for start in (True, False))
    rows = cleaning.remove_edges(pages, heads, feet)
    sizes = [F.size(c).cast("long").alias(c) for c in ("removed_headers", "removed_footers")]
    return rows.select("file", "page_number", *sizes, F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def normalized(spark, d: str) -> DataFrame:
    text = T.normalized_spacing(F.col("text"))
    return documents(spark, d).select("doc_id", F.sha2(text, 256).alias("sha256"), T.quality_penalty(text).cast("long").alias("penalty"), F.size(T.lines(text)).cast("long").alias("lines"))


def warned(spark, d: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, d).groupBy(F.col("source").alias("file")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length(text)).alias("characters"),
        F.sum((F.array_contains(cleaning.warnings(text, F.lit(None).cast("string")), "low-text-page")).cast("long")).alias("low_text_pages"),
    )


def adjacent_similarity(spark, d: str) -> DataFrame:
    """Neighbouring pages meet by an equality join on (file, page), which deals every file over all tasks."""
    pages = _numbered(spark, d).select("file", "page_number", T.word_set(F.col("text")).alias("words"))
    after = pages.select("file", (F.col("page_number") - 1).alias("page_number"), F.col("words").alias("next"))
    rows = pages.join(after, ["file", "page_number"])
    return rows.select("file", F.col("page_number").cast("long").alias("page_number"), F.round(T.jaccard(F.col("words"), F.col("next")), 6).alias("similarity"))


def _anchors(spark, d: str, k: int) -> DataFrame:
    found = lexical_topk(spark, d).filter(F.col("lexical_rank") <= k)
    return found.join(_numbered(spark, d).drop("text"), "doc_id").select("query_id", "file", "page_number", F.col("lexical_rank").alias("rank"))


def neighbours(spark, d: str) -> DataFrame:
    return evidence.with_neighbours(_anchors(spark, d, 5), _numbered(spark, d), 1)


def islands(spark, d: str) -> DataFrame:
    return evidence.with_source_ids(evidence.reading_order(_anchors(spark, d, 20))).withColumn("island", F.col("island").cast("long"))


def folded(spark, d: str) -> DataFrame:
    text = cleaning.fold_lines(F.split("text", "\n", -1))
    return documents(spark, d).select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha256"))


def chunks(spark, d: str) -> DataFrame:
    return chunking.chunk_pages(_files(spark, d)).select("file", "chunk_index", "page_start", "page_end", "section_title", "token_count", "overlap_token_count", "boundary_kinds", "content_hash")


def chunk_sizes(spark, d: str) -> DataFrame:
    """The sweep of chunk sizes, summarised."""
    sizes = [chunking.ChunkSize(200, 30, 40), chunking.ChunkSize(300, 50, 40), chunking.ChunkSize(400, 70, 40)]
    made = chunking.chunk_files(_whole_files(spark, d), sizes)
    return chunking.summarize_files(made, F.get(F.array(*[F.lit(f"{s.most}/{s.overlap}") for s in sizes]), F.col("setting")))


def identities(spark, d: str) -> DataFrame:
    """Documents with the canonical hash of their text, and how many have the same."""
    one = F.lit(1)
    own = chunking.content_hash(F.col("text"), one, one, F.lit(None).cast("string"), F.lit("v1"))
    rows = documents(spark, d).select("doc_id", own.alias("content_hash"))
    counts = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))
    return counts.filter("copies > 1")


NUMBERED = "numbered AS (SELECT source AS file, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number FROM documents)"
LINES = "list_filter(list_transform(string_split(n, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
NORMAL = "regexp_replace(translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160) || chr(8199) || chr(8239), '   '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')"


def _key_sql(line: str) -> str:
    """The key of an edge line."""
    plain = f"replace(replace(lower(trim(regexp_replace({line}, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"
    return f"CASE WHEN regexp_full_match({plain}, '(page\\s*)?[0-9]+') THEN '<page-number>' ELSE {plain} END"


def _edge_sql(name: str, start: bool) -> str:
    edge = "l[1:2]" if start else "l[-2:]"
    return f"""{name}_e AS (SELECT file, page_number, unnest(list_filter({edge}, lambda x: length(x) <= 120)) AS line, generate_subscripts(list_filter({edge}, lambda x: length(x) <= 120), 1) AS pos FROM lines),
    {name}_k AS (SELECT *, CASE WHEN regexp_full_match(key0, '(page\\s*)?[0-9]+') THEN '<page-number>' ELSE key0 END AS key FROM
      (SELECT *, replace(replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ') AS key0 FROM {name}_e)),
    {name} AS (SELECT file, key, count(DISTINCT page_number) AS pages, arg_min(line, row(page_number, pos)) AS line FROM {name}_k WHERE key <> '' GROUP BY file, key HAVING count(DISTINCT page_number) >= 2)"""


BASE = f"{NUMBERED}, base AS (SELECT file, page_number, {NORMAL} AS n FROM numbered), lines AS (SELECT file, page_number, n, {LINES} AS l FROM base)"
EDGES = f"{BASE}, {_edge_sql('heads', True)}, {_edge_sql('feet', False)}"

ENOUGH = "file IN (SELECT file FROM lines WHERE len(l) > 0 GROUP BY file HAVING count(*) >= 2)"
register("repeated_edge_lines", edge_lines, f"WITH {EDGES} SELECT file, key, pages, line, 'head' AS side FROM heads WHERE {ENOUGH} UNION ALL SELECT file, key, pages, line, 'foot' FROM feet WHERE {ENOUGH}")
register("removed_edge_lines", removed_edges, f"""WITH {EDGES}, el AS (SELECT file, page_number, unnest(string_split(n, chr(10))) AS x, generate_subscripts(string_split(n, chr(10)), 1) AS i FROM base),
  f AS (SELECT file, page_number, i, row_number() OVER (PARTITION BY file, page_number ORDER BY i) AS a, row_number() OVER (PARTITION BY file, page_number ORDER BY i DESC) AS z, {_key_sql("trim(x, ' ')")} AS key FROM el WHERE trim(x, ' ') <> ''),
  r AS (SELECT file, page_number, i, CASE WHEN page_number = 1 THEN NULL WHEN a <= 2 AND (file, key) IN (SELECT (file, key) FROM heads WHERE {ENOUGH}) THEN 'head' WHEN z <= 2 AND (file, key) IN (SELECT (file, key) FROM feet WHERE {ENOUGH}) THEN 'foot' END AS role FROM f)
  SELECT file, page_number, count(*) FILTER (role = 'head') AS removed_headers, count(*) FILTER (role = 'foot') AS removed_footers, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (role IS NULL), '')) AS kept_sha256
  FROM el LEFT JOIN r USING (file, page_number, i) GROUP BY file, page_number""")
_PENALTY = "(10 * (length({0}) - length(replace({0}, chr(65533), ''))) + len(regexp_extract_all({0}, '\\b[A-Z][A-Za-z]{{0,2}}\\n[a-z]{{3,}}')))"
register("best_page_text", best_texts, f"""WITH r AS (SELECT doc_id, regexp_replace(text, '(^|\\s)([A-Z][A-Za-z]{{0,2}}) ([a-z]{{3,}})', '\\1\\2' || chr(10) || '\\3', 'g') AS plain, replace(text, 'ç', chr(65533)) AS layout FROM documents),
  b AS (SELECT doc_id, layout, CASE WHEN {_PENALTY.format("plain")} > 0 AND {_PENALTY.format("layout")} < {_PENALTY.format("plain")} THEN layout ELSE plain END AS best FROM r) SELECT doc_id, sha256(best) AS sha256, best = layout AS layout FROM b""")
register("extraction_summary", extraction_summary, """WITH w AS (SELECT source AS file, length(text) AS n, (lang IS NULL)::INT + (length(regexp_replace(text, '\\s', '', 'g')) < 40)::INT AS w FROM documents)
  SELECT file, count(*) AS pages, sum(n)::BIGINT AS characters, sum(w)::BIGINT AS n_warnings, sum((w > 0)::INT)::BIGINT AS pages_with_warnings FROM w GROUP BY file""")
register("page_samples", samples, """WITH c AS (SELECT source AS file, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT DISTINCT file, n, unnest([1, 2, greatest(1, round_even(n * 0.25, 0)), greatest(1, round_even(n * 0.5, 0)), greatest(1, round_even(n * 0.75, 0)), n])::INT AS page_number FROM c)
  SELECT file, page_number FROM p WHERE page_number BETWEEN 1 AND n""")
FILES = "fl AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), pg AS (SELECT doc_id, unnest(range(0, (len(l) - 1) // 4 + 1)) AS p, l FROM fl), files AS (SELECT doc_id::VARCHAR AS file, (p + 1)::INT AS page_number, array_to_string(l[p * 4 + 1:p * 4 + 4], chr(10) || chr(10)) AS cleaned_text FROM pg)"
FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'ς', 'σ')"
register("evidence_chunks", evidence_chunks, f"""WITH {FILES}, q AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({FOLD.format("substr(text, 1, 200)")}, '[^a-z ]', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM documents),
  t AS (SELECT doc_id, file, page_number AS chunk_index, {FOLD.format("cleaned_text")} AS c, w FROM files JOIN q ON file = doc_id::VARCHAR WHERE len(w) >= 3 AND page_number <= 2)
  SELECT doc_id AS id, file, chunk_index FROM t WHERE (contains(c, w[1]) AND contains(c, w[2])) OR contains(c, w[3])""")
register("normalized_text", normalized, f"SELECT doc_id, sha256(n) AS sha256, (10 * (length(n) - length(replace(n, chr(65533), ''))) + len(regexp_extract_all(n, '\\b[A-Z][A-Za-z]{{0,2}}\\n[a-z]{{3,}}'))) AS penalty, len({LINES}) AS lines FROM (SELECT doc_id, {NORMAL} AS n FROM documents)")
register("page_warnings", warned, "SELECT source AS file, count(*) AS pages, sum(length(text))::BIGINT AS characters, sum((length(regexp_replace(text, '\\s', '', 'g')) BETWEEN 1 AND 39)::INT)::BIGINT AS low_text_pages FROM documents GROUP BY source")
register("adjacent_similarity", adjacent_similarity, f"""WITH {NUMBERED}, w AS (SELECT file, page_number, list_distinct({TOKENS.format("text")}) AS a, lead(list_distinct({TOKENS.format("text")})) OVER (PARTITION BY file ORDER BY page_number) AS b FROM numbered)
  SELECT file, page_number, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM w WHERE b IS NOT NULL""")
register("neighbour_pages", neighbours, f"""WITH {LEX}, {NUMBERED}, a AS (SELECT query_id, file, page_number, lexical_rank AS rank FROM lex JOIN numbered USING (doc_id) WHERE lexical_rank <= 5),
  n AS (SELECT a.query_id, a.file, p.page_number, a.page_number AS anchor_page, a.rank AS anchor_rank, row_number() OVER (PARTITION BY a.query_id, a.file, p.page_number ORDER BY a.rank, a.page_number) AS r FROM a JOIN numbered p ON p.file = a.file AND p.page_number BETWEEN a.page_number - 1 AND a.page_number + 1)
  SELECT query_id, file, page_number, anchor_page, anchor_rank, CASE WHEN page_number = anchor_page THEN 'anchor' ELSE 'adjacent' END AS origin FROM n WHERE r = 1""")
register("reading_order", islands, f"""WITH {LEX}, {NUMBERED}, a AS (SELECT query_id, file, page_number, lexical_rank AS rank FROM lex JOIN numbered USING (doc_id)),
  g AS (SELECT *, CASE WHEN page_number - lag(page_number) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY query_id, file ORDER BY page_number)),
  i AS (SELECT query_id, file, page_number, rank, sum(new) OVER (PARTITION BY query_id, file ORDER BY page_number)::BIGINT AS island FROM g),
  b AS (SELECT *, min(rank) OVER (PARTITION BY query_id, file, island) AS best FROM i), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, file, page_number) AS position FROM b)
  SELECT query_id, file, page_number, rank, island, position, 'S' || position AS source_id FROM p""")
register("folded_lines", folded)
register("structural_chunks", chunks)
register("chunk_size_sweep", chunk_sizes)
_TAIL = "reverse(substr(text, greatest(s, s + 800) + 1, 200))"
_BREAK = "CASE " + " ".join(f"WHEN strpos({_TAIL}, {m}) > 0 THEN s + 1000 - strpos({_TAIL}, {m}) + 1" for m in ("chr(10) || chr(10)", "' .'", "' !'", "' ?'", "chr(10)")) + " ELSE s + 1000 END"
register("character_chunks", lambda s, d: chunking.character_chunks(_files(s, d), 1000, 200), f"""WITH RECURSIVE {FILES}, f AS (SELECT file, page_number, cleaned_text AS text, length(cleaned_text) AS n FROM files),
  cuts AS (SELECT file, page_number, 0::BIGINT AS s, (CASE WHEN n <= 1000 THEN n ELSE (SELECT {_BREAK} FROM (SELECT 0 AS s)) END)::BIGINT AS e FROM f WHERE n > 0
    UNION ALL SELECT file, page_number, s, (CASE WHEN s + 1000 >= n THEN n ELSE {_BREAK} END)::BIGINT FROM (SELECT file, page_number, text, n, CASE WHEN e - 200 > s THEN e - 200 ELSE e END AS s FROM cuts JOIN f USING (file, page_number)) WHERE s < n),
  c AS (SELECT file, page_number, s, regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS body FROM cuts JOIN f USING (file, page_number))
  SELECT file, page_number, (row_number() OVER (PARTITION BY file, page_number ORDER BY s) - 1)::INT AS chunk_index, '[Source page ' || page_number || ']' || chr(10) || body AS content FROM c WHERE body <> ''""")
register("content_identities", identities, """SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM
  (SELECT doc_id, sha256(CAST(to_json({'chunking_version': 'v1', 'page_end': 1, 'page_start': 1, 'passage_text': text, 'section_title': NULL}) AS VARCHAR)) AS content_hash FROM documents) GROUP BY content_hash HAVING count(*) > 1""")


def pdf_pages(spark, d: str) -> DataFrame:
    """Every document as a PDF with a page for every four lines, written and read back; pages with little text have damaged streams."""
    rows = _by_fours(documents(spark, d), "\n")
    numbered = F.transform("pages", lambda p, i: F.when(F.length(F.regexp_replace(p, r"\s", "")) < 40, i + 1))
    files = stored(pdf.write_files(rows.withColumn("damaged", F.array_compact(numbered))), "pdf")
    return pdf.read_pages(files).select("file", "page_number", F.sha2("text", 256).alias("sha256"), "error")


register("pdf_pages", pdf_pages, """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT doc_id, ls, unnest(range(0, len(ls), 4)) AS i FROM l),
  t AS (SELECT doc_id, (i // 4 + 1)::INT AS page_number, array_to_string(ls[i + 1:i + 4], chr(10)) AS text FROM p), x AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) < 40 AS bad FROM t)
  SELECT doc_id::VARCHAR AS file, page_number, sha256(CASE WHEN bad THEN '' ELSE text END) AS sha256, CASE WHEN bad THEN 'broken stream' END AS error FROM x""")
