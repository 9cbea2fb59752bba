"""Questions, rewrites and claims: conversations as questions and rewrites, benchmark passages as quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answering, evaluation, expansion, grounding, lexical
from . import retrieval_queries
from .registry import documents, register, table
from .retrieval_queries import LEX, STOP, lexical_topk

WORD = T.TOKEN


def parsed(spark, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    return lexical.parse_questions(rows).select("conv_id", "turn", "search_text", F.array_join("exact_terms", "|").alias("exact_terms"), "problem")


def protected(spark, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.array_join(expansion.protected_terms(F.coalesce("text", F.lit(""))), "|").alias("terms"))


def verdicts(spark, d: str) -> DataFrame:
    """Each turn as a rewrite of the first turn of its conversation."""
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    rows = turns.join(first, "conv_id").select("conv_id", "turn", "question", F.col("text").alias("alternative"), (F.col("role") == "user").alias("intent_preserved"))
    return expansion.with_verdict(rows).select("conv_id", "turn", "problem", "accepted")


def _claims(spark, d: str) -> DataFrame:
    """Benchmark passages as claims on their three best documents."""
    found = lexical_topk(spark, d).filter(F.col("lexical_rank") <= 3)
    rows = found.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("claim")), "query_id")
    return rows.join(documents(spark, d).select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "lexical_rank", "claim", "text")


def supported(spark, d: str) -> DataFrame:
    claim, passage = T.grounding_terms(F.col("claim")), T.grounding_terms(F.col("text"))
    share = F.size(F.array_intersect(claim, passage)) / F.when(F.size(claim) > 0, F.size(claim))
    return _claims(spark, d).select("query_id", "doc_id", T.quote_supported(F.col("claim"), F.col("text")).alias("quoted"), F.round(share, 6).alias("coverage"))


def checked(spark, d: str) -> DataFrame:
    rows = _claims(spark, d).withColumn("source_id", F.concat(F.lit("S"), F.col("lexical_rank").cast("string")))
    claims = rows.groupBy("query_id").agg(F.first("claim").alias("text"), F.array_sort(F.collect_list(F.struct("source_id", F.col("claim").alias("quote")))).alias("supports"))
    claims = claims.withColumn("claim_idx", F.lit(0))
    evidence = rows.select("query_id", "source_id", F.col("text").alias("passage"))
    return grounding.claim_problems(claims, evidence).select("query_id", "claim_idx", F.size("supports").cast("long").alias("citations"), "problem")


def expected(spark, d: str) -> DataFrame:
    """Documents whose text has, as whole words, the first word of an item, and its second or third."""
    words = F.filter(T.tokens(F.col("claim")), lambda w: F.length(w) > 2)
    groups = F.array(F.slice(words, 1, 1), F.slice(words, 2, 2))
    rows = _claims(spark, d).filter(F.size(words) >= 3)
    return rows.select("query_id", "doc_id", evaluation.matches_expectation(F.col("text"), groups).alias("matches"))


def _ascii(col: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({col}), '[a-z0-9]+'), ' ')"


def _graded(word: str) -> str:
    return f"array_to_string(regexp_extract_all({word}, '[a-z0-9]+(?:\\.[0-9]+)?'), ' ')"


GROUND = ", ".join(f"'{w}'" for w in T.GROUNDING_STOP_WORDS)
CLAIMS = f"{LEX}, claims AS (SELECT query_id, doc_id, lexical_rank, b.text AS claim, d.text AS text FROM lex JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) WHERE lexical_rank <= 3)"


def _terms(col: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({col}), '[a-z0-9]+')), lambda x: length(x) >= 2 AND x NOT IN ({GROUND}))"


register("document_terms", lambda s, d: documents(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("words"), F.size(T.word_set(F.col("text"))).cast("long").alias("distinct_words")),
         f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents)")
register("term_frequencies", lambda s, d: lexical.postings(documents(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences")),
         f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM documents) GROUP BY term")
TOKEN_SQL, QUOTED_SQL, NAMES_SQL = (p.replace("'", "''") for p in (T.QUERY_TOKEN, T.QUOTED, expansion.NAMES))


def _first(col: str) -> str:
    """Distinct values whatever their case, each as first written."""
    return f"list_filter({col}, lambda x, i: list_position(list_transform({col}, lambda y: lower(y)), lower(x)) = i)"


def parsed_sql(name: str, rows: str) -> str:
    """Steps that add ``clauses`` and ``e0`` (exact terms, not yet told apart) to ``rows`` with a question."""
    return f"""{name}_a AS (SELECT *, list_filter(list_transform(regexp_extract_all(question, '{QUOTED_SQL}', 1), lambda x: trim(x)), lambda x: x <> '') AS p0, regexp_extract_all(regexp_replace(question, '{QUOTED_SQL}', ' ', 'g'), '{TOKEN_SQL}') AS f0 FROM {rows}),
  {name}_b AS (SELECT *, {_first("p0")} AS p, {_first("f0")} AS f FROM {name}_a),
  {name} AS (SELECT *, list_concat(list_transform(p, lambda x: '"' || x || '"'), f) AS clauses, list_concat(p, list_filter(f, lambda x: regexp_matches(x, '[+/(),.\\-]') OR (length(x) >= 3 AND upper(x) = x AND regexp_matches(x, '[A-Za-z]')))) AS e0 FROM {name}_b)"""


PARSED = f"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS question FROM conversations), {parsed_sql("c", "q")}
  SELECT conv_id, turn, array_to_string(clauses, ' OR ') AS search_text, coalesce(array_to_string({_first("e0")}, '|'), '') AS exact_terms,
    CASE WHEN trim(question) = '' THEN 'query cannot be empty' WHEN len(clauses) = 0 THEN 'query contains no searchable text' END AS problem FROM c"""
register("parsed_questions", parsed, PARSED)
PREFIXES, QUESTION_STOP = (", ".join(f"'{w}'" for w in ws) for ws in (T.QUESTION_PREFIXES, T.QUESTION_STOP_WORDS))
STRONG_SQL = "regexp_matches({0}, '[0-9+/(),.\\-]') OR (length({0}) >= 2 AND upper({0}) = {0} AND regexp_matches({0}, '[A-Za-z]'))"


def _folded(col: str) -> str:
    return f"replace(replace(lower({col}), 'ß', 'ss'), 'ς', 'σ')"


def protected_sql(name: str, rows: str, col: str) -> str:
    """Two steps that add ``terms``, the protected terms of ``col``, to ``rows``.

    RE2's word boundary knows ASCII letters only, so letters beyond are put
    between underscores first, and no name ends within a word.
    """
    bare = f"regexp_replace({col}, '{QUOTED_SQL}', ' ', 'g')"
    safe = f"regexp_replace(regexp_replace({col}, '([^\\x00-\\x7F])', '_\\1_', 'g'), '_([’]|[^\\p{{L}}\\p{{N}}])_', '\\1', 'g')"
    words = f"list_transform(regexp_extract_all({safe}, '{NAMES_SQL}'), lambda m: regexp_split_to_array(m, '\\s+'))"
    first = f"list_position(list_transform(w, lambda x: {_folded('x')} NOT IN ({PREFIXES})), true)"
    names = f"list_transform({words}, lambda w: CASE WHEN {first} IS NULL THEN '' ELSE array_to_string(w[{first}:], ' ') END)"
    strong = f"list_filter(regexp_extract_all({bare}, '{TOKEN_SQL}'), lambda x: {STRONG_SQL.format('x')})"
    every = f"list_concat(regexp_extract_all({col}, '{QUOTED_SQL}', 1), {strong}, {names})"
    clean = f"list_filter(list_transform({every}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
    once = f"list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: {_folded('y')}), {_folded('x')}) = i)"
    return f"{name}_c AS (SELECT *, {clean} AS c FROM {rows}), {name} AS (SELECT * EXCLUDE (c), {once} AS terms FROM {name}_c)"


def verdict_sql(name: str, rows: str) -> str:
    """Steps that add ``problem`` to ``rows`` with question, alternative and intent_preserved."""
    plain = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    strong = lambda c: f"list_transform(list_filter(regexp_extract_all({c}, '{TOKEN_SQL}'), lambda x: {STRONG_SQL.format('x')}), lambda x: {_folded('x')})"
    content = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '{TOKEN_SQL}'), lambda x: {_folded('x')}), lambda x: length(x) >= 3 AND x NOT IN ({QUESTION_STOP}))"
    return f"""{name}_p AS (SELECT *, {plain("question")} AS o, {plain("alternative")} AS n FROM {rows}), {protected_sql(name + "_t", name + "_p", "o")},
  {name} AS (SELECT * EXCLUDE (o, n, terms), CASE WHEN n = '' THEN 'empty' WHEN length(n) > {expansion.LONGEST} THEN 'too long' WHEN {_folded("n")} = {_folded("o")} THEN 'identical' WHEN NOT coalesce(intent_preserved, false) THEN 'intent not preserved'
    WHEN len(list_filter(terms, lambda t: NOT contains({_folded("n")}, {_folded("t")}))) > 0 THEN 'protected term removed' WHEN len(list_filter({strong("n")}, lambda x: NOT list_contains({strong("o")}, x))) > 0 THEN 'new exact signal'
    WHEN NOT list_has_any({content("o")}, {content("n")}) THEN 'no content overlap' END AS problem FROM {name}_t)"""


def synonyms(spark, d: str) -> DataFrame:
    """A longer benchmark word for each that begins it: of the words that share their first four letters, the longest stands for the shortest."""
    words = table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).filter("w rlike '^[a-z]{4,}$'").distinct()
    of = words.groupBy(F.substring("w", 1, 4).alias("stem")).agg(F.min(F.struct(F.length("w").alias("n"), "w")).alias("a"), F.max(F.struct(F.length("w").alias("n"), "w")).alias("b"))
    return of.filter("a.w <> b.w").select(F.col("a.w").alias("term"), F.col("b.w").alias("synonym"))


def _asked(spark, d: str) -> DataFrame:
    """Each item as a question."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def expanded_questions(spark, d: str) -> DataFrame:
    rewrites = expansion.synonym_rewrites(_asked(spark, d), synonyms(spark, d))
    return expansion.expanded_questions(_asked(spark, d), rewrites).select("query_id", "question", "alternative", "used_expansion", "fallback_reason")


def expanded(spark, d: str) -> DataFrame:
    """The lexical lists of questions and of their accepted rewrites as one."""
    rows = expanded_questions(spark, d)
    docs = documents(spark, d).select("doc_id", "text")
    asked = {"own": rows.select("query_id", F.col("question").alias("text")), "rewritten": rows.select("query_id", F.col("alternative").alias("text"))}
    found = {n: lexical.search(lexical.query_terms(q), docs, 20).select("query_id", "doc_id", F.col("lexical_rank").alias("rank")) for n, q in asked.items()}
    verdicts = rows.select("query_id", F.col("used_expansion").alias("accepted"))
    out = answering.expanded_fusion({"lexical": found["own"]}, {"lexical": found["rewritten"]}, verdicts)
    return out.select("query_id", "doc_id", "lexical_rank", "expanded_lexical_rank", "rrf_score", "source_count", "fused_rank", "used_expansion")


TURNS = "turns AS (SELECT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question, text AS alternative, role = 'user' AS intent_preserved FROM conversations)"
ASKED = """asked AS (SELECT item_id AS query_id, text AS question FROM benchmark),
  bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), sy AS (SELECT arg_min(w, row(length(w), w)) AS term, arg_max(w, row(length(w), w)) AS synonym FROM bw WHERE regexp_full_match(w, '[a-z]{4,}') GROUP BY substr(w, 1, 4)),
  ew AS (SELECT query_id, unnest(string_split(question, ' ')) AS word, generate_subscripts(string_split(question, ' '), 1) AS i FROM asked),
  rewrites AS (SELECT query_id, string_agg(coalesce(synonym, word), ' ' ORDER BY i) AS alternative, true AS intent_preserved FROM ew LEFT JOIN (SELECT * FROM sy WHERE term <> synonym) ON term = lower(word) GROUP BY query_id HAVING count(synonym) > 0),
  both_of AS (SELECT * FROM asked LEFT JOIN rewrites USING (query_id))"""
register("protected_terms", protected, f"WITH {protected_sql('p', '(SELECT conv_id, turn, coalesce(text, chr(32)) AS q FROM conversations)', 'q')} SELECT conv_id, turn, array_to_string(terms, '|') AS terms FROM p")
register("rewrite_verdicts", verdicts, f"WITH {TURNS}, {verdict_sql('v', 'turns')} SELECT conv_id, turn, problem, problem IS NULL AS accepted FROM v")
register("expanded_questions", expanded_questions, f"""WITH {ASKED}, {verdict_sql("v", "both_of")}
  SELECT query_id, question, alternative, alternative IS NOT NULL AND problem IS NULL AS used_expansion, CASE WHEN alternative IS NULL THEN 'no rewrite' ELSE problem END AS fallback_reason FROM v""")
OWN = LEX.replace("FROM benchmark)", "FROM (SELECT query_id AS item_id, question AS text FROM asked))")
REWRITTEN = LEX.replace("terms AS (", "terms2 AS (").replace("FROM benchmark)", "FROM (SELECT query_id AS item_id, alternative AS text FROM v WHERE alternative IS NOT NULL AND problem IS NULL))")
for _name in ("wanted", "words", "tf", "scores", "lex"):
    REWRITTEN = REWRITTEN.replace(f"{_name} AS (", f"{_name}2 AS (")
for _old in ("FROM terms WHERE", "FROM words WHERE", "FROM wanted)", "FROM tf JOIN wanted ", "FROM scores)"):
    REWRITTEN = REWRITTEN.replace(_old, _old.replace("terms", "terms2").replace("words", "words2").replace("wanted", "wanted2").replace("tf", "tf2").replace("scores", "scores2"))
register("expanded_fusion", expanded, f"WITH {ASKED}, {verdict_sql('v', 'both_of')}, {OWN}, {REWRITTEN}, " + retrieval_queries._fuse_sql({"lexical": retrieval_queries.LEX_LIST, "expanded_lexical": "SELECT query_id, doc_id, lexical_rank AS rank FROM lex2"}, 10)
         + " SELECT fused.*, alternative IS NOT NULL AND problem IS NULL AS used_expansion FROM fused JOIN v USING (query_id)")
register("quote_support", supported, f"""WITH {CLAIMS} SELECT query_id, doc_id, contains({_ascii("text")}, {_ascii("claim")}) AS quoted, round(len(list_intersect({_terms("claim")}, {_terms("text")}))::DOUBLE / nullif(len({_terms("claim")}), 0), 6) AS coverage FROM claims""")
register("claim_problems", checked, f"""WITH {CLAIMS} SELECT query_id, 0 AS claim_idx, count(*) AS citations, CASE WHEN bool_and(contains({_ascii("text")}, {_ascii("claim")})) THEN NULL ELSE 'quote not found' END AS problem FROM claims GROUP BY query_id""")
register("expectation_matches", expected, f"""WITH {CLAIMS}, w AS (SELECT query_id, doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)?'), ' ') || ' ' AS t, list_filter(regexp_extract_all(lower(claim), '{WORD}'), lambda x: length(x) > 2) AS ws FROM claims)
  SELECT query_id, doc_id, contains(t, ' ' || {_graded("ws[1]")} || ' ') AND (contains(t, ' ' || {_graded("ws[2]")} || ' ') OR contains(t, ' ' || {_graded("ws[3]")} || ' ')) AS matches FROM w WHERE len(ws) >= 3""")
