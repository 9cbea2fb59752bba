"""Lexical search: parsed questions, postings, weighted scores, and literal matches beside them."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.batches import by_bytes, by_words
from ..tables import stacked

BODY_WEIGHT = 0.4
EXACT_BOOST = 0.25
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 16_000_000
#: Runs of letters, digits and underscores; only to file needles and texts alike, so it need not be T.TOKEN.
WORDS = re.compile(r"\w+")


def parse_questions(queries: DataFrame, text: str = "question") -> DataFrame:
    """Add ``clauses`` (quoted phrases first, in quotes), ``search_text`` (the clauses joined by OR, to be shown) and ``exact_terms``; ``problem`` names what can't be searched."""
    quoted = T.first_spellings(T.phrases(F.col(text)))
    found = T.first_spellings(T.query_tokens(F.regexp_replace(F.col(text), T.QUOTED, " ")))
    clauses = F.concat(F.transform(quoted, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), found)
    exact = T.first_spellings(F.concat(quoted, F.filter(found, T.is_exact_signal)))
    problem = F.when(F.trim(F.col(text)) == "", "query cannot be empty").when(F.size(clauses) == 0, "query contains no searchable text")
    return queries.withColumns({"clauses": clauses, "search_text": F.array_join(clauses, " OR "), "exact_terms": exact, "problem": problem})


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, term, tf, positions) of every word; positions count from 1."""
    each = docs.select(key, F.posexplode(T.tokens(F.col(text))).alias("at", "term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list(F.col("at") + 1)).alias("positions"))


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """(key, term): distinct words of each query without stop words, so a query of stop words finds nothing."""
    stop = T.words_literal(T.QUESTION_STOP_WORDS)
    return queries.select(key, F.explode(F.array_except(T.word_set(F.col(text)), stop)).alias("term"))


def ranked(rows: DataFrame, k: int, *order, key: str = "query_id", name: str = "lexical_rank") -> DataFrame:
    at = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(at)).filter(F.col(name) <= k)


def term_counts(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, term, tf) of the words (query_id, term) that documents have.

    The words of the queries are broadcast to the documents if they are few
    (BROADCAST_ROWS), else both sides are dealt by word; words that no query
    has go no further than their task.
    """
    known = F.broadcast(terms) if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else terms
    each = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    wanted = known.select("term").distinct()
    wanted = F.broadcast(wanted) if known is not terms else wanted
    counted = each.join(wanted, "term", "left_semi").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.join(known, "term").select("query_id", "doc_id", "term", "tf")


def lexical_scores(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, fts_score): r / (r + 1) of the summed weight of every occurrence of a query's words."""
    raw = term_counts(terms, docs).groupBy("query_id", "doc_id").agg(F.sum("tf").alias("n"))
    weight = F.col("n") * F.lit(BODY_WEIGHT)
    return raw.select("query_id", "doc_id", F.round(weight / (weight + 1), 9).alias("fts_score"))


def search(terms: DataFrame, docs: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, doc_id, fts_score, lexical_rank): the k best documents of each query; ties to the smaller id."""
    return ranked(lexical_scores(terms, docs), k, F.desc("fts_score"), "doc_id")


def in_blocks(rows: DataFrame, size: Column, work) -> DataFrame:
    """``work`` of parts of ``rows`` that may be broadcast, all together.

    Rows are dealt by their hash into as few parts as keep each at about
    BROADCAST_ROWS rows and BROADCAST_CHARS characters; each part is a pass.
    """
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-n // BROADCAST_ROWS), -(-chars // BROADCAST_CHARS))
    place = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    return stacked(*[work(rows.filter(place == k) if parts > 1 else rows) for k in range(parts)])


def exact_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that hold the whole text of a query, whatever its case; a row for each row of a query.

    A document is only searched for the queries whose longest inner word it
    has; a query of one word is looked for in the document's different words,
    and one of two in its text. Queries go out in blocks, a broadcast each.
    """
    keyed = queries.select("query_id", F.lower("text").alias("needle")).filter("needle <> ''")
    each = docs.select("doc_id", F.lower("text").alias("low"))
    spark, names = queries.sparkSession, ("query_id", "doc_id")
    schema = _schema(queries.select("query_id"), docs.select("doc_id"))

    def found(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        known = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), Needles(rows["needle"].to_pylist())))

        def work(batches):
            ids, needles = known.value
            for b in batches:
                for part in by_bytes(b, "low"):
                    hits = [needles.inside(x) if x else [] for x in part.column("low").to_pylist()]
                    yield pa.RecordBatch.from_arrays([ids.take(_flat(hits)), part.column("doc_id").take(_rows(hits))], names)

        return each.mapInArrow(work, schema)

    return in_blocks(keyed, F.length("needle"), found)


class Needles:
    """Texts to be found in other texts, filed by what the other text must have."""

    def __init__(self, needles: list[str]):
        self.by_anchor: dict[str, list[tuple[str, int]]] = {}
        self.words: dict[str, list[int]] = {}
        self.others: dict[str, list[int]] = {}
        for k, needle in enumerate(needles):
            found = WORDS.findall(needle)
            inner = max(found[1:-1], key=len, default=None)
            if inner is not None:
                self.by_anchor.setdefault(inner, []).append((needle, k))
            else:
                (self.words if found == [needle] else self.others).setdefault(needle, []).append(k)

    def inside(self, text: str) -> list[int]:
        """The numbers of the needles that ``text`` holds."""
        own = set(WORDS.findall(text))
        out = [k for anchor in self.by_anchor.keys() & own for needle, k in self.by_anchor[anchor] if needle in text]
        every = "\n".join(own) if self.words else ""
        for needles, place in ((self.words, every), (self.others, text)):
            for needle, numbers in needles.items():
                if needle in place:
                    out += numbers
        return out


def _flat(lists: list[list[int]]) -> pa.Array:
    return pa.array([k for found in lists for k in found], pa.int64())


def _rows(lists: list[list[int]]) -> pa.Array:
    """For every entry of _flat(), the row it is of."""
    return pa.array(np.repeat(np.arange(len(lists)), [len(found) for found in lists]), pa.int64())


def _schema(*parts: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for part in parts for f in part.schema)


def exact_term_counts(parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, exact_match_count): how many of a query's ``exact_terms`` a document holds, whatever their case."""
    terms = parsed.select("query_id", F.explode(F.array_distinct(F.transform("exact_terms", F.lower))).alias("text"))
    return exact_matches(terms, docs).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("exact_match_count"))


def phrase_matches(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, phrase, doc_id, tf): how often the words of a phrase (query_id, phrase) stand next to each other.

    The longest word of a phrase is looked up, and the words around each of its places are compared.
    """
    keyed = phrases.distinct().withColumn("words", T.tokens(F.col("phrase"))).filter(F.size("words") > 0)
    each = docs.select("doc_id", T.tokens(F.col("text")).alias("all"))
    spark, names = phrases.sparkSession, ("query_id", "phrase", "doc_id", "tf")
    schema = _schema(phrases.select("query_id", "phrase"), docs.select("doc_id")) + ", tf long"

    def found(block: DataFrame) -> DataFrame:
        rows, by_word = block.toArrow(), {}
        for k, words in enumerate(rows["words"].to_pylist()):
            at = max(range(len(words)), key=lambda i: len(words[i]))
            by_word.setdefault(words[at], []).append((k, at, words))
        known = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), rows["phrase"].combine_chunks(), by_word))

        def count(words: list[str], of: dict) -> Counter:
            places = ((i, w) for i, w in enumerate(words) if w in of)
            return Counter(k for i, w in places for k, at, own in of[w] if i >= at and words[i - at : i - at + len(own)] == own)

        def work(batches):
            ids, texts, of = known.value
            for b in batches:
                for part in by_words(b, "all"):
                    counts = [count(words, of) for words in part.column("all").to_pylist()]
                    at, tf = _flat(counts), pa.array([n for c in counts for n in c.values()], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(at), texts.take(at), part.column("doc_id").take(_rows(counts)), tf], names)

        return each.mapInArrow(work, schema)

    return in_blocks(keyed, F.length("phrase"), found).groupBy("query_id", "phrase", "doc_id").agg(F.sum("tf").alias("tf"))


def clause_search(parsed: DataFrame, docs: DataFrame, k: int = 30, boost: float = EXACT_BOOST) -> DataFrame:
    """(query_id, doc_id, fts_score, exact_match_count, lexical_score, matched_terms, lexical_rank): any clause of a parsed question matches.

    ``parsed`` has the columns of parse_questions(). A word counts by its
    occurrences, a quoted phrase by those of its words side by side; exact
    terms add to the score, and find documents of their own. ``matched_terms``
    lists what was found, in order of spelling.
    """
    each = parsed.select("query_id", F.explode("clauses").alias("clause"))
    quoted = F.col("clause").startswith('"')
    stop = T.words_literal(T.QUESTION_STOP_WORDS)
    loose = each.filter(~quoted).select("query_id", F.explode(F.array_except(T.word_set(F.col("clause")), stop)).alias("term")).distinct()
    asked = each.filter(quoted).select("query_id", F.expr("substring(clause, 2, length(clause) - 2)").alias("phrase"))
    counted = term_counts(loose, docs).withColumn("tf", F.col("tf").cast("long"))
    both = stacked(counted, phrase_matches(asked, docs).withColumnRenamed("phrase", "term"))
    raw = both.groupBy("query_id", "doc_id").agg(F.sum("tf").alias("n"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
    weight = F.col("n") * F.lit(BODY_WEIGHT)
    scores = raw.select("query_id", "doc_id", F.round(weight / (weight + 1), 9).alias("fts_score"), "matched_terms")
    rows = scores.join(exact_term_counts(parsed, docs), ["query_id", "doc_id"], "full").fillna(0, ["fts_score", "exact_match_count"])
    rows = rows.withColumn("lexical_score", F.round(F.col("fts_score") + boost * F.col("exact_match_count"), 9))
    rows = rows.withColumn("matched_terms", F.coalesce("matched_terms", F.array().cast("array<string>")))
    return ranked(rows, k, F.desc("lexical_score"), F.desc("fts_score"), "doc_id")


def of_ready_documents(docs: DataFrame, catalog: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``docs`` that are ready in the catalog (document_id, filename, status), of some files (filename) if given."""
    ready = catalog.filter("status = 'ready'")
    ready = ready if files is None else ready.join(files, "filename", "left_semi")
    return docs.join(ready.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")


def question_problems(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, problem) of questions (query_id, question, document_id) that can't be asked: empty, or of a document that isn't there or not ready."""
    known = catalog.groupBy("document_id").agg(F.max((F.col("status") == "ready").cast("int")).alias("ready"), F.min((F.col("status") == "superseded").cast("int")).alias("gone"))
    rows = questions.join(known, "document_id", "left")
    empty = F.trim(F.regexp_replace(F.coalesce("question", F.lit("")), r"\s+", " ")) == ""
    missing = F.col("ready").isNull() | (F.col("gone") == 1)
    problem = F.when(empty, "empty question").when(missing, "unknown document").when(F.col("ready") == 0, "document not ready")
    return rows.select("query_id", problem.alias("problem")).filter("problem is not null")


def supplemented(fts: DataFrame, exact: DataFrame, k: int = 20, boost: float = EXACT_BOOST) -> DataFrame:
    """The two lists, each limited by itself, as one: score = fts + boost * exact matches.

    ``fts`` is lexical_scores() of all documents, so a literal match enters with its true text score.
    """
    first = ranked(fts, k, F.desc("fts_score"), "doc_id").select("query_id", "doc_id", "fts_score")
    counts = exact.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("exact_match_count"))
    some = ranked(counts.join(fts, ["query_id", "doc_id"], "left").fillna(0.0, ["fts_score"]), k, F.desc("exact_match_count"), F.desc("fts_score"), "doc_id")
    union = stacked(first, some.select("query_id", "doc_id", "fts_score")).dropDuplicates(["query_id", "doc_id"])
    both = union.join(counts, ["query_id", "doc_id"], "left").fillna(0, ["exact_match_count"])
    both = both.withColumn("lexical_score", F.round(F.col("fts_score") + boost * F.col("exact_match_count"), 9))
    return ranked(both, k, F.desc("lexical_score"), F.desc("fts_score"), "doc_id")
