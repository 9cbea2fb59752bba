"""Rewritten questions: which terms must survive, and whether a rewrite is safe to search with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The longest rewrite, and the pattern of capitalised names of up to six words.
LONGEST = 500
NAMES = r"\b(?:[A-Z][A-Za-z0-9]*(?:['’+.-][A-Za-z0-9]+)*)(?:\s+(?:[A-Z][A-Za-z0-9]*(?:['’+.-][A-Za-z0-9]+)*)){0,5}\b"


def protected_terms(question: Column) -> Column:
    """Quoted phrases, identifiers, and capitalised names without the question word before them."""
    strong = F.filter(T.query_tokens(F.regexp_replace(question, T.QUOTED, " ")), T.is_strong_token)
    prefixes = T.words_literal(T.QUESTION_PREFIXES)

    def name(match: Column) -> Column:
        words = F.split(match, r"\s+")
        begins = F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(prefixes, T.casefold(w)), i)), lambda i: i.isNotNull())
        first = F.coalesce(F.try_element_at(begins, F.lit(1)), F.size(words))
        return F.array_join(F.slice(words, first + 1, F.size(words)), " ")

    names = F.transform(F.regexp_extract_all(question, F.lit(NAMES), F.lit(0)), name)
    return T.first_spellings(F.concat(T.phrases(question), strong, names), collapse=True)


def with_verdict(rewrites: DataFrame) -> DataFrame:
    """Add ``problem`` (first rule broken) and ``accepted`` to (question, alternative, intent_preserved)."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    old, new = plain("question"), plain("alternative")
    strong = lambda c: F.transform(F.filter(T.query_tokens(c), T.is_strong_token), T.casefold)
    missing = F.exists(protected_terms(old), lambda t: ~T.casefold(new).contains(T.casefold(t)))
    problem = (
        F.when(new == "", "empty")
        .when(F.length(new) > LONGEST, "too long")
        .when(T.casefold(new) == T.casefold(old), "identical")
        .when(~F.coalesce("intent_preserved", F.lit(False)), "intent not preserved")
        .when(missing, "protected term removed")
        .when(F.size(F.array_except(strong(new), strong(old))) > 0, "new exact signal")
        .when(~F.arrays_overlap(T.content_terms(old), T.content_terms(new)), "no content overlap")
    )
    return rewrites.withColumn("problem", problem).withColumn("accepted", F.col("problem").isNull())


def expanded_questions(questions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Every question (query_id, question) with its rewrite (query_id, alternative, intent_preserved), if any.

    Adds ``used_expansion`` and ``fallback_reason``: why a question is searched
    alone, which is that there is no rewrite, or the rule that it breaks. A
    rejected rewrite stays visible.
    """
    rows = with_verdict(questions.join(rewrites, "query_id", "left"))
    reason = F.when(F.col("alternative").isNull(), "no rewrite").otherwise(F.col("problem"))
    return rows.withColumns({"used_expansion": reason.isNull(), "fallback_reason": reason}).drop("problem", "accepted")


def synonym_rewrites(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, alternative, intent_preserved): questions with words replaced by their synonyms (term, synonym), where any word has one.

    Words are between spaces and looked up in lower case; of several synonyms
    the first by spelling is taken.
    """
    one = synonyms.groupBy(F.lower("term").alias("term")).agg(F.min("synonym").alias("synonym"))
    words = questions.select("query_id", F.posexplode(F.split("question", " ", -1)).alias("at", "word")).withColumn("term", F.lower("word"))
    each = words.join(one, "term", "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("synonym", "word").alias("word")))).alias("words"), F.count("synonym").alias("replaced")
    )
    return each.filter("replaced > 0").select("query_id", F.array_join("words.word", " ").alias("alternative"), F.lit(True).alias("intent_preserved"))
