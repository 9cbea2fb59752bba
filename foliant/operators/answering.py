"""From questions to checked answers: expansion, evidence, an extractive answer, and what became of each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..tables import stacked, stored
from . import evidence, fusion, grounding, rerank


def expanded_fusion(original: dict[str, DataFrame], expanded: dict[str, DataFrame], verdicts: DataFrame, rrf_k: int = 10, top_k: int = 10) -> DataFrame:
    """Fuse the lists of a question with those of its rewrite, where the rewrite was accepted.

    Lists are (query_id, doc_id, rank), ``verdicts`` (query_id, accepted). A
    question whose rewrite was rejected keeps exactly its own fused order.
    """
    good = verdicts.filter("accepted").select("query_id").distinct()
    lists = original | {f"expanded_{n}": df.join(good, "query_id", "left_semi") for n, df in expanded.items()}
    fused = fusion.fuse(lists, rrf_k, top_k)
    used = verdicts.groupBy("query_id").agg(F.max("accepted").alias("used_expansion"))
    return fused.join(used, "query_id", "left").fillna(False, ["used_expansion"])


def relevance_decision(score: Column, selected: Column, used: Column, cutoff: int) -> Column:
    """What became of a candidate: evidence, a fallback without score, below the cutoff, or eligible and not chosen."""
    return (
        F.when(used, "selected_evidence")
        .when(score.isNull() & selected, "unscored_fallback")
        .when(score < cutoff, "below_relevance_cutoff")
        .otherwise("eligible_not_selected")
    )


def extractive_answers(context: DataFrame, questions: DataFrame, quote_words: int | None = None) -> DataFrame:
    """The default generator: of each evidence row (query_id, source_id, passage) the sentence with most of the question's words.

    Gives claims (query_id, claim_idx, text, supports); a sentence that shares
    no word with the question says nothing. The whole sentence is quoted, or
    its first ``quote_words`` words.
    """
    rows = context.join(questions, "query_id").select("query_id", "source_id", F.posexplode(T.sentences(F.col("passage"))).alias("at", "text"), "question")
    shared = F.size(F.array_intersect(T.grounding_terms(F.col("text")), T.content_terms(F.col("question"))))
    best = Window.partitionBy("query_id", "source_id").orderBy(F.desc("shared"), "at")
    rows = rows.withColumn("shared", shared).filter("shared > 0").withColumn("__n", F.row_number().over(best)).filter("__n = 1")
    order = Window.partitionBy("query_id").orderBy(F.length("source_id"), "source_id")  # S2 comes before S10
    quote = F.col("text") if quote_words is None else F.array_join(F.slice(F.split("text", r"\s+"), 1, quote_words), " ")
    supports = F.array(F.struct("source_id", quote.alias("quote")))
    return rows.select("query_id", (F.row_number().over(order) - 1).alias("claim_idx"), "text", supports.alias("supports"))


def requoted(claims: DataFrame, feedback: DataFrame, context: DataFrame) -> DataFrame:
    """The default repair: claims that their quotes cover too little are quoted whole; those with another problem go."""
    whole = feedback.filter("support is null").select("query_id", "claim_idx", "problem")
    rows = claims.join(whole, ["query_id", "claim_idx"], "left").filter(F.col("problem").isNull() | F.col("problem").isin("low claim coverage", "low clause coverage"))
    full = F.transform("supports", lambda s: F.struct(s["source_id"].alias("source_id"), F.col("text").alias("quote")))
    return rows.select("query_id", "claim_idx", "text", F.when(F.col("problem").isNull(), F.col("supports")).otherwise(full).alias("supports"))


def chosen_context(
    questions: DataFrame, fused: DataFrame, docs: DataFrame, scores: DataFrame | None = None, cutoff: int = 2, final_k: int = 5, duplicate: float = 0.82
) -> DataFrame:
    """(query_id, source_id, position, item_id, passage): each question's evidence in reading order.

    ``docs`` is (doc_id, text), and may say the ``file`` and ``page_number`` of
    each; else a document is a file. Texts join after the ranking, for the few
    candidates only. Without scores the overlap scorer gives them. Unscored
    candidates never become evidence, and copies are left out within a file.
    """
    own = {"file": F.col("doc_id").cast("string"), "page_number": F.lit(1)}
    docs = docs.withColumns({n: c for n, c in own.items() if n not in docs.columns}).select("doc_id", "text", *own)
    if scores is None:
        texts = fused.join(docs, "doc_id").join(questions, "query_id")
        scores = texts.select("query_id", "doc_id", rerank.overlap_score(F.col("question"), F.col("text")).alias("score"))
    order = rerank.rerank(fused, scores, 10, final_k, cutoff).filter("selected and not fallback")
    found = order.join(docs, "doc_id").select("query_id", F.col("doc_id").alias("item_id"), F.col("reranked_rank").alias("rank"), "score", "text", "file", "page_number", F.sha2("text", 256).alias("hash"))
    kept = evidence.greedy_select(found, final_k, duplicate, cutoff, "file", "hash").filter("decision = 'kept'").select("query_id", "item_id")
    placed = evidence.with_source_ids(evidence.reading_order(found.join(kept, ["query_id", "item_id"])))
    return placed.select("query_id", "source_id", "position", "item_id", F.col("text").alias("passage"))


def attempt_verdicts(claims: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, status, problem) of one attempt at the questions ``asked``: without claims it refuses, which is valid."""
    first = F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("claim_idx")))
    each = claims.groupBy("query_id").agg(F.lit("answered").alias("status"), first.alias("problem"))
    return asked.select("query_id").distinct().join(each, "query_id", "left").fillna("insufficient_evidence", ["status"])


def grounded_answers(
    questions: DataFrame, fused: DataFrame, docs: DataFrame, scores: DataFrame | None = None, cutoff: int = 2, final_k: int = 5, duplicate: float = 0.82,
    generate=extractive_answers, repair=requoted,
) -> DataFrame:
    """(query_id, status, attempt, used_fallback, n_claims, sources, answer): one plan for all questions.

    ``questions`` is (query_id, question), ``fused`` (query_id, doc_id,
    fused_rank); evidence is chosen_context(). ``generate`` makes claims of the
    context and the questions. Where a claim breaks a rule, and only there,
    ``repair`` makes the claims again from the feedback; they are checked in
    the same way. An attempt with a broken rule is never shown: the second
    replaces it, or the question is refused (``used_fallback``). A question
    without evidence is refused without an attempt.
    """
    context = stored(chosen_context(questions, fused, docs, scores, cutoff, final_k, duplicate), "context")
    first = stored(grounding.claim_problems(generate(context, questions), context), "claims")
    broken = first.filter("problem is not null").select("query_id").distinct()
    of_broken = lambda df: df.join(broken, "query_id", "left_semi")
    claims, evident = of_broken(first.drop("problem")), of_broken(context)
    second = stored(grounding.claim_problems(repair(claims, grounding.repair_feedback(claims, evident), evident), evident), "claims")
    verdicts = attempt_verdicts(second, broken)
    empty = (F.col("status") == "insufficient_evidence") & F.col("problem").isNull()
    verdicts = verdicts.withColumn("problem", F.when(empty, "answer without claims").otherwise(F.col("problem")))
    state = grounding.repaired(attempt_verdicts(first, context), verdicts)
    shown = stacked(first.withColumn("attempt", F.lit(1)), second.withColumn("attempt", F.lit(2))).join(state.filter("status = 'answered'"), ["query_id", "attempt"])
    ids = F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("supports", lambda s: F.struct(F.length(s["source_id"]), s["source_id"].alias("id"))))))), lambda x: x["id"])
    told = shown.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_claims"), F.array_join(ids, ",").alias("sources")).join(grounding.rendered(shown), "query_id")
    rows = questions.select("query_id").join(state, "query_id", "left").join(told, "query_id", "left")
    rows = rows.fillna("insufficient_evidence", ["status"]).fillna(False, ["used_fallback"]).fillna(0, ["n_claims"])
    return rows.select("query_id", "status", "attempt", "used_fallback", "n_claims", "sources", "answer")


def stage_trace(gold: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(case_id, first_lost): the first stage, in order, none of whose labels (case_id, label) is a gold one; null if none.

    One union and one grouping, however many stages.
    """
    rows = [df.select("case_id", "label", F.lit(name).alias("stage")) for name, df in stages.items()]
    every = stacked(*rows)
    hits = every.join(gold.select("case_id", "label").distinct(), ["case_id", "label"])
    both = stacked(hits.select("case_id", "stage"), gold.select("case_id", F.lit(None).cast("string").alias("stage")))
    held = both.groupBy("case_id").agg(F.collect_set("stage").alias("held"))
    lost = F.filter(T.words_literal(list(stages)), lambda s: ~F.array_contains("held", s))
    return held.select("case_id", F.try_element_at(lost, F.lit(1)).alias("first_lost"))


def adjacency_gain(anchors: DataFrame, expanded: DataFrame, relevant: DataFrame) -> DataFrame:
    """How many questions have a relevant page among their anchors, and with neighbours, and how much longer contexts get.

    All three are (query_id, file, page_number).
    """
    keys = ["query_id", "file", "page_number"]
    pages = lambda df, n: df.select(*keys).distinct().join(relevant.select(*keys).distinct().withColumn("good", F.lit(1)), keys, "left").groupBy("query_id").agg(F.max(F.coalesce("good", F.lit(0))).alias(f"{n}_hit"), F.count(F.lit(1)).alias(f"{n}_pages"))
    both = pages(anchors, "anchor").join(pages(expanded, "expanded"), "query_id")
    return both.agg(
        F.count(F.lit(1)).alias("questions"), F.sum("anchor_hit").alias("anchor_hits"), F.sum("expanded_hit").alias("expanded_hits"),
        F.round(F.sum("expanded_pages") / F.sum("anchor_pages"), 6).alias("growth"),
    )
