"""Retrieval metrics, their averages, and the grading of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

CUTOFFS = (1, 3, 5, 10)


def case_metrics(run: DataFrame, judgments: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, relevant: DataFrame | None = None) -> DataFrame:
    """First relevant rank, reciprocal rank, and Hit, Recall and nDCG at each cutoff for every judged case.

    ``run`` is (case_id, rank, label), ``judgments`` (case_id, label, grade)
    with grades above 0. A label that is retrieved again gains nothing more.
    The ideal order takes all judged grades, cut at k; recall divides by all
    relevant labels. Where all grades are 1, ``relevant`` (case_id, relevant) can
    say how many labels each case has; judgments then need no others than those
    of retrieved labels.
    """
    again = Window.partitionBy("case_id", "label").orderBy("rank")
    found = run.withColumn("__n", F.row_number().over(again)).filter("__n = 1")
    gains = found.join(judgments, ["case_id", "label"]).select("case_id", "rank", "grade")
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    if relevant is None:
        best = Window.partitionBy("case_id").orderBy(F.desc("grade"), "label")
        ideal = judgments.withColumn("place", F.row_number().over(best))
        top = [F.sum(F.when(F.col("place") <= k, gain(F.col("grade")) / F.log2(F.col("place") + 1))).alias(f"idcg_{k}") for k in cutoffs]
        ideal = ideal.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), *top)
    else:
        places = lambda k: F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int")))
        top = [F.aggregate(places(k), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1)).alias(f"idcg_{k}") for k in cutoffs]
        ideal = relevant.filter("relevant > 0").select("case_id", "relevant", *top)
    per_k = []
    for k in cutoffs:
        inside = F.col("rank") <= k
        per_k += [
            F.sum(F.when(inside, gain(F.col("grade")) / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}"),
            F.count(F.when(inside, 1)).alias(f"n_{k}"),
        ]
    got = gains.groupBy("case_id").agg(F.min("rank").alias("first_rank"), *per_k)
    both = ideal.join(got, "case_id", "left")
    out = ["case_id", "first_rank", F.round(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)), 6).alias("rr")]
    for k in cutoffs:
        n = F.coalesce(F.col(f"n_{k}"), F.lit(0))
        out += [
            F.when(n > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
            F.round(n / F.col("relevant"), 6).alias(f"recall_{k}"),
            F.round(F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"idcg_{k}"), 6).alias(f"ndcg_{k}"),
        ]
    return both.select(*out)


def macro_average(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means over cases, of all or by a column; no cases at all give zeros."""
    names = [c for c in metrics.columns if c not in ("case_id", "first_rank", by)]
    rows = metrics.groupBy(by) if by else metrics.groupBy()
    return rows.agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names])


def by_tag(metrics: DataFrame, tags: DataFrame) -> DataFrame:
    """Means by tag: a case (case_id, tags array<string>) counts for each of its different tags, and for none if it has none."""
    each = tags.select("case_id", F.explode(F.array_distinct("tags")).alias("tag")).filter("tag is not null").distinct()
    return macro_average(metrics.join(each, "case_id"), "tag")


def best_configuration(results: DataFrame, order: list[str], ordinal: str, name: str) -> DataFrame:
    """The configuration with the lexicographically largest metrics; of equals, the first by ``ordinal``, NaN and null last."""
    first = F.nanvl(-F.col(ordinal).cast("double"), F.lit(float("-inf")))
    key = F.struct(*[F.col(c) for c in order], first.alias("__o"))
    return results.agg(F.max_by(name, key).alias(name))


def run_summary(metrics: DataFrame, cases: DataFrame, run: DataFrame) -> DataFrame:
    """One row: means over answerable cases, and how many of the unanswerable ones rightly find nothing.

    ``cases`` is (case_id, answerable); an answerable case without a judged
    result counts as zero in every mean.
    """
    names = [c for c in metrics.columns if c not in ("case_id", "first_rank")]
    some = run.select("case_id").distinct().withColumn("found", F.lit(True))
    rows = cases.join(metrics, "case_id", "left").join(some, "case_id", "left")
    asked, silent = F.col("answerable"), F.col("found").isNull()
    return rows.agg(
        F.count(F.when(asked, 1)).alias("answerable_cases"), F.count(F.when(~asked, 1)).alias("unanswerable_cases"),
        F.round(F.avg(F.when(~asked, silent.cast("double"))), 6).alias("unanswerable_correct"),
        *[F.round(F.coalesce(F.avg(F.when(asked, F.coalesce(c, F.lit(0.0)))), F.lit(0.0)), 6).alias(c) for c in names],
    )


def answer_summary(grades: DataFrame) -> DataFrame:
    """One row: how many answers, how many succeed or are fallbacks, and the mean of every score that a case has."""
    scores = ["correctness", "faithfulness", "citation_accuracy", "completeness", "refusal_accuracy", "unsupported_claim_rate"]
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return grades.agg(F.count(F.lit(1)).alias("cases"), share("answer_success").alias("success_rate"), F.sum(F.col("used_fallback").cast("long")).alias("fallbacks"), *[share(c).alias(c) for c in scores])


def failure_histogram(rows: DataFrame, stage: str = "failure_stage") -> DataFrame:
    """(stage, cases): how many cases each stage lost; those that nothing lost are ``none``."""
    return rows.groupBy(F.coalesce(stage, F.lit("none")).alias(stage)).agg(F.count(F.lit(1)).alias("cases"))


def of_cases(rows: DataFrame, ids: DataFrame, key: str = "case_id") -> DataFrame:
    """The rows whose case is one of ``ids``, as for a split of a dataset."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def regraded(saved: DataFrame, again: DataFrame) -> DataFrame:
    """(case_id, state, fields): whether grades made again are those saved: same, changed (in ``fields``), lost (saved only) or new.

    Grading saved answers again changes nothing, so any other state means that
    answers, expectations or rules are not those of the saved run.
    """
    values = [c for c in saved.columns if c != "case_id"]
    whole = lambda df, name: df.select("case_id", F.struct(*values).alias(name))
    rows = whole(saved, "a").join(whole(again, "b"), "case_id", "full")
    state = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "new").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in values]))
    return rows.select("case_id", state.alias("state"), F.when(state == "changed", F.array_join(differs, ",")).alias("fields"))


def matches_expectation(claim: Column, term_groups: Column) -> Column:
    """Whether a claim has, of every group, one alternative as whole words."""
    padded = F.concat(F.lit(" "), T.graded_text(claim), F.lit(" "))
    one = lambda a: padded.contains(F.concat(F.lit(" "), T.graded_text(a), F.lit(" ")))
    return F.forall(term_groups, lambda g: F.exists(g, one))


def failure_stage(row: dict[str, Column]) -> Column:
    """The first stage that failed, in pipeline order; null if none did. Keys are stages, values whether they succeeded."""
    out = None
    for name, fine in row.items():
        out = F.when(~fine, name) if out is None else out.when(~fine, name)
    return out


def grade_answers(answers: DataFrame, claims: DataFrame, expectations: DataFrame) -> DataFrame:
    """Scores of each case.

    ``answers`` is (case_id, case_type, status, expected_statuses, refusal_reason, used_fallback);
    ``claims`` (case_id, claim_idx, text, faithful, citations array<struct<accurate>>);
    ``expectations`` (case_id, expectation_id, required, term_groups). An
    unanswerable case is right if it claims nothing, and has no completeness.
    """
    pairs = claims.join(expectations, "case_id", "left")
    matched = F.coalesce(matches_expectation(F.col("text"), F.col("term_groups")), F.lit(False))
    pairs = pairs.withColumn("matched", matched)
    per_claim = pairs.groupBy("case_id", "claim_idx").agg(F.max("matched").alias("matched"))
    cited = claims.select(
        "case_id", "claim_idx", "faithful", F.size("citations").alias("n_cited"),
        F.size(F.filter("citations", lambda c: c["accurate"] & F.col("faithful"))).alias("n_accurate"),
    )
    of_claims = per_claim.join(cited, ["case_id", "claim_idx"]).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.sum(F.col("matched").cast("int")).alias("n_matched"),
        F.sum(F.col("faithful").cast("int")).alias("n_faithful"), F.sum("n_cited").alias("n_cited"), F.sum("n_accurate").alias("n_accurate"),
    )
    met = pairs.filter("required").groupBy("case_id", "expectation_id").agg(F.max("matched").alias("met"))
    met = met.groupBy("case_id").agg(F.sum(F.col("met").cast("int")).alias("n_met"))
    needed = expectations.filter("required").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_required"))
    rows = answers.join(of_claims, "case_id", "left").join(met, "case_id", "left").join(needed, "case_id", "left")
    rows = rows.fillna(0, ["n_claims", "n_matched", "n_faithful", "n_cited", "n_accurate", "n_met", "n_required"])
    none, refused = F.col("n_claims") == 0, F.col("case_type") == "unanswerable"
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    reason = F.coalesce(F.col("refusal_reason") != "", F.lit(False))
    partial = F.col("case_type").isin("partially_answerable", "conflicting_evidence")
    behaved = (
        F.when(refused, (F.col("status") == "insufficient_evidence") & none)
        .when(partial, (F.col("status") == "partially_answered") & ~none & reason)
        .otherwise((F.col("status") == "answered") & ~none & ~reason)
    )
    scores = {
        "correctness": F.when(refused, F.when(none, 1.0).otherwise(0.0)).otherwise(F.coalesce(ratio("n_matched", "n_claims"), F.lit(0.0))),
        "faithfulness": F.coalesce(ratio("n_faithful", "n_claims"), F.when(refused, 1.0).otherwise(0.0)),
        "citation_accuracy": F.coalesce(ratio("n_accurate", "n_cited"), F.when(refused, 1.0).otherwise(0.0)),
        "completeness": F.when(~refused, ratio("n_met", "n_required")),
        "refusal_accuracy": (F.array_contains("expected_statuses", F.col("status")) & behaved).cast("double"),
        "unsupported_claim_rate": F.coalesce(1 - ratio("n_faithful", "n_claims"), F.lit(0.0)),
    }
    out = rows.select("case_id", "case_type", "used_fallback", *[F.round(c, 6).alias(n) for n, c in scores.items()])
    perfect = (
        (F.col("correctness") == 1) & (F.col("faithfulness") == 1) & (F.col("citation_accuracy") == 1) & (F.col("refusal_accuracy") == 1)
        & (F.coalesce("completeness", F.lit(1.0)) == 1) & (F.col("unsupported_claim_rate") == 0) & ~F.col("used_fallback")
    )
    return out.withColumn("answer_success", perfect)
