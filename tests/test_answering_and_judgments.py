import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.operators import answering, embedding
from foliant.sources import judgments


def test_rejected_rewrites_change_nothing(spark):
    rows = lambda r: spark.createDataFrame(r, "query_id long, doc_id long, rank int")
    own, other = rows([(1, 5, 1), (1, 6, 2), (2, 5, 1), (2, 6, 2)]), rows([(1, 6, 1), (2, 6, 1), (2, 7, 2)])
    verdicts = spark.createDataFrame([(1, True), (2, False)], "query_id long, accepted boolean")
    out = {(r.query_id, r.doc_id): (r.fused_rank, r.used_expansion) for r in answering.expanded_fusion({"d": own}, {"d": other}, verdicts).collect()}
    assert out == {(1, 6): (1, True), (1, 5): (2, True), (2, 5): (1, False), (2, 6): (2, False)}


def test_answers_end_to_end(spark):
    questions = spark.createDataFrame([(1, "When did the bank close after losses"), (2, "Who painted it")], "query_id long, question string")
    docs = spark.createDataFrame([(10, "Rain fell. The bank did close after losses in March."), (11, "The bank did close after losses in March. Rain fell."), (12, "Nothing to see.")], "doc_id long, text string")
    fused = spark.createDataFrame([(q, d, d - 9) for q in (1, 2) for d in (10, 11, 12)], "query_id long, doc_id long, fused_rank int")
    rows = {r.query_id: r for r in answering.grounded_answers(questions, fused, docs).collect()}
    assert (rows[1].status, rows[1].n_claims, rows[1].sources) == ("answered", 2, "S1,S2")  # copies in different documents both stay
    assert (rows[2].status, rows[2].n_claims) == ("insufficient_evidence", 0)
    assert (rows[1].attempt, rows[1].used_fallback, rows[2].attempt) == (1, False, None)
    assert rows[1].answer == "The bank did close after losses in March. [S1] The bank did close after losses in March. [S2]"
    broken = spark.createDataFrame([(1, 10, 9)], "query_id long, doc_id long, score int")
    refused = {r.query_id: r.status for r in answering.grounded_answers(questions, fused, docs, broken).collect()}
    assert set(refused.values()) == {"insufficient_evidence"}


def test_traces_decisions_and_gains(spark):
    pairs = lambda r: spark.createDataFrame(r, "case_id string, label int")
    gold = pairs([("a", 1), ("b", 2), ("c", 3)])
    lost = answering.stage_trace(gold, {"raw": pairs([("a", 1), ("b", 2)]), "fused": pairs([("a", 1), ("b", 9)])})
    assert {r.case_id: r.first_lost for r in lost.collect()} == {"a": None, "b": "fused", "c": "raw"}
    cases = [(3, True, True), (None, True, False), (1, False, False), (3, False, False)]
    df = spark.createDataFrame(cases, "s int, sel boolean, used boolean").select(answering.relevance_decision(F.col("s"), F.col("sel"), F.col("used"), 2).alias("d"))
    assert [r.d for r in df.collect()] == ["selected_evidence", "unscored_fallback", "below_relevance_cutoff", "eligible_not_selected"]
    page = lambda r: spark.createDataFrame(r, "query_id long, file string, page_number int")
    gain = answering.adjacency_gain(page([(1, "f", 4), (2, "f", 9)]), page([(1, "f", 4), (1, "f", 5), (2, "f", 9)]), page([(1, "f", 5)])).first()
    assert tuple(gain) == (2, 0, 1, 1.5)


def test_answer_cases_labels_and_migrations(spark, tmp_path):
    claim = [("e", True, [["x"]], ["h"])]
    rows = [
        ("answerable", "q", ["answered"], claim, None), ("unanswerable", " ", ["maybe"], claim * 2, [("h", 3, 2, "t")]),
        ("answerable", "q", ["answered"], [("e", False, None, None)], None),
    ]
    schema = (
        "case_type string, question string, expected_statuses array<string>, expected_claims array<struct<id:string,required:boolean,term_groups:array<array<string>>,"
        "evidence_hashes:array<string>>>, synthetic_evidence array<struct<content_hash:string,page_start:int,page_end:int,passage_text:string>>"
    )
    found = [r.p for r in spark.createDataFrame(rows, schema).select(judgments.answer_case_problems().alias("p")).collect()]
    assert found[0] == [] and set(found[2]) == {"claim without terms", "no required claim"}
    assert set(found[1]) == {"unknown status", "empty question", "repeated claim", "unanswerable with claims", "pages out of order"}
    chunks = spark.createDataFrame([("f", 0, "h0")], "file string, chunk_index int, content_hash string")
    bound, lost = judgments.bind_identities(spark.createDataFrame([("a", "f", 0), ("b", "f", 9)], "case_id string, file string, chunk_index int"), chunks)
    assert bound.first().content_hash == "h0" and [r.case_id for r in lost.collect()] == ["b"]
    cases = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, answerable boolean")
    matches = spark.createDataFrame([("s", "a", "f", 0), ("s", "a", "f", 0), ("t", "b", "f", 1)], "configuration string, id string, file string, chunk_index int")
    judged, without = judgments.relabel(cases, matches.filter("configuration = 's'"))
    assert judged.count() == 1 and [r.case_id for r in without.collect()] == ["b"]
    assert {tuple(r) for r in judgments.configuration_scores(matches, cases, "configuration").collect()} == {("s", 1, 3), ("t", 1, 3)}
    assert judgments.exported(cases).filter("id = 'a'").first().json == '{"schema_version":1,"id":"a","answerable":true}'
    label = spark.createDataFrame([("[Source pages 3-4]\n[Section: Aims]\ntext",), ("[Source page 7]\nx",), ("none",)], "c string").select(judgments.legacy_label(F.col("c")).alias("l"))
    assert [tuple(r.l) for r in label.collect()] == [(3, 4, "Aims"), (7, 7, None), (None, None, None)]
    for name, sql in {"0001_first.sql": "a", "0002_x.sql": "b", "0002_y.sql": "c", "0003_empty.sql": " ", "readme.md": "n"}.items():
        (tmp_path / name).write_text(sql)
    state = {(r.version, r.name): r.problem for r in judgments.migrations(spark, str(tmp_path)).collect()}
    assert state == {(1, "first"): None, (2, "x"): "version twice", (2, "y"): "version twice", (3, "empty"): "empty"}


def test_summaries_of_runs_and_answers(spark):
    from foliant.operators import evaluation

    metrics = spark.createDataFrame([(1, 1, 1.0, 0.5), (2, None, 0.0, 0.0)], "case_id long, first_rank int, rr double, recall_5 double")
    cases = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False), (5, False)], "case_id long, answerable boolean")
    run = spark.createDataFrame([(1,), (5,)], "case_id long")
    row = evaluation.run_summary(metrics, cases, run).first()
    assert tuple(row) == (3, 2, 0.5, 0.333333, 0.166667)
    grades = spark.createDataFrame([(1, 1.0, None, True, False), (2, 0.5, 0.5, False, True)], "case_id long, correctness double, completeness double, answer_success boolean, used_fallback boolean")
    for c in ("faithfulness", "citation_accuracy", "refusal_accuracy", "unsupported_claim_rate"):
        grades = grades.withColumn(c, F.lit(1.0))
    row = evaluation.answer_summary(grades).first()
    assert (row.cases, row.success_rate, row.fallbacks, row.correctness, row.completeness) == (2, 0.5, 1, 0.75, 0.5)
    stages = spark.createDataFrame([("retrieval",), (None,), ("retrieval",)], "failure_stage string")
    assert {tuple(r) for r in evaluation.failure_histogram(stages).collect()} == {("retrieval", 2), ("none", 1)}


def test_phrases_exact_terms_and_clauses(spark, monkeypatch):
    from foliant.operators import lexical

    docs = spark.createDataFrame([(1, "The red fox, the RED fox. NATO-2 met"), (2, "fox red nato 2 met"), (3, None), (4, "")], "doc_id long, text string")
    for most in (100_000, 1):  # in one block, and in several
        monkeypatch.setattr(lexical, "BROADCAST_ROWS", most)
        phrases = spark.createDataFrame([(7, "red fox"), (7, "Fox the"), (8, "met"), (8, "met more")], "query_id long, phrase string")
        found = {tuple(r) for r in lexical.phrase_matches(phrases, docs).collect()}
        assert found == {(7, "red fox", 1, 2), (7, "Fox the", 1, 1), (8, "met", 1, 1), (8, "met", 2, 1)}
        parsed = lexical.parse_questions(spark.createDataFrame([(1, 'who saw "red fox" at NATO-2'), (2, "the")], "query_id long, question string"))
        assert {tuple(r) for r in lexical.exact_term_counts(parsed, docs).collect()} == {(1, 1, 2)}
        rows = {(r.query_id, r.doc_id): r for r in lexical.clause_search(parsed, docs).collect()}
        assert set(rows) == {(1, 1), (1, 2)} and rows[1, 1].lexical_rank == 1 and rows[1, 1].matched_terms == ["2", "nato", "red fox"]
        assert rows[1, 1].fts_score == round(0.4 * 4 / (0.4 * 4 + 1), 9) and rows[1, 1].lexical_score == round(rows[1, 1].fts_score + 0.5, 9)
    ready = spark.createDataFrame([(1, "a", "ready"), (2, "b", "ready"), (3, "a", "failed")], "document_id long, filename string, status string")
    files = spark.createDataFrame([("a",)], "filename string")
    assert [r.doc_id for r in lexical.of_ready_documents(docs, ready, files).collect()] == [1]


def test_only_failing_questions_are_tried_again(spark):
    text = "The river bank did close its northern gates after heavy losses in the month of March last year."
    questions = spark.createDataFrame([(q, "When did the river bank close its gates after losses") for q in (1, 2, 3, 4)], "query_id long, question string")
    docs = spark.createDataFrame([(10, text, "a", 2), (11, text, "a", 1), (12, text + " Rain fell.", "b", 7), (13, "Nothing.", "b", 8), (14, "First the bank did close its gates after losses.", "b", 6)], "doc_id long, text string, file string, page_number int")
    fused = spark.createDataFrame([(q, d, d - 9) for q in (1, 2, 3) for d in (10, 11, 12, 14)] + [(4, 13, 1)], "query_id long, doc_id long, fused_rank int")
    seen = []

    def generate(context, asked):
        made = answering.extractive_answers(context, asked, 4)  # covers too little
        fine = answering.extractive_answers(context, asked)
        return made.filter("query_id <> 1").unionByName(fine.filter("query_id = 1"))

    def repair(claims, feedback, context):
        seen.append({r.query_id for r in claims.collect()} | {r.query_id for r in feedback.collect()} | {r.query_id for r in context.collect()})
        good = answering.requoted(claims, feedback, context)
        return good.filter("query_id = 2").unionByName(claims.filter("query_id = 3"))

    rows = {r.query_id: r for r in answering.grounded_answers(questions, fused, docs, generate=generate, repair=repair).collect()}
    assert seen == [{2, 3}]
    state = {q: (r.status, r.attempt, r.used_fallback, r.n_claims, r.sources) for q, r in rows.items()}
    answered = ("answered", 1, False, 3, "S1,S2,S3")  # 11 is a copy of 10 in its file, and 12 and 14 are neighbours, in the order of their pages
    assert state == {1: answered, 2: (answered[0], 2, *answered[2:]), 3: ("insufficient_evidence", None, True, 0, None), 4: ("insufficient_evidence", None, False, 0, None)}
    context = answering.chosen_context(questions, fused, docs).filter("query_id = 1")
    assert [r.item_id for r in context.orderBy("position").collect()] == [10, 12, 14] or [r.item_id for r in context.orderBy("position").collect()] == [10, 14, 12]


def test_batches_of_an_embedder_are_checked(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else "t" * i) for i in range(10)], "id long, text string").coalesce(1)
    sizes = lambda texts: [(i, [float(len(texts)), float(len(t))]) for i, t in reversed(list(enumerate(texts)))]
    found = {r.id: r.embedding for r in embedding.embedded(rows, sizes, batch=4).collect()}
    assert {i: v[1] for i, v in found.items()} == {i: 0.0 if i == 5 else float(i) for i in range(10)} and {v[0] for v in found.values()} == {4.0, 2.0}
    assert embedding.ordered([(1, [2.0]), (0, [1.0])], 2) == [[1.0], [2.0]]
    for wrong in ([(0, [1.0])], [(0, [1.0]), (0, [2.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            embedding.ordered(wrong, 2)


def test_hashed_ngrams_are_sums_of_signs(spark):
    texts = [None, "", "one", "one two one", "Two ONE two " * 9000, "é x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    for r in embedding.hashed_ngrams(rows).collect():
        words = re.findall(r"\w+", (texts[r.id] or "").lower())
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        bits = [[(b >> (7 - k) & 1) * 2 - 1 for b in hashlib.md5(g.encode()).digest()[:8] for k in range(8)] for g in grams]
        assert r.embedding == [float(sum(c)) for c in zip(*bits)] or (not grams and r.embedding == [0.0] * 64)
    near = {r.id: r.embedding for r in embedding.hashed_ngrams(spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "q r s t u v w z")], "id long, text string")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(near[a], near[b]))
    assert dot(1, 2) > 3 * abs(dot(1, 3))


def test_hashed_ngrams_are_worked_on_in_parts(spark, monkeypatch):
    """The same vectors, however few words are taken at a time; pairs don't go across texts."""
    texts = ["a b c d", "", "e", "f g h i j k", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    whole = {r.id: r.embedding for r in embedding.hashed_ngrams(rows).collect()}
    real = embedding.by_words
    monkeypatch.setattr(embedding, "by_words", lambda batch, words: real(batch, words, 2))
    assert {r.id: r.embedding for r in embedding.hashed_ngrams(rows).collect()} == whole and len(whole) == 5


def test_signs_are_made_for_all_grams_at_once():
    """A hundred thousand different grams; they were unpacked one by one. Sums of more than 16,384 signs are whole."""
    grams = [b"gram %d" % i for i in range(100_000)]
    known = embedding.signs(grams)
    bits = lambda g: [(b >> (7 - k) & 1) * 2 - 1 for b in hashlib.md5(g).digest()[:8] for k in range(8)]
    assert known.shape == (100_000, 64) and known[77].tolist() == bits(grams[77]) and known[-1].tolist() == bits(grams[-1])
    vectors = np.zeros((2, 64), np.int64)
    embedding._add(vectors, pa.array(["a"] * 50_000 + ["b", "a"]), np.array([50_000, 50_002]), 0)
    assert vectors.tolist() == [[50_000 * x for x in bits(b"a")], [x + y for x, y in zip(bits(b"a"), bits(b"b"))]]
