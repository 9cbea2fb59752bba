import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import dense, evaluation, evidence, expansion, fusion, grounding, lexical, numbering, rerank
from foliant.plans import registry, retrieval_queries


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int")


@pytest.mark.parametrize("block", [3, 100])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_against_a_loop(spark, monkeypatch, metric, block):
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", block)
    monkeypatch.setattr(dense, "ITEMS_PER_CELL", 7)
    monkeypatch.setattr(dense, "FAN_IN", 2)
    rng = random.Random(1)
    items = [(i, [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4)]
    df = spark.createDataFrame(items, "item_id long, embedding array<float>").repartition(3)
    queries = df.filter("item_id % 7 = 0").withColumnRenamed("item_id", "query_id")

    def distance(a, b):
        dot, x, y = (sum(p * q for p, q in zip(u, v, strict=True)) for u, v in ((a, b), (a, a), (b, b)))
        return round((1 - dot / math.sqrt(x * y) if x * y else 1.0) if metric == "cosine" else math.sqrt(max(0, x + y - 2 * dot)), 9)

    found = {(r.query_id, r.dense_rank): (r.distance, r.item_id) for r in dense.nearest(queries, df, 5, metric).collect()}
    for q, v in items:
        if q % 7 == 0:
            best = sorted((distance(v, w), i) for i, w in items if i != q)[:5]
            assert [found[q, k + 1][1] for k in range(5)] == [i for _, i in best]
    with pytest.raises(ValueError):
        dense.check_sizes(3, 4)


@pytest.mark.parametrize("cell", [5, 1000])
def test_nearest_of_a_stored_table_with_itself(spark, monkeypatch, tmp_path, cell):
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(dense, "ITEMS_PER_CELL", cell)
    rows = [(i, [float(i), 1.0]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = retrieval_queries._nearest(spark, str(tmp_path), "l2", 2).collect()
    assert len(found) == 20 and all(abs(r.item_id - r.query_id) <= 2 for r in found)
    assert {(r.item_id, r.dense_rank) for r in found if r.query_id == 20} == {(19, 1), (21, 2)}


@pytest.mark.parametrize("block", [3, 1000])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_of_copies(spark, monkeypatch, metric, block):
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", block)
    monkeypatch.setattr(dense, "ITEMS_PER_CELL", 50)
    rng = random.Random(2)
    pool = [[rng.gauss(0, 1) / 8 for _ in range(64)] for _ in range(12)]
    items = spark.createDataFrame([(i, pool[i % 12]) for i in range(240)], "item_id long, embedding array<float>").repartition(3)
    found = dense.nearest(items.filter("item_id < 12").withColumnRenamed("item_id", "query_id"), items, 4, metric).collect()
    # Copies are no distance apart, so that the smallest ids come first.
    assert {(r.query_id, r.dense_rank): r.item_id for r in found} == {(q, k): q + 12 * k for q in range(12) for k in range(1, 5)}
    assert {str(r.distance) for r in found} == {"0.0"}


@pytest.mark.parametrize("block", [1, 1000])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_what_has_no_distance_comes_last(spark, monkeypatch, metric, block):
    monkeypatch.setattr(dense, "QUERIES_PER_BLOCK", block)
    items = spark.createDataFrame([(1, None), (2, [float("nan"), 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0]), (5, None)], "item_id long, embedding array<float>")
    found = dense.nearest(items.withColumnRenamed("item_id", "query_id"), items, 4, metric).collect()
    by = {q: [(r.item_id, str(r.distance)) for r in sorted(found, key=lambda r: r.dense_rank) if r.query_id == q] for q in range(1, 6)}
    assert by[1] == [(i, "None") for i in (2, 3, 4, 5)] and by[5] == [(i, "None") for i in (1, 2, 3, 4)]
    assert by[2] == [(3, "nan"), (4, "nan"), (1, "None"), (5, "None")]
    assert by[3] == [(4, "0.0"), (2, "nan"), (1, "None"), (5, "None")]
    with pytest.raises(Exception, match="vectors of different sizes"):
        dense.nearest(items.withColumnRenamed("item_id", "query_id"), items.withColumn("embedding", F.expr("if(item_id = 3, array(1.0F), embedding)")).coalesce(1), 4, metric).collect()


def test_parsing_questions(spark):
    rows = [("what is risk, Risk?",), ('find "key  phrase" in NIST 600-1',), (" ",), ("?!",)]
    found = lexical.parse_questions(spark.createDataFrame(rows, "question string")).collect()
    assert found[0].search_text == "what OR is OR risk" and found[0].exact_terms == []
    assert found[1].search_text == '"key  phrase" OR find OR in OR NIST OR 600-1' and found[1].exact_terms == ["key  phrase", "NIST", "600-1"]
    assert [r.problem for r in found[2:]] == ["query cannot be empty", "query contains no searchable text"]


def test_lexical_search_and_supplement(spark):
    docs = spark.createDataFrame([(1, "risk risk model"), (2, "Risk of fire in the night"), (3, "nothing"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "the risk of fire in"), (8, "of the")], "query_id long, text string")
    terms = lexical.query_terms(queries)
    found = {(r.query_id, r.doc_id): r for r in lexical.search(terms, docs, 5).collect()}
    assert set(found) == {(7, 1), (7, 2)} and found[7, 1].lexical_rank == 1 and math.isclose(found[7, 1].fts_score, 0.8 / 1.8, abs_tol=1e-9)
    exact = lexical.exact_matches(spark.createDataFrame([(7, "RISK OF fire in"), (9, "oth")], "query_id long, text string"), docs)
    assert sorted(map(tuple, exact.collect())) == [(7, 2), (9, 3)]
    both = {(r.query_id, r.doc_id): r for r in lexical.supplemented(lexical.lexical_scores(terms, docs), exact, 5).collect()}
    assert both[7, 2].lexical_score == pytest.approx(0.8 / 1.8 + 0.25) and both[9, 3].fts_score == 0


def test_fusion(spark):
    a, b = ranked(spark, [(1, 10, 1), (1, 11, 2)]), ranked(spark, [(1, 10, 3), (1, 12, 1)])
    rows = {r.doc_id: r for r in fusion.fuse({"dense": a, "lexical": b}).collect()}
    assert rows[10].rrf_score == pytest.approx(1 / 61 + 1 / 63, abs=1e-9) and rows[10].source_count == 2
    assert [rows[d].fused_rank for d in (10, 12, 11)] == [1, 2, 3]
    four = fusion.fuse({k: ranked(spark, [(1, 5, n)]) for k, n in {"a": 1, "b": 2, "c": 3, "d": 1}.items()}, 10).first()
    assert four.rrf_score == pytest.approx(1 / 11 + 1 / 12 + 1 / 13 + 1 / 11, abs=1e-9)
    relevant = spark.createDataFrame([(1, 12), (2, 9)], "query_id long, doc_id long")
    changes = {r.query_id: r.change for r in fusion.rank_changes(a, b, relevant).collect()}
    assert changes == {1: "helped", 2: "unchanged"}


def test_greedy_choice(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma delta eps", "one two three", "four five six", "seven"]
    rows = [(1, k, k + 1, 0.9 - k / 10, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, item_id long, rank int, score double, text string")
    out = {r.item_id: (r.decision, r.duplicate_of) for r in evidence.greedy_select(df, 2, 0.7).collect()}
    assert out == {0: ("kept", None), 1: ("near_duplicate", 0), 2: ("kept", None)}
    low = {r.item_id: r.decision for r in evidence.greedy_select(df, 5, 0.7, 0.65).collect()}
    assert low == {0: "kept", 1: "near_duplicate", 2: "kept", 3: "below_threshold", 4: "below_threshold"}


def test_neighbours_and_reading_order(spark):
    pages = spark.createDataFrame([("f", n) for n in range(1, 11)], "file string, page_number int")
    anchors = spark.createDataFrame([(1, "f", 5, 1), (1, "f", 6, 2), (1, "f", 10, 3)], "query_id long, file string, page_number int, rank int")
    found = {r.page_number: (r.origin, r.anchor_page) for r in evidence.with_neighbours(anchors, pages).collect()}
    assert found == {4: ("adjacent", 5), 5: ("anchor", 5), 6: ("adjacent", 5), 7: ("adjacent", 6), 9: ("adjacent", 10), 10: ("anchor", 10)}
    order = {r.page_number: r.position for r in evidence.reading_order(anchors.withColumn("rank", 4 - F.col("rank"))).collect()}
    assert order == {10: 1, 5: 2, 6: 3}
    context = evidence.payload(evidence.with_source_ids(evidence.reading_order(anchors)), "page_number").first().context
    assert context == '[{"source_id":"S1","page_number":5},{"source_id":"S2","page_number":6},{"source_id":"S3","page_number":10}]'


def test_metrics(spark):
    run = spark.createDataFrame([("a", 1, 9), ("a", 2, 5), ("a", 3, 2), ("a", 4, 8), ("b", 1, 2), ("b", 2, 2)], "case_id string, rank int, label int")
    judged = spark.createDataFrame([("a", 2, 2), ("a", 5, 1), ("b", 2, 1), ("c", 1, 1)], "case_id string, label int, grade int")
    rows = {r.case_id: r for r in evaluation.case_metrics(run, judged, (1, 3)).collect()}
    a = rows["a"]
    assert (a.first_rank, a.rr, a.hit_1, a.hit_3, a.recall_1, a.recall_3) == (2, 0.5, 0.0, 1.0, 0.0, 1.0)
    assert a.ndcg_3 == pytest.approx((1 / math.log2(3) + 3 / 2) / (3 + 1 / math.log2(3)), abs=1e-6)
    assert rows["b"].recall_3 == rows["b"].ndcg_3 == 1.0 and rows["c"].rr == 0
    mean = evaluation.macro_average(evaluation.case_metrics(run, judged, (1, 3))).first()
    assert mean.cases == 3 and mean.rr == 0.5
    best = spark.createDataFrame([("x", 0.5, 0), ("y", 0.7, 1), ("z", 0.7, 2)], "name string, mrr double, o int")
    assert evaluation.best_configuration(best, ["mrr"], "o", "name").first().name == "y"


def test_reranking_falls_back_by_query(spark):
    fused = spark.createDataFrame([(q, d, d) for q in (1, 2, 3) for d in (1, 2, 3)], "query_id long, doc_id long, fused_rank int")
    scores = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 2), (2, 1, 3), (2, 2, 3), (3, 1, 3), (3, 2, 4), (3, 3, 0)], "query_id long, doc_id long, score int")
    rows = rerank.rerank(fused, scores, 10, 2, 2).collect()
    order = {q: [r.doc_id for r in sorted(rows, key=lambda r: r.reranked_rank) if r.query_id == q] for q in (1, 2, 3)}
    assert order == {1: [2, 3, 1], 2: [1, 2, 3], 3: [1, 2, 3]}
    assert {(r.query_id, r.doc_id) for r in rows if r.selected} == {(1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2)}
    assert all(r.fallback == (r.query_id > 1) and (r.score is None) == r.fallback for r in rows)
    assert spark.range(1).select(rerank.cost(F.lit(1_000_000), F.lit(1_000_000)).alias("c")).first().c == pytest.approx(0.75)


def test_rewrites(spark):
    q = 'What does NIST say about "model risk" in Acme Corp reports?'
    cases = [
        ("How does NIST describe model risk in Acme Corp reports", True, None), ("", True, "empty"), ("x" * 501, True, "too long"), (q.upper(), True, "identical"),
        ("NIST on model risk at Acme Corp", False, "intent not preserved"), ("Describe model risk in Acme Corp reports", True, "protected term removed"),
        ("NIST model risk Acme Corp reports 2024", True, "new exact signal"),
    ]
    df = spark.createDataFrame([(q, a, i) for a, i, _ in cases], "question string, alternative string, intent_preserved boolean")
    assert [r.problem for r in expansion.with_verdict(df).collect()] == [p for *_, p in cases]
    terms = spark.createDataFrame([(q,)], "q string").select(expansion.protected_terms(F.col("q")).alias("t")).first().t
    assert terms == ["model risk", "NIST", "Acme Corp"]
    none = spark.createDataFrame([("fast car", "slow bus", True)], "question string, alternative string, intent_preserved boolean")
    assert expansion.with_verdict(none).first().problem == "no content overlap"


def test_claims_and_repair(spark):
    passages = spark.createDataFrame([(1, "S1", "The bank closed in March after heavy losses."), (1, "S2", "Rain fell.")], "query_id long, source_id string, passage string")
    cases = [
        ("The bank closed after heavy losses", [("S1", "bank closed ... heavy losses")], None), ("The bank closed", [], "no citation"),
        ("The bank closed", [("S9", "bank")], "unknown source"), ("The bank closed", [("S1", "bank opened")], "quote not found"),
        ("The bank closed", [("S2", "Rain fell")], "no overlap"), ("The bank closed", [("S1", "bank"), ("S1", "closed")], "repeated citation"),
        ("The bank opened branches everywhere abroad lately", [("S1", "bank")], "low claim coverage"), ("The bank closed", [("S1", " ")], "empty quote"),
        ("The bank closed after heavy losses in March but markets rallied strongly", [("S1", "The bank closed in March after heavy losses")], "low clause coverage"),
    ]
    df = spark.createDataFrame([(1, k, t, s) for k, (t, s, _) in enumerate(cases)], "query_id long, claim_idx int, text string, supports array<struct<source_id:string,quote:string>>")
    found = grounding.claim_problems(df, passages)
    assert [r.problem for r in found.orderBy("claim_idx").collect()] == [p for *_, p in cases]
    answers = spark.createDataFrame([(1, "answered", None), (2, "answered", None), (3, "insufficient_evidence", "nothing there")], "query_id long, status string, insufficient_reason string")
    first = grounding.answer_problems(answers, found)
    assert {r.query_id: r.problem for r in first.collect()} == {1: "no citation", 2: "answer without claims", 3: None}
    second = grounding.answer_problems(answers.filter("query_id = 1"), found.filter("claim_idx = 0"))
    out = {r.query_id: (r.status, r.attempt, r.used_fallback) for r in grounding.repaired(first, second).collect()}
    assert out == {1: ("answered", 2, False), 2: ("insufficient_evidence", None, True), 3: ("insufficient_evidence", 1, False)}
    assert grounding.rendered(df.filter("claim_idx in (0, 2)")).first().answer == "The bank closed after heavy losses [S1] The bank closed [S9]"
    assert grounding.citations(df.filter("claim_idx = 5")).first().quotes == ["bank", "closed"]


def test_grading(spark):
    answers = spark.createDataFrame(
        [("a", "answerable", "answered", ["answered"], None, False), ("u", "unanswerable", "insufficient_evidence", ["insufficient_evidence"], "gap", False), ("w", "answerable", "answered", ["answered"], None, False)],
        "case_id string, case_type string, status string, expected_statuses array<string>, refusal_reason string, used_fallback boolean",
    )
    claims = spark.createDataFrame(
        [("a", 0, "Losses rose to 3.5 percent", True, [(True,)]), ("w", 0, "Something else", False, [(True,)])],
        "case_id string, claim_idx int, text string, faithful boolean, citations array<struct<accurate:boolean>>",
    )
    expected = spark.createDataFrame([("a", "e", True, [["losses", "deficits"], ["3.5"]]), ("w", "e", True, [["losses"]])], "case_id string, expectation_id string, required boolean, term_groups array<array<string>>")
    rows = {r.case_id: r for r in evaluation.grade_answers(answers, claims, expected).collect()}
    assert rows["a"].answer_success and rows["u"].answer_success and rows["u"].completeness is None
    w = rows["w"]
    assert (w.correctness, w.faithfulness, w.citation_accuracy, w.completeness, w.unsupported_claim_rate, w.answer_success) == (0, 0, 0, 0, 1, False)
    stage = evaluation.failure_stage({"indexed": F.lit(True), "retrieved": F.lit(False), "fused": F.lit(False)})
    assert spark.range(1).select(stage.alias("s")).first().s == "retrieved"


def test_numbering_across_runs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i) for i in rng.sample(range(-50, 1000), 200)] + [(None, 5), (None, 700)]
    df = spark.createDataFrame(rows, "file string, doc_id long").repartition(3)
    found = {(r.file, r.doc_id): r.page for r in numbering.number_rows(df, "file", "doc_id", "page", 40).collect()}
    for file in ("a", "b", None):
        own = sorted(i for f, i in rows if f == file)
        assert [found[file, i] for i in own] == list(range(1, len(own) + 1))


def test_unions_group_right_in_any_session(spark):
    """Parts that reuse each other's exchange under other names; a session that keeps Spark's defaults."""
    import duckdb

    plain = spark.newSession()
    plain.conf.set("spark.sql.unionOutputPartitioning", "true")
    place = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("benchmark", "documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{place}/{name}.parquet'")
    for name in ("stage_losses", "hybrid_retrieval"):
        found = registry.queries()[name](plain, place)
        made = con.execute(registry.oracle_sql()[name])
        order = [[c[0] for c in made.description].index(c) for c in found.columns]
        want = [tuple(row[i] for i in order) for row in made.fetchall()]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_a_quoted_phrase_may_hold_the_word_or(spark):
    asked = spark.createDataFrame([(1, '"alpha OR beta" gamma')], "query_id long, question string")
    docs = spark.createDataFrame([(1, "alph z"), (2, "alpha or beta"), (3, "beta"), (4, "gamma")], "doc_id long, text string")
    parsed = lexical.parse_questions(asked)
    assert parsed.first().clauses == ['"alpha OR beta"', "gamma"]
    assert sorted(r.doc_id for r in lexical.clause_search(parsed, docs).collect()) == [2, 4]


def test_candidates_are_three_times_as_many(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "item_id long, embedding array<float>")
    queries = items.filter("item_id = 3").withColumnRenamed("item_id", "query_id")
    assert dense.candidates(queries, items, 2).count() == 6 and dense.candidates(queries, items, 2, 4).count() == 4
    with pytest.raises(ValueError):
        dense.candidates(queries, items, 5, 4)


def test_every_distinct_score_is_a_threshold(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0.1234567, 0.1234568, 0.5, -0.25, 1.5, rng.random()]), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, True)], "score double, relevant boolean")
    found = {r.threshold: r.accuracy for r in dense.calibrate_threshold(df).collect()}
    want = {t: round(sum((s >= t) == good for s, good in rows) / len(rows), 6) for t in {0.0, 1.0, *(s for s, _ in rows)}}
    assert found == want
    none = dense.calibrate_threshold(df.limit(0)).collect()
    assert {r.threshold for r in none} == {0.0, 1.0} and all(r.accuracy is None for r in none)


def test_calibration_with_rows_without_a_score(spark):
    rows = [(0.2, False), (0.7, True), (float("nan"), True), (None, False), (None, True)]
    df = spark.createDataFrame(rows, "score double, relevant boolean")
    found = {str(r.threshold): r.accuracy for r in dense.calibrate_threshold(df, unscored=True).collect()}
    # In order, with 0 and 1: 0, 0.2, 0.7, 1, nan, None. What is below a threshold counts if bad, the rest if good.
    assert found == {"0.0": 0.6, "0.2": 0.6, "0.7": 0.8, "1.0": 0.6, "nan": 0.6, "None": 0.4}
    equal = spark.createDataFrame([(float("nan"), 0.6), (None, 0.6), (1.0, 0.6), (2.0, 0.6)], "t double, accuracy double")
    assert evaluation.best_configuration(equal, ["accuracy"], "t", "t").first().t == 1.0


def test_questions_that_cannot_be_asked(spark):
    questions = spark.createDataFrame([(1, "what", "a"), (2, " \n", "a"), (3, "what", "b"), (4, "what", "x"), (5, None, "x"), (6, "what", "c")], "query_id long, question string, document_id string")
    catalog = spark.createDataFrame([("a", "ready"), ("b", "processing"), ("c", "superseded")], "document_id string, status string")
    found = {r.query_id: r.problem for r in lexical.question_problems(questions, catalog).collect()}
    assert found == {2: "empty question", 3: "document not ready", 4: "unknown document", 5: "empty question", 6: "unknown document"}


def test_union_metrics_and_tags(spark):
    a, b = ranked(spark, [(1, 10, 1), (1, 11, 2), (2, 20, 1)]), ranked(spark, [(1, 11, 1), (1, 12, 2)])
    relevant = spark.createDataFrame([(1, 12), (1, 13), (3, 1)], "query_id long, doc_id long")
    found = {r.query_id: tuple(r)[1:] for r in fusion.union_metrics([a, b], relevant).collect()}
    assert found == {1: (3, True, 0.5), 3: (0, False, 0.0)}
    metrics = spark.createDataFrame([(1, 1, 1.0), (2, None, 0.0), (3, 2, 0.5)], "case_id long, first_rank int, rr double")
    tags = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["x", None]), (3, [])], "case_id long, tags array<string>")
    assert {r.tag: (r.cases, r.rr) for r in evaluation.by_tag(metrics, tags).collect()} == {"x": (2, 0.5), "y": (1, 1.0)}


def test_cutoffs_by_metrics(spark):
    rows = [(1, 10, 3, False, 1), (1, 11, 1, False, 2), (2, 20, None, True, 1), (3, 30, 1, False, 1)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score int, fallback boolean, reranked_rank int")
    judged = spark.createDataFrame([(1, 11), (2, 20)], "query_id long, doc_id long")
    cases = spark.createDataFrame([(1, True), (2, True), (3, False)], "query_id long, answerable boolean")
    found = {r.cutoff: r for r in rerank.cutoff_metrics(df, judged, cases).collect()}
    assert [(found[k].unanswerable_empty, found[k].mean_kept, found[k].rr) for k in range(4)] == [(0.0, 1.333333, 0.75)] * 2 + [(1.0, 0.666667, 0.5)] * 2


def test_candidates_are_told_apart_by_document_and_hash(spark):
    rows = lambda r: spark.createDataFrame(r, "query_id long, doc_id long, hash string, rank int")
    lists = {"a": rows([(1, 5, "x", 1), (1, 6, "x", 2), (1, 5, "x", 3)]), "b": rows([(1, 6, "x", 1), (1, 5, "y", 2)])}
    found = {(r.doc_id, r.hash): (r.a_rank, r.b_rank, r.fused_rank) for r in fusion.fuse(lists, 10, identity=("doc_id", "hash")).collect()}
    assert found == {(6, "x"): (2, 1, 1), (5, "x"): (1, None, 2), (5, "y"): (None, 2, 3)}


def test_only_scans_that_leave_cores_idle_are_dealt_out(spark):
    from foliant.tables import spread

    few, enough = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 3)
    dealt = spread(few, "id")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(100))
    assert spread(enough, "id") is enough


def test_words_hashed_once_decide_as_those_of_each_row(spark):
    texts = spark.createDataFrame([(1, "red green blue"), (2, "Blue, green: red!"), (3, "something else"), (4, ""), (5, None), (9, "red")], "item_id long, text string")
    found = spark.createDataFrame([(q, i, i, 0.9 if i != 3 else 0.1) for q in (1, 2) for i in (1, 2, 3, 4, 5)], "query_id long, item_id long, rank int, score double")
    decided = lambda rows: sorted(tuple(r) for r in evidence.greedy_select(rows, 5, 0.8, 0.5).collect())
    once = decided(evidence.with_words(found, texts))
    assert once == decided(found.join(texts, "item_id"))
    assert [r[1:] for r in once if r[0] == 1] == [(1, 1, "kept", None), (2, 2, "near_duplicate", 1), (3, 3, "below_threshold", None), (4, 4, "kept", None), (5, 5, "near_duplicate", 4)]


def test_exact_matches_against_contains(spark):
    texts = ["Ab cd. EF gh", "xab cdy", "ab  cd", "the risk-based", "RISKS, and", "a..b", None, "", "ÀB cd ef gh ij", "cd ef gh", "ß ab\ncd"]
    asked = ["ab cd", "risk", " risk", "..", "cd. ef gh", "b cd ef", "AB", "cd ef gh", "gh", "risk", "-", "", None, "àb cd ef gh", "ab\ncd"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    docs = spark.createDataFrame([(f"d{i}", x) for i, x in enumerate(texts)], "doc_id string, text string")
    found = sorted(map(tuple, lexical.exact_matches(queries, docs).collect()))
    assert found == sorted((q, f"d{i}") for q, a in enumerate(asked) if a for i, x in enumerate(texts) if x and a.lower() in x.lower())


def test_exact_and_phrase_search_carry_no_text_from_word_to_word(spark):
    queries = spark.createDataFrame([(1, "ab cd ef")], "query_id long, text string")
    docs = spark.createDataFrame([(7, "Ab cd ef ab cd, ab")], "doc_id long, text string")
    for found in (lexical.exact_matches(queries, docs), lexical.phrase_matches(queries.withColumnRenamed("text", "phrase"), docs)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode" not in plan and "Generate posexplode" not in plan
    counts = lexical.phrase_matches(spark.createDataFrame([(1, "ab, cd"), (1, "ab"), (2, "zz")], "query_id long, phrase string"), docs)
    assert sorted(map(tuple, counts.collect())) == [(1, "ab", 7, 3), (1, "ab, cd", 7, 2)]
