import pytest
from pyspark.sql import functions as F

from foliant.operators import dense, evaluation, expansion, grounding
from foliant.sources import catalog, files

SUPPORT = "array<struct<source_id:string,quote:string>>"


def test_listing_and_lookup(spark):
    rows = spark.createDataFrame(
        [("a", "f", "superseded", 1, None), ("b", "f", "ready", 2, None), ("c", "g", "failed", 3, "secret key"), ("d", "g", "processing", 3, "old")],
        "document_id string, filename string, status string, updated_at int, processing_error string",
    )
    listed = catalog.listing(rows).collect()
    assert [r.document_id for r in listed] == ["d", "c", "b"]
    assert {r.document_id: r.processing_error for r in listed} == {"b": None, "c": catalog.FAILED_NOTICE, "d": None}
    ids = spark.createDataFrame([("a",), ("b",), ("x",), ("b",)], "document_id string")
    assert {r.document_id: (r.found, r.status) for r in catalog.found(rows, ids).collect()} == {"a": (False, None), "b": (True, "ready"), "x": (False, None)}
    assert catalog.listing(rows.limit(0)).count() == 0 and catalog.found(rows, ids.limit(0)).count() == 0


def test_embedding_problems(spark):
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, 2.0]), (3, [0.0, 2.0]), (9, [1.0, 2.0]), (4, None)], "item_id int, embedding array<double>")
    found = {r.item_id: r.problem for r in dense.embedding_problems(items, vectors, 2).collect()}
    assert found == {2: "wrong size", 3: "several vectors", 4: "wrong size", 9: "no item"}
    assert dense.embedding_problems(items, vectors.limit(0), 2).count() == 4


def test_expanded_questions(spark):
    questions = spark.createDataFrame([(1, "How large is the warranty"), (2, "Who wrote ISO-9001 rules"), (3, "Anything")], "query_id int, question string")
    synonyms = spark.createDataFrame([("Large", "big"), ("large", "huge"), ("iso-9001", "standard")], "term string, synonym string")
    rewrites = expansion.synonym_rewrites(questions, synonyms)
    assert {r.query_id: r.alternative for r in rewrites.collect()} == {1: "How big is the warranty", 2: "Who wrote standard rules"}
    out = {r.query_id: r for r in expansion.expanded_questions(questions, rewrites).collect()}
    assert (out[1].used_expansion, out[1].fallback_reason) == (True, None)
    assert (out[2].used_expansion, out[2].fallback_reason, out[2].alternative) == (False, "protected term removed", "Who wrote standard rules")
    assert (out[3].used_expansion, out[3].fallback_reason) == (False, "no rewrite")


def test_feedback_citations_and_rendering(spark):
    claims = spark.createDataFrame(
        [(1, 0, "Pumps need oil every year", [("S1", "pumps need oil every year"), ("S2", "not there")]), (1, 1, "Filters need water", [("S2", "filters need water")])],
        f"query_id int, claim_idx int, text string, supports {SUPPORT}",
    )
    evidence = spark.createDataFrame([(1, "S1", 1, "All pumps  need oil every year."), (1, "S2", 2, "Filters need water. " + "x" * 300), (1, "S3", 3, "unused")], "query_id int, source_id string, position int, passage string")
    found = {(r.claim_idx, r.support): (r.source_id, r.problem) for r in grounding.repair_feedback(claims, evidence).collect()}
    assert found == {(0, None): (None, "quote not found"), (0, 1): ("S2", "quote not found")}
    cited = {r.source_id: r.preview for r in grounding.cited_evidence(claims, evidence).collect()}
    assert set(cited) == {"S1", "S2"} and cited["S1"] == "All pumps need oil every year." and len(cited["S2"]) == 243
    answers = spark.createDataFrame([(1, "partially_answered", " the price ")], "query_id int, status string, insufficient_reason string")
    text = "Pumps need oil every year [S1][S2] Filters need water [S2]"
    assert grounding.rendered(claims).first().answer == text
    assert grounding.rendered(claims, answers).first().answer == f"{text} {grounding.LIMITATION}the price"
    whole = answers.withColumn("status", F.lit("answered"))
    assert grounding.rendered(claims, whole).first().answer == text


def test_regrade_subset_and_report(spark):
    saved = spark.createDataFrame([("a", 1.0, None), ("b", 0.5, 1.0), ("c", 0.0, 0.0)], "case_id string, correctness double, completeness double")
    again = spark.createDataFrame([("a", 1.0, None), ("b", 0.5, None), ("d", 0.0, 0.0)], "case_id string, correctness double, completeness double")
    assert {r.case_id: r.state for r in evaluation.regraded(saved, again).collect()} == {"a": "same", "b": "changed", "c": "lost", "d": "new"}
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "case_id string")
    assert [r.case_id for r in evaluation.of_cases(saved, ids).collect()] == ["a"]
    run = files.run_id("x")
    assert len(run) == 12 and run == files.run_id("x") != files.run_id("y")
    rows = files.report_rows(run, {"cases": saved, "none": again.limit(0)}).collect()
    assert len(rows) == 3 and {r.section for r in rows} == {"cases"} and '{"case_id":"a","correctness":1.0,"completeness":null}' in {r.json for r in rows}


def test_saved_reports_are_sealed(spark, tmp_path):
    cases = spark.createDataFrame([(1, 0.5, None), (2, 1.0, True)], "case_id long, score double, success boolean")
    rows = files.report_rows("run", {"cases": cases, "summary": cases.selectExpr("count(*) AS n")})
    place = str(tmp_path / "report")
    files.save_report(rows, place, dataset="d1")
    saved = files.saved_report(spark, place, dataset="d1")
    assert sorted(map(tuple, saved.collect())) == sorted(map(tuple, rows.collect()))
    again = files.section(saved, "cases", "case_id long, score double, success boolean")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, cases.collect()), key=repr)
    with pytest.raises(ValueError, match="other dataset"):
        files.saved_report(spark, place, dataset="d2")
    part = next(p for p in (tmp_path / "report" / "rows").iterdir() if p.suffix == ".json" and p.stat().st_size)
    part.write_text(part.read_text() * 2)
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="other rows"):
        files.saved_report(spark, place, dataset="d1")


def test_regrading_names_the_fields(spark):
    saved = spark.createDataFrame([(1, 1.0, None), (2, 0.5, 1.0)], "case_id long, a double, b double")
    again = spark.createDataFrame([(1, 1.0, None), (2, 0.4, None)], "case_id long, a double, b double")
    assert {r.case_id: (r.state, r.fields) for r in evaluation.regraded(saved, again).collect()} == {1: ("same", None), 2: ("changed", "a,b")}
