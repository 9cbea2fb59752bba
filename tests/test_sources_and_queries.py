import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from foliant.plans import registry
from foliant.sources import catalog, files
from foliant.streaming import ingest

SMALL = "/root/testdata/sf0.001"
TABLES = ["customer", "documents", "embeddings", "benchmark", "labels", "conversations", "events"]


def entries(spark, rows):
    return spark.createDataFrame(rows, "document_id string, filename string, status string, updated_at int, processing_error string, chunk_count int")


def test_catalog(spark):
    rows = entries(spark, [("a", "f", "ready", 1, None, 3), ("b", "f", "ready", 2, None, 3), ("c", "f", "processing", 3, None, 0), ("d", "g", "failed", 1, "x", 0)])
    states = {r.document_id: r.status for r in catalog.supersede(rows).collect()}
    assert states == {"a": "superseded", "b": "ready", "c": "processing", "d": "failed"}
    errors = spark.createDataFrame([("c", "e" * 3000), ("b", "late")], "document_id string, error string")
    failed = {r.document_id: r for r in catalog.mark_failed(rows, errors).collect()}
    assert failed["c"].status == "failed" and len(failed["c"].processing_error) == 2000 and failed["b"].status == "ready"
    chunks = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "document_id string, chunk_index int")
    left, kept = catalog.delete(rows, chunks, spark.createDataFrame([("a",), ("c",)], "document_id string"))
    assert {r.document_id for r in left.collect()} == {"b", "c", "d"} and {r.document_id for r in kept.collect()} == {"b", "c"}
    new = spark.createDataFrame([("b", 0), ("b", 1)], "document_id string, chunk_index int")
    assert catalog.replace_chunks(chunks, new).filter("document_id = 'b'").count() == 2
    current = catalog.is_current(rows, {"filename": F.lit("f")}).filter("current").select("document_id").collect()
    assert {r[0] for r in current} == {"a", "b"}
    known = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "version int, checksum string")
    applied = spark.createDataFrame([(1, "x"), (2, "other"), (9, "q")], "version int, checksum string")
    assert {r.version: r.state for r in catalog.migration_status(known, applied).collect()} == {1: "applied", 2: "changed", 3: "pending", 9: "unknown"}


def test_uploads(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"no", "c.txt": b"%PDF-", "d.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.name: r.problem for r in files.uploads(spark, str(tmp_path)).collect()}
    assert found == {"a.pdf": None, "b.pdf": "no signature", "c.txt": "not a .pdf"}  # Spark's readers leave files without bytes out


def test_names_and_content_types_of_uploads(spark):
    rows = [("C:\\dir\\a.pdf", None), (" ", "application/pdf"), ("../x/b.PDF ", "Application/PDF"), ("c.pdf", "text/plain"), (None, "application/pdf"), ("d" * 260 + ".pdf", "application/pdf")]
    df = spark.createDataFrame([(n, t, bytearray(b"%PDF-1")) for n, t in rows], "name string, kind string, content binary")
    found = df.select(files.base_name(F.col("name")).alias("n"), files.upload_problem(F.col("name"), F.length("content"), F.col("content"), F.col("kind")).alias("p")).collect()
    assert [r.p for r in found] == ["other content type", "no name", None, "other content type", "no name", "name too long"]
    assert [r.n for r in found[:3]] == ["a.pdf", "", "b.PDF"]


def test_judged_cases_and_reports(spark, tmp_path):
    h, i = "a" * 64, "b" * 64
    cases = [
        {"id": "x", "filename": "f", "question": "q", "answerable": True, "relevant_chunk_hashes": [h, i], "relevance_grades": {h: 2}},
        {"id": "y", "filename": "f", "question": " ", "answerable": False, "relevant_chunk_hashes": [h, h], "relevance_grades": {"z": 0}},
        {"id": "v", "filename": "f", "question": "q", "answerable": True, "relevant_chunk_indices": [3, 5], "relevant_chunk_hashes": [i, h], "relevance_grades": {"3": 2, "5": 3}, "notes": "n", "tags": ["t"]},
        {"id": "w", "filename": "f", "question": "q", "answerable": True, "relevant_chunk_indices": [0], "document_content_hash": h},
        {"id": "u", "question": "q", "relevant_chunk_indices": [-1, 2], "relevant_chunk_hashes": ["short"], "document_content_hash": "x", "tags": [" "]},
        {"id": "u", "filename": "f", "question": "q", "answerable": False},
    ]
    (tmp_path / "set.json").write_text(json.dumps({"schema_version": 1, "name": "n", "split": "development", "cases": cases}))
    rows = files.judged_cases(spark, str(tmp_path / "set.json"))
    text = (tmp_path / "set.json").read_bytes()
    assert {r.dataset_hash for r in rows.collect()} == {hashlib.sha256(text).hexdigest()}
    problems = {r.id: r.problems for r in rows.filter("filename is not null").collect()}
    assert problems["u"] == ["repeated id"] and problems["v"] == problems["w"] == []
    broken = rows.filter("filename is null").first().problems
    assert broken == ["empty filename", "answerable not said", "negative index", "bad hash", "hashes and indices differ", "empty tag", "repeated id"]
    assert problems["x"] == [] and set(problems["y"]) == {"empty question", "unanswerable with labels", "repeated label", "grade not positive", "grade of an unlisted chunk"}
    found = sorted(map(tuple, files.judgments(rows).collect()))
    assert found == [("v", h, 3, "hash"), ("v", i, 2, "hash"), ("w", "0", 1, "index"), ("x", h, 2, "hash"), ("x", i, 1, "hash")]
    files.write_report(spark.createDataFrame([(1, 0.5)], "k int, v double"), str(tmp_path / "out"))
    assert json.loads(files.newest_report(spark, str(tmp_path / "out")).first().content) == {"k": 1, "v": 0.5}
    assert files.as_markdown([{"a": 1, "b": None}], ["a", "b"]).splitlines() == ["| a | b |", "| --- | --- |", "| 1 |  |"]


def test_streamed_pages_become_chunks_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "file string, page_number int, cleaned_text string"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    write([("f", 1, "First text here."), ("g", 1, "Other text there.")])
    run = lambda: ingest.ingest(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "check")).awaitTermination()
    run()
    write([("f", 1, "New text instead.")])
    run()
    found = {(r.file, r.passage_text) for r in ingest.current_chunks(spark, target).collect()}
    assert found == {("f", "New text instead."), ("g", "Other text there.")}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    rel = db.sql(registry.oracle_sql()[name])
    columns, other = df.columns, rel.columns
    assert sorted(columns) == sorted(other)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    theirs = sorted(repr([plain(r[other.index(c)]) for c in sorted(columns)]) for r in rel.fetchall())
    assert ours == theirs


def test_entry_has_rows(spark):
    import __spark_entry__

    if os.path.isdir(SMALL):
        assert __spark_entry__.entry(spark).count() > 0
