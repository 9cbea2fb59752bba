from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from foliant.sources import snapshots


def states(store, version=None):
    return {(r.filename, r.content_hash): (r.status, r.chunk_count) for r in store.read(version).documents.collect()}


def test_a_file_goes_through_its_versions(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/catalog")
    assert store.versions() == [] and store.read().documents.count() == 0
    files = lambda *rows: spark.createDataFrame(rows, "filename string, content_hash string, updated_at long")
    first = store.ingest(files(("f", "1", 1), ("f", "1", 2), ("g", "1", 1)))
    assert first.version == 1 and states(store) == {("f", "1"): ("processing", 0), ("g", "1"): ("processing", 0)}
    assert store.ingest(files(("f", "1", 7))).version == 1  # known: nothing changes
    ids = {(r.filename, r.content_hash): r.document_id for r in first.documents.collect()}
    chunks = lambda *rows: spark.createDataFrame([(*r, "t") for r in rows], snapshots.CHUNKS)
    errors = lambda *rows: spark.createDataFrame(rows, "document_id string, error string")
    made = store.finish(chunks((ids["f", "1"], 0), (ids["f", "1"], 1), ("unknown", 0)), errors((ids["g", "1"], "x" * 3000)))
    assert states(store) == {("f", "1"): ("ready", 2), ("g", "1"): ("failed", 0)} and made.chunks.count() == 2
    assert made.documents.filter("filename = 'g'").first().processing_error == "x" * 2000
    third = store.ingest(files(("f", "2", 3), ("g", "1", 3)))
    assert states(store) == {("f", "1"): ("ready", 2), ("f", "2"): ("processing", 0), ("g", "1"): ("processing", 0)}
    new = next(r.document_id for r in third.documents.collect() if r.content_hash == "2")
    store.finish(chunks((new, 0)), errors((ids["f", "1"], "late")))  # what is said of a ready document doesn't count
    assert states(store) == {("f", "1"): ("superseded", 2), ("f", "2"): ("ready", 1), ("g", "1"): ("processing", 0)}
    assert states(store, 2)[("f", "1")] == ("ready", 2) and store.versions() == [1, 2, 3, 4]  # old snapshots stay
    assert store.ingest(files().limit(0)).version == 4


def test_of_two_writers_one_loses_and_nothing_changes(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "catalog"))
    files = spark.createDataFrame([("f", "1", 1)], "filename string, content_hash string, updated_at long")
    base = store.ingest(files)
    one, other = (store.read() for _ in range(2))
    kept = store.publish(one, replace(one, documents=one.documents.withColumn("status", F.lit("failed"))))
    with pytest.raises(snapshots.Conflict):
        store.publish(other, replace(other, documents=other.documents.withColumn("status", F.lit("ready"))))
    assert store.versions() == [1, 2] and states(store) == {("f", "1"): ("failed", 0)}
    assert states(store, base.version) == {("f", "1"): ("processing", 0)} and kept.version == 2
    assert not [p for p in (tmp_path / "catalog" / "manifests").iterdir() if "draft" in p.name]


def test_migrations_are_applied_once_and_in_order(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "catalog"))
    add = lambda name: lambda s: replace(s, documents=s.documents.withColumn(name, F.lit(name)))
    known = [(2, "bb", add("second")), (1, "aa", add("first"))]
    assert [s.version for s in store.migrate(known[1:])] == [1]
    assert [s.version for s in store.migrate(known)] == [2] and store.migrate(known) == []
    assert store.read().ledger == {1: "aa", 2: "bb"} and store.read().documents.columns[-2:] == ["first", "second"]
    for wrong in ([(1, "other", add("x"))], [(1, "aa", add("x"))], [*known, (2, "bb", add("x"))]):
        with pytest.raises(ValueError):
            store.migrate(wrong)
    assert store.versions() == [1, 2]
