"""Judged datasets and migrations: validation, export, and binding labels to chunk identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = (
    "schema_version int, cases array<struct<id:string, run_mode:string, case_type:string, question:string, expected_statuses:array<string>, "
    "expected_claims:array<struct<id:string, required:boolean, term_groups:array<array<string>>, evidence_hashes:array<string>>>, "
    "synthetic_evidence:array<struct<content_hash:string, page_start:int, page_end:int, passage_text:string>>>>"
)
STATUSES = ["answered", "partially_answered", "insufficient_evidence"]
CASE_TYPES = ["answerable", "partially_answerable", "conflicting_evidence", "unanswerable"]
MIGRATION = r"([0-9]{4})_([a-z0-9_]+)\.sql$"


def answer_case_problems() -> Column:
    """Problems of answer cases; the columns are the fields of ANSWERS."""
    none = F.array()
    claims = F.coalesce("expected_claims", none.cast("array<struct<id:string,required:boolean,term_groups:array<array<string>>,evidence_hashes:array<string>>>"))
    ids = F.transform(claims, lambda c: c["id"])
    rules = {
        "unknown case type": ~F.coalesce(F.col("case_type").isin(*CASE_TYPES), F.lit(False)),
        "unknown status": F.coalesce(F.exists("expected_statuses", lambda s: ~s.isin(*STATUSES)), F.lit(True)),
        "empty question": F.coalesce(F.trim("question") == "", F.lit(True)),
        "repeated claim": F.size(ids) != F.size(F.array_distinct(ids)),
        "claim without terms": F.exists(claims, lambda c: F.coalesce(F.size(c["term_groups"]) <= 0, F.lit(True))),
        "unanswerable with claims": (F.col("case_type") == "unanswerable") & (F.size(claims) > 0),
        "no required claim": (F.col("case_type") != "unanswerable") & ~F.exists(claims, lambda c: F.coalesce(c["required"], F.lit(False))),
        "pages out of order": F.coalesce(F.exists("synthetic_evidence", lambda e: e["page_end"] < e["page_start"]), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def bind_identities(labels: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (case_id, file, chunk_index) with the chunks' content hashes, and those whose chunk isn't there."""
    known = chunks.select("file", "chunk_index", "content_hash")
    return labels.join(known, ["file", "chunk_index"]), labels.join(known, ["file", "chunk_index"], "left_anti")


def relabel(cases: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgments (case_id, label, grade 1) from evidence matches (id, file, chunk_index), and answerable cases left without any."""
    judged = matches.select(F.col("id").alias("case_id"), F.col("chunk_index").alias("label"), F.lit(1).alias("grade")).distinct()
    lost = cases.filter("answerable").select(F.col("id").alias("case_id")).join(judged, "case_id", "left_anti")
    return judged, lost


def configuration_scores(matches: DataFrame, cases: DataFrame, configuration: str) -> DataFrame:
    """(configuration, cases, preserved): for how many cases a configuration's chunks keep the evidence whole."""
    kept = matches.select(configuration, "id").distinct().groupBy(configuration).agg(F.count(F.lit(1)).alias("preserved"))
    total = cases.agg(F.count_distinct("id").alias("cases")).withColumn("all", F.lit(0))  # one row
    return kept.withColumn("all", F.lit(0)).join(F.broadcast(total), "all").drop("all")


def exported(cases: DataFrame, version: int = 1) -> DataFrame:
    """One JSON text a case, in the dataset's own form."""
    return cases.select("id", F.to_json(F.struct(F.lit(version).alias("schema_version"), *cases.columns), {"ignoreNullFields": "false"}).alias("json"))


def legacy_label(content: Column) -> Column:
    """Pages and section from the label that older chunks carry in their text."""
    first = F.regexp_extract(content, r"^\[Source pages? ([0-9]+)", 1)
    last = F.regexp_extract(content, r"^\[Source pages [0-9]+-([0-9]+)\]", 1)
    section = F.regexp_extract(content, r"(?m)^\[Section: (.*)\]$", 1)
    page = lambda c: F.when(c != "", c.cast("int"))
    return F.struct(page(first).alias("page_start"), F.coalesce(page(last), page(first)).alias("page_end"), F.when(section != "", section).alias("section_title"))


def migrations(spark, path: str) -> DataFrame:
    """(version, name, checksum, problem) of the SQL files below ``path``; a version that is there twice, or empty SQL, is a problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("sql")).filter(F.col("file").rlike(MIGRATION))
    rows = found.select(F.regexp_extract("file", MIGRATION, 1).cast("int").alias("version"), F.regexp_extract("file", MIGRATION, 2).alias("name"), F.sha2("sql", 256).alias("checksum"), "sql")
    twice = rows.groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("n") > 1, "version twice").when(F.trim("sql") == "", "empty")
    return rows.join(twice, "version").select("version", "name", "checksum", problem.alias("problem"))
