"""Files in and out: uploads, judged datasets, and reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import stacked

MOST_BYTES = 25 * 1024 * 1024
SIGNATURE = "%PDF-"

CONTENT_TYPES = ["application/pdf", "application/x-pdf"]
HASH = "^[0-9a-f]{64}$"

CASES = (
    "schema_version int, name string, split string, cases array<struct<id:string, filename:string, question:string, answerable:boolean, "
    "document_content_hash:string, relevant_chunk_indices:array<int>, relevant_chunk_hashes:array<string>, relevance_grades:map<string,int>, "
    "reference_answer:string, notes:string, tags:array<string>>>"
)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with the first rule that each breaks, or null: name, size, signature within the first kilobyte.

    Spark's readers leave files without bytes out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = base_name(F.col("path"))
    return files.select("path", name.alias("name"), "length", upload_problem(name, F.col("length"), F.col("content")).alias("problem"))


def base_name(name: Column) -> Column:
    """What is behind the last slash of either kind, without white space around it."""
    return F.trim(F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1))


def upload_problem(name: Column, length: Column, content: Column, content_type: Column | None = None) -> Column:
    """The first rule that an upload breaks; its declared ``content_type`` is checked if there is one."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    plain = base_name(F.coalesce(name, F.lit("")))
    other = F.lit(False) if content_type is None else ~F.coalesce(F.lower(content_type).isin(*CONTENT_TYPES), F.lit(False))
    return (
        F.when(plain == "", "no name")
        .when(F.length(plain) > 255, "name too long")
        .when(name.contains("\0"), "bad name")
        .when(~F.lower(plain).endswith(".pdf"), "not a .pdf")
        .when(other, "other content type")
        .when(length == 0, "empty")
        .when(length > MOST_BYTES, "too large")
        .when(~head.contains(SIGNATURE), "no signature")
    )


def judged_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of JSON datasets, with their problems and the SHA-256 of the file's bytes (``dataset_hash``)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sets = found.select(F.sha2("content", 256).alias("dataset_hash"), F.from_json(F.decode("content", "UTF-8"), CASES).alias("d")).select("dataset_hash", "d.*")
    rows = sets.select("dataset_hash", "schema_version", "split", F.explode("cases").alias("c")).select("dataset_hash", "schema_version", "split", "c.*")
    same = Window.partitionBy("dataset_hash", "id")
    again = F.when(F.count(F.lit(1)).over(same) > 1, F.array(F.lit("repeated id"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("problems", F.concat(case_problems(), again))


def case_problems() -> Column:
    """The rules that a case breaks. Grades are keyed by chunk indices, or by hashes in a case that has no indices."""
    none = F.array().cast("array<string>")
    hashes = F.coalesce("relevant_chunk_hashes", none)
    indices = F.coalesce(F.col("relevant_chunk_indices").cast("array<string>"), none)
    labels = F.when(F.size(indices) > 0, indices).otherwise(hashes)
    graded = F.coalesce("relevance_grades", F.create_map().cast("map<string,int>"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    hashed = lambda c: c.rlike(HASH)
    rules = {
        "unknown schema version": F.coalesce(F.col("schema_version") != 1, F.lit(True)),
        "unknown split": ~F.coalesce(F.col("split").isin("development", "calibration", "held_out"), F.lit(False)),
        "empty id": blank("id"),
        "empty filename": blank("filename"),
        "empty question": blank("question"),
        "answerable not said": F.col("answerable").isNull(),
        "answerable without labels": F.coalesce("answerable", F.lit(False)) & (F.size(labels) == 0),
        "unanswerable with labels": ~F.coalesce("answerable", F.lit(True)) & (F.size(labels) > 0),
        "negative index": F.exists(F.coalesce("relevant_chunk_indices", F.array().cast("array<int>")), lambda i: F.coalesce(i < 0, F.lit(True))),
        "bad hash": F.exists(hashes, lambda h: ~F.coalesce(hashed(h), F.lit(False))) | ~F.coalesce(hashed(F.trim("document_content_hash")), F.lit(True)),
        "hashes and indices differ": (F.size(indices) > 0) & (F.size(hashes) > 0) & (F.size(indices) != F.size(hashes)),
        "repeated label": (F.size(labels) != F.size(F.array_distinct(labels))) | (F.size(hashes) != F.size(F.array_distinct(hashes))),
        "grade not positive": F.exists(F.map_values(graded), lambda g: F.coalesce(g <= 0, F.lit(True))),
        "grade of an unlisted chunk": F.size(F.array_except(F.map_keys(graded), labels)) > 0,
        "empty tag": F.exists(F.coalesce("tags", none), blank),
    }
    return F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull())


def judgments(cases: DataFrame) -> DataFrame:
    """(case_id, label, grade, identity): a label is a chunk's hash where a case has hashes, else its index; without a grade it has 1."""
    hashes, indices = F.col("relevant_chunk_hashes"), F.col("relevant_chunk_indices").cast("array<string>")
    stable = F.coalesce(F.size(hashes) > 0, F.lit(False))
    labels = F.when(stable, hashes).otherwise(indices)
    keys = F.when(F.coalesce(F.size(indices) > 0, F.lit(False)), indices).otherwise(hashes)
    each = cases.filter("answerable").select(F.col("id").alias("case_id"), F.explode(F.arrays_zip(labels.alias("label"), keys.alias("key"))).alias("l"), "relevance_grades", F.when(stable, "hash").otherwise("index").alias("identity"))
    return each.select("case_id", "l.label", F.coalesce(F.try_element_at("relevance_grades", F.col("l.key")), F.lit(1)).alias("grade"), "identity")


def write_report(metrics: DataFrame, path: str) -> None:
    """Rows as JSON lines; the report of a run is what its folder holds."""
    metrics.write.mode("overwrite").json(path)


def run_id(seed: str) -> str:
    """Twelve hexadecimal digits that the same seed (dataset, settings, time) always gives."""
    return hashlib.sha256(seed.encode()).hexdigest()[:12]


def report_rows(run: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(run_id, section, json): every row of every section as a JSON text, however many there are."""
    of = lambda name, df: df.select(F.lit(run).alias("run_id"), F.lit(name).alias("section"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
    return stacked(*[of(name, df) for name, df in sections.items()])


def digest(rows: DataFrame) -> Column:
    """A digest of (section, json) rows in any order, as an aggregate: their number, and the sum of the first 60 bits of each row's SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("\n", "section", "json"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(bits), F.lit(0)).cast("string"))


def save_report(rows: DataFrame, path: str, **seals: str) -> None:
    """Write report_rows() below ``path`` as JSON lines, and beside them their digest and ``seals``: digests of what the run read, say."""
    rows.write.mode("errorifexists").json(f"{path}/rows")
    saved = rows.sparkSession.read.schema(REPORT).json(f"{path}/rows")
    seal = {name: F.lit(value) for name, value in seals.items()}
    saved.agg(digest(saved).alias("rows")).withColumns(seal).write.json(f"{path}/seal")


REPORT = "run_id string, section string, json string"


def saved_report(spark: SparkSession, path: str, **seals: str) -> DataFrame:
    """The rows of a saved report, if they are those that were saved and the run read what ``seals`` say."""
    rows = spark.read.schema(REPORT).json(f"{path}/rows")
    kept = spark.read.json(f"{path}/seal").first().asDict()
    found = rows.agg(digest(rows)).first()[0]
    wrong = [name for name, value in ({"rows": found} | seals).items() if kept.get(name) != value]
    if wrong:
        raise ValueError(f"the report below {path} has other {', '.join(wrong)} than it was saved with")
    return rows


def section(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """The rows of one section of a report, with their fields as columns."""
    return rows.filter(F.col("section") == name).select(F.from_json("json", schema).alias("r")).select("r.*")


def newest_report(spark: SparkSession, path: str) -> DataFrame:
    """The path and content of the file below ``path`` that was changed last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    newest = files.filter("length > 0").agg(F.max_by(F.struct("path", "content"), F.struct("modificationTime", "path")).alias("f"))
    return newest.select("f.path", F.decode("f.content", "UTF-8").alias("content"))


def as_markdown(rows: list, columns: list[str]) -> str:
    """A table of a few result rows, for reading."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows])
