"""A catalog of immutable snapshots: every change is a new one, published by a manifest that only one writer can create.

    root/manifests/0000000007.json   where the tables of version 7 lie, and its ledger of migrations
    root/tables/<name>/...           Parquet, written once

A writer starts from the snapshot it has read and publishes the next version.
If another has published that version meanwhile, it gets a Conflict, and
nothing that readers see has changed. The manifest is renamed into its place
without overwriting, which is one step where the store renames in one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import stacked
from . import catalog

DOCUMENTS = "document_id string, filename string, content_hash string, status string, updated_at long, chunk_count long, processing_error string"
CHUNKS = "document_id string, chunk_index long, text string"


class Conflict(Exception):
    """Another writer has published the version."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    documents: DataFrame
    chunks: DataFrame
    ledger: dict[int, str] = field(default_factory=dict)  # checksums of applied migrations by version


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _files(self):
        place = self._hadoop.Path(f"{self._root}/manifests")
        return place.getFileSystem(self._conf), place

    def versions(self) -> list[int]:
        files, place = self._files()
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, version: int | None = None) -> Snapshot:
        """A published snapshot, the newest by default; before the first there is an empty version 0."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return Snapshot(0, self._spark.createDataFrame([], DOCUMENTS), self._spark.createDataFrame([], CHUNKS))
        manifest = json.loads(self._spark.read.text(self._manifest(version), wholetext=True).first()[0])
        tables = {n: self._spark.read.parquet(f"{self._root}/tables/{manifest[n]}") for n in ("documents", "chunks")}
        return Snapshot(version, **tables, ledger={int(k): v for k, v in manifest["ledger"].items()})

    def _manifest(self, version: int) -> str:
        return f"{self._root}/manifests/{version:010d}.json"

    def publish(self, base: Snapshot, new: Snapshot) -> Snapshot:
        """Write ``new`` as the version after ``base``; tables that are still the base's are not written again."""
        before = self._names(base.version)
        names = {}
        for table in ("documents", "chunks"):
            frame = getattr(new, table)
            if base.version and frame is getattr(base, table):
                names[table] = before[table]
                continue
            names[table] = uuid.uuid4().hex
            frame.write.option("compression", "zstd").parquet(f"{self._root}/tables/{names[table]}")
        self._create(base.version + 1, json.dumps(names | {"ledger": new.ledger}))
        return self.read(base.version + 1)

    def _names(self, version: int) -> dict:
        return json.loads(self._spark.read.text(self._manifest(version), wholetext=True).first()[0]) if version else {}

    def _create(self, version: int, text: str) -> None:
        files, place = self._files()
        files.mkdirs(place)
        draft = self._hadoop.Path(place, f"draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm, gateway = self._spark.sparkContext._jvm, self._spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        final = self._hadoop.Path(self._manifest(version))
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} has been published by another writer") from None
            raise

    def ingest(self, incoming: DataFrame, base: Snapshot | None = None) -> Snapshot:
        """Publish ``incoming`` (filename, content_hash, updated_at) as documents that are processing; without news there is no new version."""
        base = self.read() if base is None else base
        rows = upserted(base.documents, incoming)
        if rows.exceptAll(base.documents).isEmpty():
            return base
        return self.publish(base, replace(base, documents=rows))

    def finish(self, chunks: DataFrame, errors: DataFrame, base: Snapshot | None = None) -> Snapshot:
        """Publish what became of documents that are processing: chunks (document_id, chunk_index, text) make one ready, an error (document_id, error) failed.

        Chunks and states change in one version, in which a file has one ready document at most.
        """
        base = self.read() if base is None else base
        documents, owned = finished(base.documents, base.chunks, chunks, errors)
        return self.publish(base, replace(base, documents=documents, chunks=owned))

    def migrate(self, known: list[tuple[int, str, Callable[[Snapshot], Snapshot]]]) -> list[Snapshot]:
        """Apply the pending ones of (version, checksum, change) in order, each in a version of its own with its entry in the ledger.

        A migration that was applied with another checksum, or that the ledger has and ``known`` lacks, is an error.
        """
        base, out = self.read(), []
        checksums = {version: checksum for version, checksum, _ in known}
        wrong = sorted(v for v, c in base.ledger.items() if checksums.get(v) != c)
        if wrong or len(checksums) < len(known):
            raise ValueError(f"migrations changed, lost or listed twice: {wrong}")
        for version, checksum, change in sorted(known, key=lambda m: m[0]):
            if version not in base.ledger:
                new = change(base)
                base = self.publish(base, replace(new, ledger=base.ledger | {version: checksum}))
                out.append(base)
        return out


def upserted(documents: DataFrame, incoming: DataFrame) -> DataFrame:
    """``documents`` with every version (filename, content_hash) of ``incoming`` in it once.

    A new version is added as processing; one that is ready stays as it is;
    one that failed or was superseded is processed again.
    """
    rows = incoming.groupBy("filename", "content_hash").agg(F.max("updated_at").alias("updated_at"))
    rows = rows.withColumn("document_id", catalog.document_id(F.col("filename"), F.col("content_hash")))
    again = documents.join(rows.select("document_id", F.col("updated_at").alias("again")), "document_id", "left")
    redo = F.col("again").isNotNull() & F.col("status").isin("failed", "superseded")
    kept = again.withColumns({
        "status": F.when(redo, "processing").otherwise(F.col("status")),
        "updated_at": F.when(redo, F.col("again")).otherwise(F.col("updated_at")),
        "processing_error": F.when(~redo, F.col("processing_error")),
    }).drop("again")
    new = rows.join(documents, "document_id", "left_anti").withColumns({"status": F.lit("processing"), "chunk_count": F.lit(0).cast("long"), "processing_error": F.lit(None).cast("string")})
    return stacked(kept.select(*documents.columns), new.select(*documents.columns))


def finished(documents: DataFrame, chunks: DataFrame, new: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after processing; what is said of documents that aren't processing is ignored."""
    running = documents.filter("status = 'processing'").select("document_id")
    new = new.join(errors, "document_id", "left_anti").join(running, "document_id", "left_semi").select(*chunks.columns)
    counts = new.groupBy("document_id").agg(F.count(F.lit(1)).alias("made"))
    rows = catalog.mark_failed(documents, errors).join(counts, "document_id", "left")
    done = F.col("made").isNotNull()
    rows = rows.withColumns({"status": F.when(done, "ready").otherwise(F.col("status")), "chunk_count": F.coalesce("made", "chunk_count")}).withColumn("newest", done).drop("made")
    fresh = rows.filter("newest").groupBy("filename").agg(F.max(F.struct("updated_at", "document_id")).alias("fresh"))
    rows = rows.join(fresh.select("filename", F.col("fresh.document_id").alias("now")), "filename", "left")
    older = (F.col("status") == "ready") & F.col("now").isNotNull() & (F.col("document_id") != F.col("now"))
    rows = rows.withColumn("status", F.when(older, "superseded").otherwise(F.col("status")))
    return rows.select(*documents.columns), catalog.replace_chunks(chunks, new)
