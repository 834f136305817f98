"""A file inventory, work ledger and listings seen in the given tables.

Each row of `documents` stands for one file: its text is the content, and name, times and
attributes follow from the id by fixed rules. Empty files are further rows, one for every fiftieth
document, with ids from a billion on. Which files are already known, still on disk, or back
at their old place follows from `labels`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.functions import text
from fileledger.operators.enrich import hash_content
from fileledger.operators.scan import describe_files
from fileledger.session import shared_folder

AS_OF = datetime(2026, 1, 1)
QUARANTINE_ROOT = "/quarantine"

# Suffixes handed out by id.
SUFFIXES = (
    ".txt", ".csv", ".json", ".log", ".tmp", ".bak", ".old", ".temp",
    ".swp", ".swo", ".txt~", "", ".pdf", ".jpeg", ".md", ".TXT",
)
# States handed out by id and kind.
STATES = ("pending", "queued", "running", "done", "error", "retry")

_FIRST_CREATED = 1577836800  # 2020-01-01
#: Ids of empty files begin here, beyond those of documents.
FIRST_EMPTY = 1_000_000_000


# Given outright, so that building a query starts no job to read file footers.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, source, lang, content): every document, and the empty files."""
    documents = table(spark, sf_dir, "documents")
    empty = documents.filter(F.col("doc_id") % 50 == 0).select(
        (F.col("doc_id") + FIRST_EMPTY).alias("file_id"), "source", "lang", F.lit("").alias("content")
    )
    files = documents.select(
        F.col("doc_id").alias("file_id"), "source", "lang", F.col("text").alias("content")
    )
    return files.unionByName(empty)


def listing_with_content(
    spark: SparkSession, sf_dir: str, shared_names: bool = False
) -> DataFrame:
    """The files as a directory walk would list them, with id, labels and content along."""
    d = F.col("file_id")
    number = d.cast("string")
    ext = _pick(SUFFIXES, d % len(SUFFIXES))
    if shared_names:
        # Many files of one name, and every fifth called like another with that one's id added.
        other = F.concat(_pick(SUFFIXES, (d + 1) % len(SUFFIXES)), F.lit("_"), (d + 1).cast("string"))
        tail = F.when(d % 5 == 0, other).otherwise(ext)
        path = F.concat(F.lit("/"), "source", F.lit("/"), number, F.lit("/"), "lang", tail)
    else:
        path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), number, ext)
    day = F.lit(86400)
    # Quarters of seconds; for some files nobody knows when they were created.
    started = F.lit(_FIRST_CREATED) + d * 7919 % 2000 * day + d * 31 % 86400 + d % 4 / 4
    created = F.when(d % 37 != 0, started)
    modified = started + d % 300 * day
    accessed = F.when(d % 29 != 0, modified + d * 13 % 400 * day)
    return contents(spark, sf_dir).select(
        "file_id",
        "source",
        "lang",
        "content",
        path.alias("path"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.lit(True).alias("is_file"),
        F.lit(False).alias("is_symlink"),
        (d % 64).cast("int").alias("attr_bits"),
        created.cast("double").alias("ctime"),
        modified.cast("double").alias("mtime"),
        accessed.cast("double").alias("atime"),
        F.lit(None).cast("string").alias("owner"),
        F.lit(None).cast("string").alias("error"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, and what else a walk meets: a folder, a link or a failure for every tenth."""
    listed = listing_with_content(spark, sf_dir)
    kind = F.col("file_id") % 30
    others = listed.filter(F.col("file_id") % 10 == 0).withColumns(
        {
            "path": F.concat("path", F.lit("+")),
            "is_file": kind != 0,
            "is_symlink": kind == 10,
            "error": F.when(kind == 20, F.lit("Permission denied")),
        }
    )
    return listed.unionByName(others).drop("file_id", "source", "lang", "content")


def metadata_document() -> Column:
    return F.to_json(
        F.struct(
            F.col("content").alias("titulo"),
            F.struct("source", "lang").alias("tags"),
            text.line_count(F.col("content")).alias("linhas"),
        )
    )


def inventory(spark: SparkSession, sf_dir: str, shared_names: bool = False) -> DataFrame:
    """The whole inventory; a query pays for the columns it uses."""
    listed = listing_with_content(spark, sf_dir, shared_names)
    described = describe_files(listed, keep=("file_id", "source", "lang", "content"))
    return (
        hash_content(described)
        .withColumn("metadata", metadata_document())
        .drop("source", "lang", "content")
    )


def inventory_without_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, sha256, content) before any file was hashed."""
    listed = listing_with_content(spark, sf_dir)
    return describe_files(listed, keep=("file_id", "content")).select(
        "file_id", "path", "ext", "size", F.lit(None).cast("string").alias("sha256"), "content"
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")


def known_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files an earlier run took in: the labelled ones."""
    files = inventory(spark, sf_dir)
    return files.join(labelled(spark, sf_dir).select("file_id"), "file_id", "left_semi")


def listing_after_losses(
    spark: SparkSession, sf_dir: str, shared_names: bool = False
) -> DataFrame:
    """A later listing, in which files labelled toxic are gone."""
    gone = labelled(spark, sf_dir).filter("toxic = 1").select("file_id")
    listed = listing_with_content(spark, sf_dir, shared_names)
    return listed.join(gone, "file_id", "left_anti").drop("file_id", "source", "lang", "content")


def listing_of_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing made after quarantine, in which files of good quality are back."""
    back = labelled(spark, sf_dir).filter("quality = 1").select("file_id")
    listed = listing_with_content(spark, sf_dir)
    return listed.join(back, "file_id", "left_semi").drop("file_id", "source", "lang", "content")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two work items per document in every state; one document in forty has lost its file."""
    d, k = F.col("doc_id"), F.col("k")
    nothing = F.lit(None)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        .select(
            (d * 2 + k).alias("work_id"),
            F.when(d % 40 == 3, -d).otherwise(d).alias("file_id"),
            F.when(k == 0, "hash").otherwise("analyze").alias("kind"),
            _pick(STATES, (d + 2 * k) % 6).alias("status"),
            F.lit(0).alias("priority"),
            ((F.floor(d / 6) + k) % 4).cast("int").alias("attempts"),
            F.lit(3).alias("max_attempts"),
            nothing.cast("string").alias("error"),
            nothing.cast("string").alias("worker_id"),
            nothing.cast("timestamp_ntz").alias("created_at"),
            nothing.cast("timestamp_ntz").alias("started_at"),
            nothing.cast("timestamp_ntz").alias("finished_at"),
        )
    )


def sizes_of_all_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, size) stretched so that every priority occurs."""
    return contents(spark, sf_dir).select(
        "file_id",
        (F.octet_length("content") * (1 + F.col("file_id") % 5 * 500)).alias("size"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, success, message): running work on every fifth document failed."""
    failed = F.abs("file_id") % 5 == 0
    return (
        ledger(spark, sf_dir)
        .filter("status = 'running'")
        .select(
            "work_id",
            (~failed).alias("success"),
            F.when(failed, F.lit("failed")).alias("message"),
        )
    )


def written_files(spark: SparkSession, sf_dir: str) -> str:
    """Write every file's content below the shared folder, by its id; returns the directory.

    The tasks write with plain file calls, so the shared folder has to be mounted on all executors.
    """
    shared = shared_folder(spark)
    if "://" in shared or not shared.startswith(("/", "file:")):
        scheme, _, rest = shared.partition("://")
        if scheme != "file":
            raise ValueError("files can be written to a mounted folder only")
        shared = "/" + rest.lstrip("/")
    root = f"{shared.removeprefix('file:').rstrip('/')}/files-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{root}/{number % 97}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/.{number}-{os.getpid()}", "wb") as file:
                    file.write(body or b"")
                os.replace(file.name, f"{folder}/{number}")
            yield pa.RecordBatch.from_pydict({"file_id": batch.column(0)})

    files = contents(spark, sf_dir).select("file_id", F.col("content").cast("binary"))
    files.repartition("file_id").mapInArrow(write, "file_id bigint").write.format("noop").mode("overwrite").save()
    return root
