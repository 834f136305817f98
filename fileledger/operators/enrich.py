"""Filling in hashes and metadata documents, and folding the results back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileledger.functions import metadata, names, text
from fileledger.operators.duplicates import files_sharing_a_size
from fileledger.operators.heavy_keys import SLICE_ROWS, join_groups
from fileledger.operators.merge import merge_results as merge_results
from fileledger.session import cut_lineage
from fileledger.sources import content


def hash_content(files: DataFrame, column: str = "content") -> DataFrame:
    """Add `sha256` of a text or binary column, without leaving the JVM."""
    return files.withColumn("sha256", F.sha2(F.col(column).cast("binary"), 256))


def hash_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file_id, sha256, error) of the files behind an inventory's paths.

    Read in chunks where the file lies, so neither the size of a file nor an empty or hidden one
    makes a difference. Files that cannot be read come out with an error.
    """
    return content.hash_mounted(files, tasks)


def hash_in_stages(
    files: DataFrame, tasks: int | None = None, block: int = content.EDGE_BYTES, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(file_id, sha256, bytes_read, error): hashes of all files that may have a copy.

    A file whose size no other has is not opened. Of the others the first and last block are read,
    and only files that are still alike in size and blocks are read whole; small ones are already.
    Files told apart have no hash and no error. So copies are those that hashing everything would find, as
    long as files have the size in the inventory; one whose size is unknown is read whole. Results of
    each stage are written down, and large groups are spread over slices. Ids are unique.
    """
    known = files.select("file_id", "path", "size")
    sized = known.filter(F.col("size").isNotNull())
    shared = cut_lineage(files_sharing_a_size(sized, slice_rows))
    edges = cut_lineage(content.edges_mounted(shared, tasks, block).join(shared.select("file_id", "path", "size"), "file_id"))
    alike = edges.filter("edges is not null and sha256 is null").withColumn("key", F.struct("size", "edges"))
    groups = alike.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    again = join_groups(alike, groups, "key", "n", "file_id", slice_rows=slice_rows).select("file_id", "path", "size")
    unknown = known.filter(F.col("size").isNull())
    whole = cut_lineage(content.whole_mounted(cut_lineage(again.unionByName(unknown)), tasks))
    late = whole.select("file_id", F.struct("sha256", "bytes_read", "error").alias("late"))
    early = edges.select("file_id", F.struct("sha256", "bytes_read", "error").alias("early"))
    opened = known.select("file_id").join(early, "file_id", "left").join(late, "file_id", "left")
    read = F.coalesce("early.bytes_read", F.lit(0)) + F.coalesce("late.bytes_read", F.lit(0))
    return opened.select(
        "file_id", F.coalesce("late.sha256", "early.sha256").alias("sha256"), read.cast("bigint").alias("bytes_read"),
        F.coalesce("late.error", "early.error").alias("error"),
    )


def metadata_gate(
    inventory: DataFrame,
    types: Sequence[str] = metadata.DEFAULT_TYPES,
    size_cap: int = metadata.DEFAULT_SIZE_CAP,
) -> DataFrame:
    """Add `extractor`, and `skip`, the document of a file that is not going to be opened."""
    reason = metadata.skip_reason(F.col("size"), F.col("ext"), types, size_cap)
    return inventory.withColumn(
        "extractor", F.when(reason.isNull(), names.extractor_for(F.lower("ext")))
    ).withColumn("skip", metadata.skip_document(reason))


def describe_content(
    files: DataFrame,
    types: Sequence[str] = metadata.DEFAULT_TYPES,
    size_cap: int = metadata.DEFAULT_SIZE_CAP,
    column: str = "content",
) -> DataFrame:
    """(file_id, metadata) where the content is a column already: text is counted in the JVM."""
    kind = files.schema[column].dataType
    body = F.col(column)
    decoded = text.decode_lossy(body) if isinstance(kind, T.BinaryType) else body
    unread = F.concat(F.lit("no extractor installed for "), F.col("extractor"))
    document = (
        F.when(F.col("skip").isNotNull(), F.col("skip"))
        .when(F.col("extractor") == "text", F.to_json(text.text_stats(decoded)))
        .otherwise(metadata.error_document(unread))
    )
    return metadata_gate(files, types, size_cap).select("file_id", document.alias("metadata"))


def extract_metadata(
    inventory: DataFrame,
    types: Sequence[str] = metadata.DEFAULT_TYPES,
    size_cap: int = metadata.DEFAULT_SIZE_CAP,
    extractors: Mapping[str, Callable[[bytes], dict]] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """(file_id, metadata, error) for every file of an inventory.

    Size and suffix decide before anything is read. Text is counted by built-in functions; other
    kinds go to the function registered for them in `extractors`, inside the reading task.
    """
    gated = metadata_gate(inventory, types, size_cap)
    skipped = gated.filter(F.col("skip").isNotNull()).select(
        "file_id", F.col("skip").alias("metadata"), F.lit(None).cast("string").alias("error")
    )
    opened = content.read_mounted(
        gated.filter(F.col("skip").isNull()), size_cap, extractors or {}, tasks
    )
    stats = F.to_json(text.text_stats(text.decode_lossy(F.col("content"))))
    document = (
        F.when(F.col("too_large"), metadata.skip_document(F.lit(metadata.TOO_LARGE)))
        .when(F.col("content").isNotNull(), stats)
        .otherwise(F.col("document"))
    )
    return skipped.unionByName(opened.select("file_id", document.alias("metadata"), "error"))


def files_left(inventory: DataFrame, results: DataFrame) -> DataFrame:
    """Files without a result yet. Results kept in a table let a broken-off job go on from there."""
    done = results.select("file_id").distinct()
    return inventory.join(done, "file_id", "left_anti").select(*inventory.columns)


def outcomes_of(ledger: DataFrame, kind: str, results: DataFrame) -> DataFrame:
    """(work_id, success, message) of running work items, from a job's (file_id, error)."""
    running = ledger.filter((F.col("kind") == kind) & (F.col("status") == "running"))
    running = running.select("work_id", "file_id")
    return running.join(results.select("file_id", "error"), "file_id").select(
        "work_id", F.col("error").isNull().alias("success"), F.col("error").alias("message")
    )
