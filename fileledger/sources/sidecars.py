"""Side files written next to quarantined files: `<file>.quarantine.json`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.sources.content import spread_by_path

# Fixed value: what a side file's name ends with.
SIDECAR_SUFFIX = ".quarantine.json"

_DOCUMENT = "original_path string, quarantine_date timestamp_ntz, file_id bigint, _broken string"


def _read_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for path in batch["path"]:
            try:
                with open(path, encoding="utf-8") as stream:
                    texts.append(stream.read())
                errors.append(None)
            except (OSError, UnicodeDecodeError) as problem:
                texts.append(None)
                errors.append(str(problem))
        yield pd.DataFrame({"path": batch["path"], "text": texts, "error": errors})


def read_sidecars(listing: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest rows from the side files in a listing, and (path, error) of the unusable ones.

    Starts from a listing rather than `spark.read.json`, which would not see the side file of a
    hidden file.
    """
    side_files = listing.filter(F.col("is_file") & F.col("path").endswith(SIDECAR_SUFFIX))
    read = spread_by_path(side_files.select("path"), tasks).mapInPandas(
        _read_small, "path string, text string, error string"
    )
    parsed = read.withColumn(
        "document",
        F.from_json(
            "text", _DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
        ),
    )
    usable = (
        F.col("error").isNull()
        & F.col("document._broken").isNull()
        & F.col("document.original_path").isNotNull()
    )
    target = F.substring("path", F.lit(1), F.length("path") - len(SIDECAR_SUFFIX))
    manifest = parsed.filter(usable).select(
        F.col("document.original_path").alias("original_path"),
        target.alias("quarantine_path"),
        F.col("document.quarantine_date").alias("quarantine_date"),
        F.col("document.file_id").alias("file_id"),
    )
    broken = parsed.filter(~F.coalesce(usable, F.lit(False))).select(
        "path", F.coalesce("error", F.lit("not a quarantine record")).alias("error")
    )
    return manifest, broken
