"""File names: base name, suffix, MIME type and extractor."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which extractor reads which suffix.
EXTRACTOR_SUFFIXES = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "xlsx": (".xlsx",),
    "pptx": (".pptx",),
    "text": (".txt", ".csv", ".json"),
    "image": (".jpg", ".jpeg", ".png", ".tiff", ".bmp"),
    "audio": (".mp3", ".flac", ".wav", ".ogg"),
    "video": (".mp4", ".avi", ".mkv", ".mov"),
}

# Fixed value: the MIME type of a name nothing is known about.
UNKNOWN_MIME = "application/octet-stream"


def base_name(path: Column) -> Column:
    """Last path component; both `/` and `\\` separate components."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def suffix(name: Column) -> Column:
    """Last suffix, lowercase with its dot, or `''`; a leading or trailing dot starts none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def extractor_for(ext: Column) -> Column:
    """Name of the extractor for a lowercase suffix, null where there is none."""
    chosen = F.lit(None).cast("string")
    for extractor, suffixes in EXTRACTOR_SUFFIXES.items():
        chosen = F.when(ext.isin(*suffixes), F.lit(extractor)).otherwise(chosen)
    return chosen


def _mime_tables() -> mimetypes.MimeTypes:
    # A fresh instance holds only Python's built-in tables, never the host's mime.types files.
    return mimetypes.MimeTypes()


def mime_pairs() -> dict[str, str]:
    """Suffix to MIME type, the same on every host with this Python version."""
    return dict(_mime_tables().types_map[True])


# Leading dots belong to the stem, and one other character has to precede the suffix.
_MIME_SUFFIX = r"(?s)^\.*[^.].*?(\.[^.]*)$"


def _with_mime_suffix(files: DataFrame, name: Column) -> DataFrame:
    """Add `_mime_ext`, the suffix that decides: the one under a compression suffix, if any."""
    tables = _mime_tables()
    own = F.col("_own")
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(own))
    under = F.when(
        own.isin(*tables.encodings_map), F.regexp_extract(stem, _MIME_SUFFIX, 1)
    ).otherwise(own)
    # `.tgz` and the like stand for two suffixes, of which the first one decides.
    packed = F.create_map(
        *[F.lit(part) for p, s in tables.suffix_map.items() for part in (p, "." + s.split(".")[1])]
    )
    return files.withColumn("_own", F.regexp_extract(name, _MIME_SUFFIX, 1)).withColumn(
        "_mime_ext", F.lower(F.coalesce(F.try_element_at(packed, F.lower(own)), under))
    )


def mime_table(spark: SparkSession) -> DataFrame:
    """The suffix table as a literal relation (under 200 rows whatever the data)."""
    rows = ", ".join(f"('{ext}', '{mime}')" for ext, mime in sorted(mime_pairs().items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(_mime_ext, _mime)")


def with_mime(files: DataFrame, name: str = "name") -> DataFrame:
    """Add `mime`; a hash lookup in the fixed table, so the files are not shuffled."""
    lookup = F.broadcast(mime_table(files.sparkSession))
    return (
        _with_mime_suffix(files, F.col(name))
        .join(lookup, "_mime_ext", "left")
        .withColumn("mime", F.coalesce("_mime", F.lit(UNKNOWN_MIME)))
        .drop("_own", "_mime_ext", "_mime")
    )
