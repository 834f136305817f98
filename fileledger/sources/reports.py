"""Reports on disk: writing them, reading them back, and the file rows they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fileledger.functions.times import iso_text
from fileledger.sources.json_arrays import read_arrays

# A report read back: flat reports fill the upper columns, duplicate reports the lower ones. The
# Portuguese names are fixed values: the keys of array reports written by the earlier tool.
_ITEM = "file_id bigint, path string, size bigint, id bigint, caminho string, tamanho bigint"
REPORT = f"{_ITEM}, keeper_id bigint, files array<struct<{_ITEM}>>"


def _iso_times(value: Column, kind: T.DataType) -> Column:
    """The same value with every timestamp, at any depth, as ISO text."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return iso_text(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _iso_times(item, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.struct(*[_iso_times(value[f.name], f.dataType).alias(f.name) for f in kind])
    return value


def write_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a report as JSON lines or CSV with a header; lists become JSON text in CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"a report is written as json or csv, not as {fmt}")
    texts = report.select(
        *[_iso_times(F.col(f.name), f.dataType).alias(f.name) for f in report.schema]
    )
    writer = texts.write.mode("overwrite")
    if fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
        return path
    flat = texts.select(
        *[
            (F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name))
            if isinstance(f.dataType, (T.ArrayType, T.StructType))
            else F.col(f.name)
            for f in texts.schema
        ]
    )
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def read_report(spark: SparkSession, path: str, single_array: bool = False) -> DataFrame:
    """A report as written by `write_report`, or one JSON array per file with `single_array`.

    An array is read by many tasks, in ranges of bytes.
    """
    if single_array:
        return read_arrays(spark, path, REPORT)
    return spark.read.schema(REPORT).option("mode", "PERMISSIVE").json(path)


def report_items(report: DataFrame) -> DataFrame:
    """The files a report wants gone: (file_id, path, size), one row each.

    Flat reports name files at top level. Duplicate reports nest them; there the copy to keep is
    left out. Rows naming nothing are dropped.
    """
    columns = set(report.columns)

    def first_of(*names: str) -> Column:
        known = [F.col(n) for n in names if n in columns]
        return F.coalesce(*known) if known else F.lit(None)

    flat = report.select(
        first_of("file_id", "id").cast("bigint").alias("file_id"),
        first_of("path", "caminho").cast("string").alias("path"),
        first_of("size", "tamanho").cast("bigint").alias("size"),
    )
    if "files" in columns:
        fields = set(report.schema["files"].dataType.elementType.names)

        def item_field(*names: str) -> Column:
            known = [F.col("item")[n] for n in names if n in fields]
            return F.coalesce(*known) if known else F.lit(None)

        # Members are listed oldest first, so without a named keeper the first one is it.
        keeper = first_of("keeper_id").cast("bigint")
        nested = (
            report.select(keeper.alias("keeper_id"), F.posexplode("files").alias("place", "item"))
            .select(
                "keeper_id",
                "place",
                item_field("file_id", "id").cast("bigint").alias("file_id"),
                item_field("path", "caminho").cast("string").alias("path"),
                item_field("size", "tamanho").cast("bigint").alias("size"),
            )
            .filter(
                F.when(F.col("keeper_id").isNotNull(), F.col("keeper_id") != F.col("file_id"))
                .otherwise(F.col("place") > 0)
            )
            .select("file_id", "path", "size")
        )
        flat = flat.unionByName(nested)
    return flat.filter(F.col("file_id").isNotNull() | F.col("path").isNotNull())
