"""Columns computed from texts, task by task, without moving rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from fileledger.llm import flat


def add_columns(
    documents: DataFrame,
    fields: Sequence[StructField],
    compute: Callable[[pa.RecordBatch], Sequence[pa.Array]],
    text: str = "text",
    keep: Sequence[str] | None = None,
    most: int = flat.GROUP_BYTES,
    uses: Sequence[str] = (),
) -> DataFrame:
    """The rows with the columns `fields`, which `compute` gives for a batch with a few MB of text.

    `keep` names the columns kept, all by default; columns called like new ones are replaced.
    `uses` names columns that `compute` looks at besides the text.
    """
    names = [field.name for field in fields]
    kept = [c for c in (documents.columns if keep is None else keep) if c not in names]
    needed = list(dict.fromkeys([*kept, text, *uses]))
    schema = StructType([*documents.select(*kept).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in flat.row_groups(whole, text, most):
                new = compute(batch)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), *new], names=[*kept, *names]
                )

    return documents.select(*needed).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
