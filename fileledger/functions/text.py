"""Statistics of text content."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _drop_bad_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda raw: raw.decode("utf-8", "ignore"), na_action="ignore")


def decode_lossy(content: Column) -> Column:
    """UTF-8 text with undecodable bytes left out.

    Only rows that do hold bad bytes carry content to Python; for the rest a null goes over.
    """
    valid = F.is_valid_utf8(content.cast("string"))
    repaired = _drop_bad_bytes(F.when(~valid, content))
    return F.when(valid, content.cast("string")).otherwise(repaired)


def _occurrences(text: Column, piece: str) -> Column:
    gone = F.replace(text, F.lit(piece), F.lit(""))
    return ((F.octet_length(text) - F.octet_length(gone)) / F.lit(len(piece))).cast("bigint")


def _if_returns(text: Column, number: Column) -> Column:
    """The number, worked out only where the text has a carriage return at all."""
    return F.when(text.contains("\r"), number).when(text.isNotNull(), F.lit(0).cast("bigint"))


def line_count(text: Column) -> Column:
    """Lines after `\\r\\n` and `\\r` count as `\\n`; text ending in a newline has one more."""
    pieces = F.size(F.split(text, "\n", -1)).cast("bigint")
    # The pieces are cut at every \n already, also at that of a \r\n.
    returns = _occurrences(text, "\r") - _occurrences(text, "\r\n")
    return pieces + _if_returns(text, returns)


def char_count(text: Column) -> Column:
    """Code points after newline translation."""
    return F.length(text).cast("bigint") - _if_returns(text, _occurrences(text, "\r\n"))


def is_blank(text: Column) -> Column:
    """No character besides white space, in the wide sense (no-break spaces, separators)."""
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def text_stats(text: Column) -> Column:
    """Struct with the keys of a text file's metadata document."""
    # Key names of the document.
    return F.struct(
        line_count(text).alias("linhas"),
        char_count(text).alias("caracteres"),
        is_blank(text).alias("vazio"),
    )
