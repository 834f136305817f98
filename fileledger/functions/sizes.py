"""Sizes: text forms, megabytes and work priority."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units as powers of 1024.
UNIT_BYTES = {
    "B": 1,
    "KB": 1024,
    "MB": 1048576,
    "GB": 1073741824,
    "TB": 1099511627776,
}

# Fixed values: (below this many bytes, priority); larger files get the last one.
PRIORITY_TIERS = ((1024, 100), (1048576, 50), (10485760, 10))
LARGEST_PRIORITY = 1

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[Ee][+-]?\d+)?"
_SIZED = rf"^({_NUMBER})\s*([KkMmGgTt]?[Bb])$"
_PLAIN = r"^[+-]?\d+$"


def parse_size(text: str) -> int:
    """Bytes in `'1.5KB'`, `'100mb'` or `'77'`; fractions of a byte are cut off."""
    text = text.strip()
    if re.match(_PLAIN, text):
        return int(text)
    found = re.match(_SIZED, text)
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * UNIT_BYTES[found[2].upper()])


def size_in_bytes(text: Column) -> Column:
    """Column form of `parse_size`; null where the text is no size."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = F.regexp_extract(trimmed, _SIZED, 1)
    unit = F.upper(F.regexp_extract(trimmed, _SIZED, 2))
    factor = F.lit(None).cast("double")
    for name, size in UNIT_BYTES.items():
        factor = F.when(unit == name, F.lit(float(size))).otherwise(factor)
    sized = (number.try_cast("double") * factor).try_cast("bigint")
    return F.when(trimmed.rlike(_PLAIN), trimmed.try_cast("bigint")).otherwise(sized)


def megabytes(size: Column) -> Column:
    """Size in MB with two decimals, halves rounded to even."""
    return F.bround(size / F.lit(1048576), 2)


def size_priority(size: Column) -> Column:
    """Priority of work on a file of this size: the smaller the file, the sooner."""
    tier = F.lit(LARGEST_PRIORITY)
    for limit, priority in reversed(PRIORITY_TIERS):
        tier = F.when(size < limit, F.lit(priority)).otherwise(tier)
    return tier
