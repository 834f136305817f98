"""File attributes and owner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute bits, in the order the names are listed.
ATTRIBUTE_BITS = {"readonly": 1, "hidden": 2, "system": 4, "archive": 32}
NO_ATTRIBUTES = "normal"
NO_OWNER = "unknown"


def attribute_names(bits: Column) -> Column:
    """Comma list of the attributes set in `bits`; `normal` if none or not known."""
    named = F.concat_ws(
        ",", *[F.when(bits.bitwiseAND(bit) != 0, name) for name, bit in ATTRIBUTE_BITS.items()]
    )
    return F.when(named == "", F.lit(NO_ATTRIBUTES)).otherwise(named)


def owner_or_unknown(owner: Column) -> Column:
    return F.coalesce(owner, F.lit(NO_OWNER))
