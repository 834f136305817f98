"""Times: all columns are zone-free (`timestamp_ntz`), so results do not follow the session zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: datetime) -> Column:
    """A naive Python datetime as a zone-free literal."""
    if moment.tzinfo is not None:
        raise ValueError("give a naive datetime: inventory times carry no zone")
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def from_epoch(seconds: Column, zone: str = "UTC") -> Column:
    """Epoch seconds (double) as wall-clock time in `zone`, rounded half-even to microseconds."""
    whole = F.floor(seconds)
    micros = whole * 1000000 + F.rint((seconds - whole) * 1000000).cast("bigint")
    utc = ntz(datetime(1970, 1, 1)) + F.expr("INTERVAL '0.000001' SECOND") * micros
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def epoch_micros(moment: Column) -> Column:
    """Microseconds since 1970 on the zone-free clock."""
    seconds = (moment - ntz(datetime(1970, 1, 1))).cast("interval second").cast("decimal(20,6)")
    return (seconds * 1000000).cast("bigint")


def whole_days(start: Column, end: Column) -> Column:
    """Whole days elapsed from `start` to `end`, rounded down also when negative."""
    elapsed = end - start
    days = F.extract(F.lit("DAY"), elapsed).cast("int")
    return days - F.when(F.make_dt_interval(days) > elapsed, 1).otherwise(0)


def iso_text(moment: Column) -> Column:
    """`2024-01-31T08:00:00`, with six fraction digits only where there is a fraction."""
    text = moment.cast("string")
    seconds = F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T"))
    fraction = F.substring(text, 21, 6)
    return F.when(
        F.length(fraction) > 0, F.concat(seconds, F.lit("."), F.rpad(fraction, 6, "0"))
    ).otherwise(seconds)
