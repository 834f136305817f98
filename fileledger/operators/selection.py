"""The first rows of each group, found by counting instead of sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileledger.operators.heavy_keys import join_groups
from fileledger.session import cut_lineage

#: So many of a group's values are looked at one by one.
WINDOW_ROWS = 1 << 16
#: In a round a group's values are counted in 2^12 ranges at most.
_ROUND_BITS = 12


def last_of_first(
    values: DataFrame, key: str, wanted: Column | DataFrame, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """(key, rows, last, before): the largest of the `wanted` smallest values of each group.

    `values` has `key` and a whole number `value`, neither null; `wanted` is a number for all groups, or
    a table (key, wanted). Of a group with fewer rows it is the largest value. `before` is how many
    values are smaller than `last`. Each round counts the values of a group by their leading bits,
    before the shuffle, and goes on with the range in which the wanted place lies, until it holds
    `window_rows` rows or one value; of a hot group a round sends 2^12 rows a task at most, and six
    rounds are enough for any values. Only the groups' rows and ranges are written down in between.
    """
    wide = values.groupBy(key).agg(
        F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    asked = wide.join(wanted, key) if isinstance(wanted, DataFrame) else wide.withColumn("wanted", wanted)
    # `inside` counts the rows between low and high, `before` those below low.
    ranges = cut_lineage(
        asked.select(
            key, "rows", F.least("rows", "wanted").alias("wanted"), "low", "high",
            F.col("rows").alias("inside"), F.lit(0).cast("bigint").alias("before"),
        )
    )
    is_open = (F.col("inside") > window_rows) & (F.col("low") < F.col("high"))
    while not (open_ranges := ranges.filter(is_open)).isEmpty():
        # What low and high differ in tells how many bits their values have in common.
        differing = F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))
        shift = F.greatest(differing - _ROUND_BITS, F.lit(0)).alias("shift")
        met = _inside(values, open_ranges.select(key, "rows", "low", "high", shift), key)
        counted = met.groupBy(key, F.expr("shiftright(value, shift)").alias("part")).agg(
            F.count("*").alias("inside"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        so_far = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("below", F.coalesce(F.sum("inside").over(so_far), F.lit(0)))
        narrower = (
            placed.join(open_ranges.select(key, "rows", "wanted", F.col("before").alias("outside")), key)
            .withColumn("before", F.col("outside") + F.col("below"))
            .filter("before < wanted and before + inside >= wanted")
        )
        ranges = cut_lineage(ranges.filter(~is_open).unionByName(narrower.select(*ranges.columns)))
    several = F.col("low") < F.col("high")
    met = _inside(values, ranges.filter(several).select(key, "rows", "low", "high"), key)
    listed = met.groupBy(key).agg(F.sort_array(F.collect_list("value")).alias("held"))
    found = ranges.filter(several).join(listed, key).withColumn(
        "last", F.get("held", (F.col("wanted") - F.col("before") - 1).cast("int"))
    )
    smaller = F.col("before") + F.array_position("held", F.col("last")) - 1
    alone = ranges.filter(~several).select(key, "rows", F.col("low").alias("last"), "before")
    return alone.unionByName(found.select(key, "rows", "last", smaller.alias("before")))


def _inside(values: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    met = join_groups(values, ranges, key, "rows", "value")
    return met.filter("value between low and high")
