"""A Bloom filter of ids, applied where rows are scanned, before a join moves them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each id; with three places an id passes by mistake with a probability of about 3 in 100.
BITS_PER_ID = 8
_PLACES = 3
#: So few ids are named one by one instead.
NAMED = 1000
#: A filter larger than this, 32 MB, is not made: it goes to every task.
MOST_BITS = 1 << 28


def among(rows: DataFrame, column: str, ids: DataFrame, named: int = NAMED, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows whose `column` may be one of the ids, whole numbers in the one column of `ids`.

    All rows with such an id stay, and few of the others; a join on the column tells them apart, and
    shuffles only these. Rows without a value go. Up to `named` ids are named to the scan, which skips
    row groups and pages without them. More are a filter of bits, counted together in one aggregation,
    64 to a word, and read as one value; with more ids than `most_bits` has room for, no filter is made,
    and all rows stay for the join. `ids` should be written down.
    """
    few = [r[0] for r in ids.limit(named + 1).collect()]
    if len(few) <= named:
        numbers = ", ".join(f"{int(x)}L" for x in few if x is not None)
        return rows.filter(f"`{column}` in ({numbers})" if numbers else "false")
    count = ids.count()
    words = 1 << max(4, (count * BITS_PER_ID - 1).bit_length() - 6)
    if words * 64 > most_bits:
        return rows
    spark, (name,) = rows.sparkSession, ids.columns
    bits = words * 64

    def places(of: str) -> list:
        return [F.pmod(F.xxhash64(of, F.lit(k)), F.lit(bits)) for k in range(_PLACES)]

    one_bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))
    each = ids.select(F.explode(F.array(*places(name))).alias("place"))
    each = each.select(F.shiftright("place", 6).alias("word"), one_bit.alias("bits"))
    # Every word is there, so that its place in the list is its number.
    empty = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    together = each.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    held = together.agg(listed["bits"].alias("words")).scalar()
    own = [F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in places(column)]
    return rows.filter(F.col(column).isNotNull() & own[0] & own[1] & own[2])
