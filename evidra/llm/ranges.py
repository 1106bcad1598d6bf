"""Ranges of even size over an ordered key of integers, so that an order over all rows needs no single task.

The key is one or several bigint columns, compared one after the other. Bounds are keys that occur;
they are drawn by a hash of the key, so the draw is the same whenever it is made, and every few of
them in order are kept. A row's range is found by a binary search in literal arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys drawn for each bound; the more, the more even are the ranges.
DRAWN_PER_BOUND = 16
#: Bounds that the driver holds at most, whatever the input.
MOST_BOUNDS = 16_384


def bounds(keys: DataFrame, rows: int, rows_per_range: int) -> list[tuple]:
    """Ascending keys, at most about MOST_BOUNDS; ranges between them hold about rows_per_range rows. rows: their count.

    No rows and few rows give no bounds: one range. Equal keys are in one range.
    """
    want = min(MOST_BOUNDS, rows // max(1, rows_per_range))
    if want < 1:
        return []
    every = max(1, rows // (want * DRAWN_PER_BOUND))
    drawn = keys.where(F.pmod(F.xxhash64(*keys.columns, F.lit("bound")), F.lit(every)) == 0).distinct()
    found = sorted(tuple(r) for r in drawn.collect())
    step = max(1, round(len(found) / want))
    return found[step // 2 :: step]


def literal_array(values: list[int]) -> Column:
    """An array<bigint> in the plan; the optimizer folds the parsing away."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def range_of(key: list[Column], found: list[tuple]) -> Column:
    """How many of the ascending bounds aren't above the key: int, 0 to their number."""
    if not found:
        return F.lit(0)
    arrays = [literal_array([b[k] for b in found]) for k in range(len(key))]

    def reaches(at: Column) -> Column:
        """The key isn't below bound number at."""
        out = F.lit(True)
        for own, bound in reversed(list(zip(key, arrays))):
            b = F.get(bound, at)
            out = (own > b) | ((own == b) & out)
        return out

    def halve(state: Column, _: Column) -> Column:
        middle = ((state.low + state.high) / 2).cast("int")
        up = (state.low < state.high) & reaches(middle)
        return F.struct(
            F.when(up, middle + 1).otherwise(state.low).alias("low"),
            F.when(up | (state.low >= state.high), state.high).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(found)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(found).bit_length())), start, halve).low
