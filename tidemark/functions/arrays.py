"""Arrays as relations: naming a value once, and islands in ascending numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once: inside a lambda it has a name, outside it would be repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """The sums of an array of numbers up to each of its places: a round adds up what lies one, two and three
    steps back, and its step is four times the last; so many rounds as the array is long, n log n in all."""

    def round_of(step: int) -> Callable[[Column], Column]:
        back = [j * step for j in (1, 2, 3) if j * step < 2**31]
        before = lambda a, i: sum((F.coalesce(F.get(a, i - b), F.lit(0)) for b in back), F.lit(0))
        return lambda a: F.when(F.size(a) > step, F.transform(a, lambda x, i: x + before(a, i))).otherwise(a)

    for k in range(16):  # an array has under 4 ** 16 places
        values = let(values, round_of(4**k))
    return values


def islands(hits: Column, apart: int) -> Column:
    """Array of (first, last, items): runs of ascending numbers of which neighbours are at most `apart` apart."""

    def runs(p: Column) -> Column:
        h = p["h"]
        opens = F.filter(F.sequence(F.lit(1), F.size(h)), lambda k: (k == 1) | (F.get(h, k - 1) - F.get(h, k - 2) > apart))
        return let(F.struct(h.alias("h"), opens.alias("o")), ends)

    def ends(p: Column) -> Column:
        def run(k: Column, j: Column) -> Column:
            after = F.coalesce(F.get(p["o"], j + 1), F.size(p["h"]) + 1)
            return F.struct(F.get(p["h"], k - 1).alias("first"), F.get(p["h"], after - 2).alias("last"), (after - k).alias("items"))

        return F.transform(p["o"], run)

    none = F.array().cast("array<struct<first: int, last: int, items: int>>")
    return let(F.struct(hits.alias("h")), lambda p: F.when(F.size(p["h"]) > 0, runs(p)).otherwise(none))
