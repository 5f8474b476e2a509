"""Quantiles, winsorising, scores, ranks and tertiles over whole tables, without one task for all rows.

Ranks come from range blocks: rows are cut by approximate quantiles of (value, hash), so that a value
that fills half the table falls into many blocks; only counts per block meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored


def _block(value: Column, cuts: Sequence[float]) -> Column:
    return F.size(F.filter(F.lit(list(cuts)), lambda x: x < value)) if cuts else F.lit(0)


def counts(df: DataFrame, columns: Sequence[str], blocks: int = 64) -> tuple[DataFrame, dict[tuple[str, int], tuple[int, int]]]:
    """name, value, n, block of the distinct values of each column but nulls and NaN, written; and, by
    (name, block), the rows in lower blocks and in this one. Values of a block are neighbours; only
    counts by block reach the driver."""
    named = F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    c = df.select(named).where("value IS NOT NULL AND NOT isnan(value)").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    c = stored(c, "value-counts")
    cuts = {r["name"]: sorted(set(r["p"])) for r in c.groupBy("name").agg(F.percentile_approx("value", [i / blocks for i in range(1, blocks)], 1000).alias("p")).collect()}
    block = F.lit(0)
    for name, limits in cuts.items():
        block = F.when(F.col("name") == name, _block(F.col("value"), limits)).otherwise(block)
    c = c.withColumn("block", block)
    below: dict[tuple[str, int], tuple[int, int]] = {}
    total: dict[str, int] = {}
    for r in sorted(c.groupBy("name", "block").agg(F.sum("n").alias("n")).collect(), key=lambda r: (r["name"], r["block"])):
        below[r["name"], r["block"]] = total.get(r["name"], 0), r["n"]
        total[r["name"]] = total.get(r["name"], 0) + r["n"]
    return c, below


def quantiles_of(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns, linear between neighbours; nulls for one without values.

    Blocks of values that hold a wanted place are summed up inside; no task sees a whole column."""
    c, below = counts(df, columns)
    size = {name: max(a + n for (m, _), (a, n) in below.items() if m == name) for name, _ in below}
    places = {name: [s * (n - 1) for s in shares] for name, n in size.items()}
    asked = {name: sorted({q for p in ps for q in (int(p), min(int(p) + 1, size[name] - 1))}) for name, ps in places.items()}
    inner = [(name, block, q - a) for (name, block), (a, n) in below.items() for q in asked[name] if a <= q < a + n]
    if not inner:
        return {name: [None] * len(shares) for name in columns}
    wanted = F.broadcast(df.sparkSession.createDataFrame(inner, "name string, block int, place long"))  # two per share and column at most
    here = c.join(wanted.select("name", "block").distinct(), ["name", "block"])
    last = F.sum("n").over(Window.partitionBy("name", "block").orderBy("value"))
    held = here.withColumn("last", last).join(wanted, ["name", "block"]).where("place < last AND place >= last - n")
    at = {(r["name"], r["block"], r["place"]): r["value"] for r in held.select("name", "block", "place", "value").collect()}
    value = {(name, below[name, block][0] + place): v for (name, block, place), v in at.items()}
    out: dict[str, list[float | None]] = {name: [None] * len(shares) for name in columns}
    for name, ps in places.items():
        ends = [(value[name, int(p)], value[name, min(int(p) + 1, size[name] - 1)], p - int(p)) for p in ps]
        out[name] = [low + (high - low) * f for low, high, f in ends]
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    return quantiles_of(df, [column], shares)[column]


def described(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """measure, n, mean, std, min, q25, q50, q75, max of each column; a row per column."""
    q = quantiles_of(df, columns, [0.25, 0.5, 0.75])
    one = df.agg(*[f(c).alias(f"{k}__{c}") for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    middle = lambda c: [F.lit(v).cast("double").alias(k) for k, v in zip(("q25", "q50", "q75"), q[c], strict=True)]
    rows = [F.struct(F.lit(c).alias("measure"), *[F.col(f"{k}__{c}").alias(k) for k in ("n", "mean", "std", "min")], *middle(c), F.col(f"max__{c}").alias("max")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def bounds(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    return df.sparkSession.createDataFrame([tuple(quantiles(df, column, [low, high]))], "low double, high double")


def winsorize(df: DataFrame, *columns: str, low: float = 0.01, high: float = 0.99, fill: bool = False) -> DataFrame:
    """df with each of `columns` clipped to its linear quantiles; nulls stay, or take the lower one with `fill`."""
    limits = quantiles_of(df, columns, [low, high])
    clipped = {c: F.when(F.col(c).isNotNull() | F.lit(fill), F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b))) for c, (a, b) in limits.items() if a is not None}
    return df.withColumns(clipped) if clipped else df


def zscore(df: DataFrame, column: str, out: str) -> DataFrame:
    m = df.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).alias("__m"))
    z = F.when(F.col("__m.s") > 0, (F.col(column) - F.col("__m.m")) / F.col("__m.s"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, z).drop("__m")  # one row


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """df with `rank`: from 1, equal values share the mean of theirs. Rows without a value go."""
    c, below = counts(df, [column])
    starts = df.sparkSession.createDataFrame([(b, a) for (_, b), (a, _) in below.items()], "block int, start long")
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("value")) - F.col("n")
    mean = F.col("start") + F.col("inner") + (F.col("n") + 1) / 2
    ranks = c.withColumn("inner", inner).join(F.broadcast(starts), "block").select(F.col("value").alias("__v"), mean.alias("rank"), "n")  # a row per block
    return _met(df, F.col(column).cast("double"), stored(ranks, "ranks"), c)


def _met(df: DataFrame, value: Column, ranks: DataFrame, counted: DataFrame, share: int = 512) -> DataFrame:
    """df with the rank of its value: values that more than one in `share` rows have, at most `share` many, are
    broadcast with their ranks; the rows of all others are dealt by value."""
    name = "__v"
    total = counted.agg(F.sum("n")).first()[0] or 0
    crowded = F.col("n") > F.lit(total // share)
    hot = F.broadcast(ranks.where(crowded).drop("n"))
    rest = ranks.where(~crowded).drop("n")
    return df.join(hot, value == F.col(name)).unionByName(df.join(hot, value == F.col(name), "left_anti").join(rest, value == F.col(name))).drop(name)


def signed_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, up, ties, most of each column: over its values that are not 0, ranked by size with ties at
    their mean rank, the sum of the ranks of positive ones, the sum of t**3 - t over groups of t equal
    sizes, and the largest group."""
    sizes = df.select(*[F.when(F.col(c) != 0, F.abs(c)).alias(c) for c in columns])
    c, below = counts(sizes, columns)
    starts = df.sparkSession.createDataFrame([(n, b, a) for (n, b), (a, _) in below.items()], "name string, block int, start long")
    inner = F.sum("n").over(Window.partitionBy("name", "block").orderBy("value")) - F.col("n")
    mean = F.col("start") + F.col("inner") + (F.col("n") + 1) / 2
    ranks = c.withColumn("inner", inner).join(F.broadcast(starts), ["name", "block"]).select("name", "value", "n", mean.alias("rank"))  # 64 rows a column
    named = F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).cast("double").alias("value")) for x in columns]))
    up = df.select(named).where("value > 0").groupBy("name", "value").agg(F.count(F.lit(1)).alias("k"))
    t = F.col("n").cast("double")
    met = ranks.join(up, ["name", "value"], "left")
    return met.groupBy("name").agg(F.sum(F.coalesce("k", F.lit(0)) * F.col("rank")).alias("up"), F.sum(t * t * t - t).alias("ties"), F.max("n").alias("most"))


def ranked(df: DataFrame, by: list, block_column: str, blocks: int = 64) -> DataFrame:
    """df with `rank` (1..n by `by`) and `n`: ranks within range blocks, moved by the blocks' counts.

    Block limits are approximate quantiles of `block_column`, and rows of one value are cut again by
    the next column of `by` where that is a number; so a frequent value is many blocks.
    """
    cuts = df.agg(F.percentile_approx(block_column, [i / blocks for i in range(1, blocks)], 10_000).alias("p")).first()["p"] or []
    x = df.withColumn("__block", _block(F.col(block_column), sorted(set(cuts))))
    second = next((c for c in by if c != block_column and isinstance(c, str) and dict(df.dtypes)[c] in ("bigint", "int", "double")), None)
    inside = F.lit(0)
    # A limit that comes up twice is a value with more rows than a block should have.
    crowded = sorted({c for c in cuts if cuts.count(c) > 1})
    if second and crowded:
        tight = df.where(F.col(block_column).isin(crowded)).agg(F.percentile_approx(second, [i / blocks for i in range(1, blocks)], 10_000).alias("p")).first()["p"] or []
        # All rows of such a value, and no others, must be in its block for the second cut to be in order.
        x = df.withColumn("__block", 2 * _block(F.col(block_column), sorted(set(cuts))) + F.coalesce(F.col(block_column).isin(crowded), F.lit(False)).cast("int"))
        inside = F.when(F.col(block_column).isin(crowded), _block(F.col(second), sorted(set(tight)))).otherwise(0)
    x = x.withColumn("__inside", inside)
    order = Window.orderBy("__block", "__inside")
    starts = x.groupBy("__block", "__inside").agg(F.count(F.lit(1)).alias("__c"))
    starts = starts.select("__block", "__inside", (F.sum("__c").over(order) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy(F.lit(0))).alias("n"))
    inner = F.row_number().over(Window.partitionBy("__block", "__inside").orderBy(*by))
    x = x.withColumn("__r", inner).join(F.broadcast(starts), ["__block", "__inside"])
    return x.withColumn("rank", F.col("__r") + F.col("__before")).drop("__block", "__inside", "__r", "__before")


def tertile(rank, n):
    """Cut of ranks at the linear quantiles of 1..n: 500 rows give 167, 166, 167."""
    return F.when(rank <= 1 + (n - 1) / 3, 1).when(rank <= 1 + 2 * (n - 1) / 3, 2).otherwise(3)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of (key, seed): the same rows wherever and whenever it runs."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    return df.orderBy(order, key).limit(n)


def first_known(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """by and, of each column, its first value in `order` that is not null; ties take the least value."""
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in columns]
    return df.groupBy(*by).agg(*firsts)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """The columns whose names match, in order."""
    return [c for c in df.columns if re.search(pattern, c)]
