"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (v, u): joins each v's neighbours u to the least of v and its neighbours."""
    least = pairs.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
    out = pairs.join(least, "v")
    if larger_only:
        out = out.where("u > v").select(F.col("u").alias("hi"), F.col("m").alias("lo"))
    else:
        out = out.select(F.explode(F.array("u", "v")).alias("hi"), F.col("m").alias("lo"))
    return out.where("hi <> lo").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, component: the least node id of its component, for every node that has an edge.

    Each round is written to the shared folder, which cuts lineage and outlives lost executors.
    Rows that name a node with itself are no edges; an edge table without others gives no rows.
    Rounds needed grow with the logarithm of the components' size.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges"
    )
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("v"), F.col("lo").alias("u"))
        large = _stars(both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u"))), True)
        now = written(_stars(large.select(F.col("hi").alias("v"), F.col("lo").alias("u")), False), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return stars.unionByName(roots)
