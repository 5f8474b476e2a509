"""The domain's tables, made from the tables at hand (see README for the mapping)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEXICON = (
    ("fin", "OF", "negative"), ("fin", "AND", "negative"), ("fin", "THE", "positive"), ("fin", "TO", "positive"), ("fin", "WAS", "positive"),
    ("fin", "THAT", "uncertainty"), ("fin", "IN", "litigious"), ("gen", "OF", "negative"), ("gen", "ON", "negative"), ("gen", "AT", "negative"), ("gen", "THE", "positive"),
    ("gen", "WAS", "negative"),
)
NEGATORS = ("IS", "BE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession, name: str | None = None) -> DataFrame:
    """A fixed dictionary of a few terms, so that a broadcast of it is bounded."""
    rows = [r for r in LEXICON if name in (None, r[0])]
    return F.broadcast(spark.createDataFrame(rows, "lexicon string, term string, category string"))


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (d % 5).cast("int").alias("ticker"), (2015 + d % 8).cast("int").alias("year"),
        F.date_add(F.lit("1996-01-01").cast("date"), (d * 7 % 1800).cast("int")).alias("event_date"), (d % 3 == 0).alias("after_close"),
    )


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosures(spark, sf_dir).where("lang = 'en'")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    x = x.join(s.select("s_suppkey", "n_regionkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    price, qty = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), F.sum(F.col("l_quantity").cast("decimal(18,2)"))
    return x.groupBy(F.col("n_regionkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(
        (price.cast("double") / qty.cast("double")).alias("close"), qty.cast("double").alias("volume")
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")).alias("close"),
        F.lit(1.0).alias("volume"),
    )
    return x.withColumn("ticker", F.lit(-1))
