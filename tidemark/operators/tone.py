"""Dictionary tone: hits, category counts, indices, tf-idf. Lexicons are small tables of terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import negated, net, tokens_en


def hits(docs: DataFrame, lexicon: DataFrame, negators: Sequence[str] = ()) -> DataFrame:
    """doc_id, lexicon, category, term, tf. A positive term after a negator does not count.

    The token array is built once per text; the lexicon is a fixed dictionary, joined by hash.
    """
    t = docs.select("doc_id", tokens_en(F.col("text")).alias("tokens"))
    t = t.select("doc_id", "tokens", F.posexplode("tokens").alias("i", "term"))
    off = negated(F.col("tokens"), F.col("i"), negators) if negators else F.lit(False)
    # Dictionary words first: a small lexicon is broadcast, and only hits are grouped and shuffled.
    met = t.select("doc_id", "term", off.alias("off")).join(lexicon, "term").where((F.col("category") != "positive") | ~F.col("off"))
    return met.groupBy("doc_id", "lexicon", "category", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words: all tokens, or those that the word list `master` (term) holds."""
    t = docs.select("doc_id", tokens_en(F.col("text")).alias("tokens"))
    if master is None:
        return t.select("doc_id", F.greatest(F.size("tokens"), F.lit(0)).cast("long").alias("n_words"))
    words = t.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    met = words.join(master.select("term").distinct(), "term").groupBy("doc_id").agg(F.sum("n").alias("n"))
    return t.select("doc_id").join(met, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_words"))


CATEGORIES = ("negative", "positive", "uncertainty", "litigious")


def _counted(docs: DataFrame, lexicon: DataFrame, negators: Sequence[str]) -> DataFrame:
    """doc_id, n_words and a count per category in one pass over the texts: each word keeps its text's size,
    meets the small lexicon where it stands, and is summed up before the shuffle."""
    t = docs.select("doc_id", tokens_en(F.col("text")).alias("tokens"))
    t = t.select("doc_id", "tokens", F.greatest(F.size("tokens"), F.lit(0)).cast("long").alias("n_words"), F.posexplode_outer("tokens").alias("i", "term"))
    off = F.coalesce(negated(F.col("tokens"), F.col("i"), negators), F.lit(False)) if negators else F.lit(False)
    met = t.select("doc_id", "n_words", "term", off.alias("off")).join(lexicon.select("term", "category"), "term", "left")
    taken = (F.col("category") != "positive") | ~F.col("off")
    sums = [F.sum(F.when((F.col("category") == c) & taken, 1).otherwise(0)).alias(c) for c in CATEGORIES]
    return met.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *sums)


def indices(docs: DataFrame, lexicon: DataFrame, negators: Sequence[str] = (), master: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_neg, n_pos and per category its share of the words; net tone. doc_id tells texts apart."""
    if master is None:
        x = _counted(docs, lexicon, negators)
    else:
        by = hits(docs, lexicon, negators).groupBy("doc_id").agg(*[F.sum(F.when(F.col("category") == c, F.col("tf")).otherwise(0)).alias(c) for c in CATEGORIES])
        x = lengths(docs, master).join(by, "doc_id", "left").na.fill(0)
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = [(F.col(c) / n).alias(a) for c, a in zip(CATEGORIES, ("neg", "pos", "unc", "lit"), strict=True)]
    counts = [F.col("negative").alias("n_neg"), F.col("positive").alias("n_pos")]
    return x.select("doc_id", "n_words", *counts, *shares, net(F.col("positive"), F.col("negative")).alias("net"))


def tf_idf(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, tfidf: sum over its terms of (1 + ln tf) / (1 + ln n_words) * ln(N / df); null without words."""
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    df = found.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    a = lengths(docs)
    part = (1 + F.log("tf")) / (1 + F.log("n_words")) * F.log(F.col("n_docs") / F.col("df"))
    w = found.join(df, "term").join(a, "doc_id").crossJoin(F.broadcast(n)).groupBy("doc_id").agg(F.sum(part).alias("w"))
    return a.join(w, "doc_id", "left").select("doc_id", F.when(F.col("n_words") > 0, F.coalesce("w", F.lit(0.0))).alias("tfidf"))
