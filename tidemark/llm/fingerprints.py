"""Operator 4: document fingerprints from closed syncmers; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: A piece: a word, or 32 characters of a longer run, so that text without spaces has pieces too.
PIECE = "[^\\x20\\x09-\\x0D]{1,32}"
POSITION_BITS = 24


def add_sketch(df: DataFrame, text: str, out: str, k: int = 5, s: int = 2) -> DataFrame:
    """`df` with array<long> `out`: the anchors of `text`, ascending.

    A window of k pieces is a closed syncmer if the least hash among its inner windows of s pieces
    lies at the first or the last place: a property of the window alone, so that equal passages give
    equal anchors wherever they stand. An anchor is 40 bits of the window's hash over 24 bits of
    its first position; places past 2**24 - 1 count as that. All anchors make the sketch, each hash once, at its first place.
    A text without any syncmer, such as one of fewer than k pieces, has one anchor, its own hash.
    """
    inner = k - s + 1
    mask = ~((1 << POSITION_BITS) - 1)
    # Columns named per output keep each costly array one projection's result, used by the next.
    h, m, found = (f"__{out}_{x}" for x in ("h", "m", "found"))
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), lambda w: F.xxhash64(w)))
    # A hash of s pieces is that of the arrays shifted against each other; places past the end, where
    # a shifted array has nulls, are never asked for.
    last = F.greatest(F.size(h) - (s - 1), F.lit(0))
    inner_hash = F.slice(h, F.lit(1), last)
    for j in range(1, s):
        inner_hash = F.zip_with(inner_hash, F.slice(h, F.lit(1 + j), last), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(m, inner_hash)

    def closed(i: Column) -> Column:
        middle = [F.get(m, i + j) for j in range(inner - 2)]
        edges = (F.get(m, i - 1), F.get(m, i + (inner - 2)))
        return F.least(*edges) <= (F.least(*middle) if len(middle) > 1 else middle[0]) if middle else F.lit(True)

    def anchor(i: Column) -> Column:
        return F.xxhash64(*[F.get(h, i - 1 + j) for j in range(k)]).bitwiseAND(F.lit(mask)).bitwiseOR(F.least((i - 1).cast("long"), F.lit(~mask)))

    whole = F.size(h) - F.lit(k - 1)
    places = F.when(whole > 0, F.sequence(F.lit(1), F.greatest(whole, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(found, F.sort_array(F.transform(F.filter(places, closed), anchor)))
    hash_at = lambda x: F.shiftright(x, POSITION_BITS)
    single = F.filter(F.col(found), lambda x, j: (j == 0) | (hash_at(x) != hash_at(F.get(found, j - 1))))
    sketch = F.when(F.size(found) > 0, single).otherwise(F.array(F.xxhash64(h).bitwiseAND(F.lit(mask))))
    return df.withColumn(out, sketch).drop(h, m, found)


def likeness(a: str, b: str, slack: int = 16) -> Column:
    """How alike two sketches are, 0 to 1: among the hashes of both, the share found in both with
    first places no further apart than the texts' lengths, told by the largest places, or `slack`."""
    place = lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    hash_at = lambda x: F.shiftright(x, POSITION_BITS)
    both = F.sort_array(F.concat(a, b))  # a hash found in both has its two anchors side by side
    length = lambda x: F.array_max(F.transform(F.col(x), place))
    far = F.greatest(F.lit(slack).cast("long"), F.abs(length(a) - length(b)))
    # What a lambda names is evaluated for every element: bounds go in once, with the start value.
    start = F.struct(F.lit(None).cast("long").alias("last"), far.alias("far"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        met = (hash_at(x) == hash_at(acc["last"])) & (F.abs(place(x) - place(acc["last"])) <= acc["far"])
        return F.struct(x.alias("last"), acc["far"].alias("far"), (acc["n"] + F.when(met, 1).otherwise(0)).alias("n"))

    shared = F.aggregate(both, start, step, lambda acc: acc["n"])
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(shared / F.size(F.array_union(F.transform(F.col(a), hash_at), F.transform(F.col(b), hash_at))))


def spelt(sketch: str) -> Column:
    return F.array_join(F.transform(F.col(sketch), lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, docs_per_bucket: int = 500, most_buckets: int = 65_536) -> tuple[DataFrame, object]:
    """Rows of (doc_id, text) dealt to buckets of neighbouring ids, and the window over a bucket.

    The bucket bounds are approximate quantiles of doc_id, at most `most_buckets` numbers. Each
    bucket gets, marked `ghost` and sorted last, a copy of the first row of the next one (the last
    bucket: of the first), so that lead() crosses buckets. Null ids sort first; equal ids sort by a
    hash of the text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = min(most_buckets, max(1, docs.count() // docs_per_bucket))
    bounds = []
    if n > 1:
        chances = [i / n for i in range(1, n)]
        got = docs.agg(F.percentile_approx("doc_id", chances, 100 * n).alias("p")).first()["p"] or []
        bounds = sorted(set(got))
    bucket = F.lit(0)
    if bounds:
        array = F.lit(bounds)
        steps = F.lit([1 << b for b in reversed(range(len(bounds).bit_length()))])
        bucket = F.aggregate(  # binary search: how many bounds are at or below doc_id
            steps,
            F.lit(0),
            lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at),
        )
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", bucket)
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "tie")).alias("head"))
    order = Window.orderBy("bucket")  # a row per bucket
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("head.doc_id").alias("id"), F.col("head.tie").alias("t"), before.alias("to"))
    ghosts = (
        rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
        .dropDuplicates(["to"])
        .select("doc_id", "text", "tie", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    )
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return both, Window.partitionBy("bucket").orderBy("ghost", "doc_id", "tie")


def fingerprint(docs: DataFrame, k: int = 5, s: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. Texts without pieces, empty ones too, share one fingerprint and are wholly
    alike. In a table of one row the next document is the row itself. Repeated rows are documents
    of their own. Other columns are dropped. A fingerprint spells its anchors in hexadecimal.
    """
    rows, neighbours = with_next(docs)
    rows = rows.withColumn("next_text", F.lead("text").over(neighbours))
    rows = add_sketch(rows, "text", "sketch", k, s)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(neighbours)).where(~F.col("ghost"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", F.length("text") - quarter), F.left("next_text", quarter))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = add_sketch(rows, "edited", "edited_sketch", k, s)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spelt("sketch").alias("fingerprint"),
        spelt("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
    )


def op4_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
