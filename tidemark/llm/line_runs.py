"""Operator 8: deletion of later copies of repeated line runs; DataFrame functions only.

A run is consecutive lines of one document. A line is deleted if it lies in a run of at least
`min_words` words that also occurs at an earlier place; places are ordered by doc_id, then line.

The suffixes of all line-id sequences are ordered by prefix doubling over the corpus. In round h a
place has the rank of its first 2**h lines among all prefixes of that length; the pair of its rank
and the rank 2**h lines on, sorted over the corpus and numbered in order, gives the rank of the next
round. A prefix that occurs once cannot repeat at any greater length and leaves, so that each round
holds repeated places only. Ranks are equal just where the prefixes are.

A longest-common-prefix interval of depth n is the range of suffixes whose first n lines are equal.
It is told by the ranks of the two 2**h-runs that cover those n lines. Whether a run repeats depends
only on its shortest prefixes and suffixes with `min_words` words: every line of a maximal repeated
run lies in the shortest window of enough words that starts at it, or in the one that ends with the
run, and those windows repeat with the run. So intervals are needed at one depth per place and
direction, doubling ends where 2**h lines pass half of the longest such window (`min_words` lines at
most, as each has a word), and the union of the windows whose interval has an earlier place is the union of the maximal runs
that have one.

Only lines that occur twice or more enter: a run with any other line cannot repeat. Lines without
words are passed over when runs are compared, and deleted where they stand inside a deleted run.
Lines are told apart by half of their SHA-256, 128 bits: two different lines of 10**12 meet with a
chance below 10**-14; everything above the lines compares ranks, not hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, fresh, written

#: Keys with more than one in so many of all rows are joined by broadcast: at most so many keys.
HOT = 512


def _tie() -> Column:
    """Tells apart documents of one doc_id. Equal rows are one document, cleaned alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _place(docs: DataFrame) -> list[Column]:
    """has, id, tie: a document's place in order, without nulls, so that plain joins meet it."""
    kind = docs.schema["doc_id"].dataType
    return [F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("id"), _tie().alias("tie")]


DOC = ["has", "id", "tie"]


def line_table(docs: DataFrame) -> DataFrame:
    """has, id, tie and, of each line with words, k (its number among those), no, line, words."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    # The outer form, as explode() would have its filter on empty arrays compute the array again.
    split = docs.select(*_place(docs), F.posexplode_outer(F.filter(parts, lambda x: x["words"] > 0)).alias("k", "l")).where("l IS NOT NULL")
    return split.select(*DOC, "k", "l.no", F.substring(F.unhex(F.sha2("l.line", 256)), 1, 16).alias("line"), "l.words")


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, rank, copies of the keys that occur twice or more: ranks ascend in the keys' order.

    The keys are sorted over all tasks; a number that ascends with partition and row is their rank,
    fixed by being written."""
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return written(repeated.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def with_rank(rows: DataFrame, ranks: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Inner join of written `rows` with `ranks`, one row per key: hot keys by broadcast, others by shuffle."""
    seen = ranks.agg(F.sum("copies").alias("total"), F.max("copies").alias("most")).first()
    limit = max(1, (seen["total"] or 0) // HOT)
    if (seen["most"] or 0) <= limit:
        return rows.join(ranks, key).select(*columns)
    hot = F.broadcast(ranks.where(F.col("copies") > limit))  # at most HOT keys
    cold = rows.join(hot, key, "left_anti").join(ranks.where(F.col("copies") <= limit), key)
    return rows.join(hot, key).select(*columns).unionByName(cold.select(*columns))


PLACE = ["has", "id", "tie", "k", "rank"]


def repeated_places(lines: DataFrame) -> DataFrame:
    """has, id, tie, k, no, words, rank of the lines that occur twice or more; written."""
    found = with_rank(lines, ranked(lines, ["line"]), ["line"], [*PLACE, "no", "words"])
    return written(found.dropDuplicates([*DOC, "k"]), "line-places")


def suffix_ranks(places: DataFrame, rounds: int) -> DataFrame:
    """has, id, tie, k, h, rank: the rank of the 2**h lines from each place on, for every place and
    h up to `rounds` at which that prefix occurs twice or more."""
    now = places.select(*PLACE)
    out = now.withColumn("h", F.lit(0))
    for h in range(rounds):
        later = F.first("rank").over(Window.partitionBy(*DOC).orderBy("k").rangeBetween(1 << h, 1 << h))
        pairs = written(now.withColumn("then", later).where("then IS NOT NULL").withColumnRenamed("rank", "first"), "line-pairs")
        now = with_rank(pairs, ranked(pairs, ["first", "then"]), ["first", "then"], PLACE)
        if h + 1 < rounds:
            now = written(now, "line-places")
        out = out.unionByName(now.withColumn("h", F.lit(h + 1)))
    return out


def sequences(places: DataFrame) -> DataFrame:
    """A row per document: has, id, tie and, by repeated line, no, k and words."""
    docs = places.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("k", "no", "words"))).alias("l"))
    return docs.select(*DOC, *[F.col(f"l.{c}").alias(c) for c in ("k", "no", "words")])


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """The shortest windows of enough words from each place on and up to each place: has, id, tie,
    start and end (line numbers), k (of the first line), n (lines with words)."""
    n = F.size("words")

    def shortest(words: Column) -> Column:  # how many of the words' leading lines are enough, or null
        start = F.struct(F.lit(0).alias("lines"), F.lit(0).cast("long").alias("sum"))
        step = lambda s, w: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["lines"] + 1).alias("lines"), (s["sum"] + w).alias("sum")))
        return F.aggregate(words, start, step, lambda s: F.when(s["sum"] >= min_words, s["lines"]))

    def window(a: Column, lines: Column) -> Column:
        return F.struct(a.alias("a"), lines.alias("n"))

    forward = F.transform(F.sequence(F.lit(1), n), lambda i: window(i, shortest(F.slice("words", i, F.lit(min_words)))))

    def ending(e: Column) -> Column:
        low = F.greatest(e - (min_words - 1), F.lit(1))
        lines = shortest(F.reverse(F.slice("words", low, e - low + 1)))
        return window(e - lines + 1, lines)

    found = docs.withColumn("found", F.array_distinct(F.concat(forward, F.transform(F.sequence(F.lit(1), n), ending))))
    whole = lambda w: F.get("k", w["a"] + w["n"] - 2) - F.get("k", w["a"] - 1) == w["n"] - 1
    found = found.withColumn("found", F.filter("found", lambda w: w["n"].isNotNull() & whole(w)))

    def placed(w: Column) -> Column:
        return F.struct(F.get("no", w["a"] - 1).alias("start"), F.get("no", w["a"] + w["n"] - 2).alias("end"), F.get("k", w["a"] - 1).alias("k"), w["n"].alias("n"))

    # inline() would have its filter on empty arrays pushed below and compute the array thrice.
    return found.select(*DOC, F.transform("found", placed).alias("w")).select(*DOC, F.inline_outer("w")).where("n IS NOT NULL")


def intervals(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """The windows whose lines repeat, with `left` and `right`, the ranks that name their interval."""
    level = (F.length(F.bin("n")) - 1).alias("h")
    x = found.select("*", level).withColumn("k2", F.expr("k + n - shiftleft(1, h)"))
    left = ranks.select(*DOC, "k", "h", F.col("rank").alias("left"))
    right = ranks.select(*DOC, F.col("k").alias("k2"), "h", F.col("rank").alias("right"))
    return x.join(left, [*DOC, "k", "h"]).join(right, [*DOC, "k2", "h"]).select(*DOC, "start", "end", "n", "left", "right")


def later_copies(found: DataFrame) -> DataFrame:
    """has, id, tie, runs: merged line ranges (start, end) covered by windows with an earlier copy."""
    key = ["n", "left", "right"]
    place = F.struct(*DOC, "start")
    first = found.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).where("copies > 1")
    later = with_rank(found, written(first, "line-firsts"), key, [*DOC, "start", "end", "first"]).where(place > F.col("first"))
    grouped = later.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("w"))
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def merge(runs: Column, w: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"))
        touches = (F.size(runs) > 0) & (w["start"] <= last["end"] + 1)
        return F.when(touches, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(runs, F.array(w)))

    return grouped.select(*DOC, F.aggregate("w", empty, merge).alias("runs"))


def marked(docs: DataFrame, min_words: int = 50) -> tuple[DataFrame, str, str]:
    """`docs` with later copies of line runs deleted from `text`, and the names of two added columns:
    the text's number of lines, and its deleted line ranges (null where nothing was deleted).

    All rows and columns stay; the added names avoid those of `docs`. A null text stays null, an
    empty one empty; a text of which every line goes is empty. Equal rows (doc_id and text) are
    cleaned alike. A null doc_id comes first in order. Line ends are \\n; other characters of a line
    count, so that lines match exactly. An empty table gives no rows.
    """
    n_lines, runs_name = fresh(docs, "__n_lines"), fresh(docs, "__runs")
    lines = written(line_table(docs), "lines")
    places = repeated_places(lines)
    # Written between the steps, or Catalyst would put each array's expression into its uses.
    found = written(windows(written(sequences(places), "line-sequences"), min_words), "line-windows")
    longest = found.agg(F.max("n")).first()[0] or 1
    ranks = written(suffix_ranks(places, longest.bit_length() - 1), "suffix-ranks")
    runs = later_copies(written(intervals(found, ranks), "line-intervals"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_place(docs))
    joined = left.join(runs, DOC, "left").select("row", "runs")
    text = F.col("row.text")
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.exists("runs", lambda r: (r["start"] <= i) & (i <= r["end"])))
    cleaned = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    columns = [cleaned if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    count = F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias(n_lines)
    return joined.select(*columns, count, F.col("runs").alias(runs_name)), n_lines, runs_name


def delete_line_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The rows and columns of `docs` with cleaned texts; see `marked`."""
    return marked(docs, min_words)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_emptied(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """As delete_line_runs, without the documents that lose all their words: whole later copies."""
    cleaned, _, runs = marked(docs, min_words)
    emptied = F.col(runs).isNotNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return cleaned.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, n_lines, runs_name = marked(documents(spark, sf_dir).select("doc_id", "text"))
    runs = F.coalesce(runs_name, F.array().cast("array<struct<start: int, end: int>>"))
    return cleaned.select(
        "doc_id",
        F.col(n_lines).cast("long").alias("n_lines"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"] + 1).alias("n_deleted"),
        F.array_join(F.transform(runs, lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP8_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS no FROM split
), worded AS (
  SELECT *, row_number() OVER d AS k, sum(words) OVER d AS total
  FROM (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines)
  WHERE words > 0
  WINDOW d AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)
), pairs AS (
  SELECT x.doc_id, x.k AS a, y.k AS b
  FROM worded x JOIN worded y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + 49
  WHERE y.total - x.total + x.words >= 50
), shortest AS (
  SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY doc_id, a
  UNION
  SELECT doc_id, max(a) AS a, b FROM pairs GROUP BY doc_id, b
), content AS (
  SELECT s.doc_id, s.a, s.b, min(w.no) AS first, max(w.no) AS last, string_agg(w.line, chr(10) ORDER BY w.k) AS text
  FROM shortest s JOIN worded w ON s.doc_id = w.doc_id AND w.k BETWEEN s.a AND s.b
  GROUP BY s.doc_id, s.a, s.b
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, a) AS copy FROM content) WHERE copy > 1
), marked AS (
  SELECT l.*, EXISTS (SELECT 1 FROM later x WHERE x.doc_id = l.doc_id AND l.no BETWEEN x.first AND x.last) AS gone FROM lines l
), ranges AS (
  SELECT doc_id, min(no) AS s, max(no) AS e
  FROM (SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS island FROM marked WHERE gone)
  GROUP BY doc_id, island
), spelt AS (
  SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS runs FROM ranges GROUP BY doc_id
)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted, coalesce(any_value(p.runs), '') AS runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked m LEFT JOIN spelt p ON m.doc_id = p.doc_id
GROUP BY m.doc_id
"""
