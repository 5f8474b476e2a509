"""Dictionary phrases of several words: greedy longest matches, and spans of terms in a text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import negated, tokens_vi

CATEGORIES = ("negative", "positive", "uncertainty", "litigious")


def longest_matches(docs: DataFrame, lexicon: DataFrame, longest: int, negators: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words and a count per category; a row per document, zeros where nothing matches.

    From the left the longest phrase wins and its words are used up. A positive phrase with a
    negator among the three words before it does not count, yet uses its words. Word runs meet
    the lexicon by a join, so that only matches are shuffled; the fold holds one text's matches.
    """
    t = docs.select("doc_id", tokens_vi(F.col("text")).alias("tokens"))
    places = t.select("doc_id", "tokens", F.posexplode("tokens").alias("i", "one"))
    runs = []
    for n in range(1, longest + 1):
        words = [F.get("tokens", F.col("i") + j) for j in range(n)]
        spaced = [x for w in words for x in (F.lit(" "), w)][1:]
        runs.append(F.struct(F.lit(n).alias("n"), F.concat(*spaced).alias("term")))
    off = negated(F.col("tokens"), F.col("i"), negators) if negators else F.lit(False)
    runs = places.select("doc_id", "i", off.alias("off"), F.explode(F.array(*runs)).alias("r"))
    runs = runs.select("doc_id", "i", "off", "r.n", "r.term").where("term IS NOT NULL")
    flags = [F.max(F.when(F.col("category") == c, 1).otherwise(0)).alias(c) for c in CATEGORIES]
    entries = lexicon.groupBy("term").agg(*flags)
    met = runs.join(entries if _entries(lexicon) is None else F.broadcast(entries), "term")
    met = met.withColumn("positive", F.when(F.col("off"), 0).otherwise(F.col("positive")))
    hit = F.struct("i", (-F.col("n")).alias("shorter"), "n", *CATEGORIES)
    found = met.groupBy("doc_id").agg(F.sort_array(F.collect_list(hit)).alias("found"))
    zero = F.struct(F.lit(0).alias("end"), *[F.lit(0).cast("long").alias(c) for c in CATEGORIES])

    def take(a: Column, h: Column) -> Column:
        added = F.struct((h["i"] + h["n"]).alias("end"), *[(a[c] + h[c]).alias(c) for c in CATEGORIES])
        return F.when(h["i"] >= a["end"], added).otherwise(a)

    counts = found.select("doc_id", F.aggregate("found", zero, take).alias("c")).select("doc_id", *[f"c.{c}" for c in CATEGORIES])
    sizes = t.select("doc_id", F.greatest(F.size("tokens"), F.lit(0)).cast("long").alias("n_words"))
    return sizes.join(counts, "doc_id", "left").na.fill(0, list(CATEGORIES))


def _entries(lexicon: DataFrame, most: int = 100_000) -> list[tuple[str, list[str]]] | None:
    """(term, categories) of a dictionary of at most `most` rows; None for a larger one, which is to be
    joined by a shuffle. A dictionary made on the driver costs no job."""
    rows = lexicon.select("term", "category").limit(most + 1).collect()
    if len(rows) > most:
        return None
    found: dict[str, set[str]] = {}
    for r in rows:
        if r["term"] is not None and r["category"] is not None:
            found.setdefault(r["term"], set()).add(r["category"])
    return [(term, sorted(categories)) for term, categories in sorted(found.items())]


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))])


class Trie:
    """The phrases of a dictionary as a trie over words."""

    def __init__(self, entries: Sequence[tuple[str, list[str]]], longest: int) -> None:
        self.root: dict = {}
        for term, categories in entries:
            words = term.split(" ")
            if len(words) <= longest:
                node = self.root
                for word in words:
                    node = node.setdefault(word, {})
                node[None] = (term, categories)  # no word is None

    def matches(self, words: Sequence[str]) -> Iterator[tuple[int, int, tuple[str, list[str]]]]:
        """(first word, end, entry) of the longest phrase at each place, from the left; its words are used up."""
        i, n = 0, len(words)
        while i < n:
            node, j, best = self.root.get(words[i]), i + 1, None
            while node is not None:
                if None in node:
                    best = (i, j, node[None])
                node = node.get(words[j]) if j < n else None
                j += 1
            if best:
                yield best
            i = best[1] if best else i + 1


def _worded(docs: DataFrame, cased: Column, word: str) -> DataFrame:
    """doc_id, words, gaps: the words of the cased text and the lengths of what stands before each; null
    where the case changes the text's length, and for a null text."""
    t = docs.select("doc_id", F.when(F.length(cased) == F.length("text"), cased).alias("u"))
    return t.select("doc_id", F.regexp_extract_all("u", F.lit(word), F.lit(0)).alias("words"), F.transform(F.split("u", word), lambda g: F.length(g)).alias("gaps"))


def _spans(docs: DataFrame, cased: Column, word: str, lexicon: DataFrame, longest: int, negators: Sequence[str], most: int, reach: int = 3) -> DataFrame:
    """doc_id, spans of the greedy longest phrases. A dictionary of at most `most` rows is a trie that goes
    to the tasks: each text is walked once, in place, without a shuffle. Candidates for a larger one are
    joined with it by a shuffle, as numbers and one phrase each; there doc_id must tell texts apart."""
    entries = _entries(lexicon, most)
    t = _worded(docs, cased, word)
    off = frozenset(negators)
    if entries is None:
        return _joined_spans(t, lexicon, longest, negators)
    trie = Trie(entries, longest)

    def walk(words: list[str], gaps: list[int]) -> Iterator[tuple[int, int, str, list[str]]]:
        ends = list(accumulate(g + len(w) for g, w in zip(gaps, words, strict=False)))  # the last gap has no word after it
        for i, j, (term, categories) in trie.matches(words):
            if "positive" in categories and not off.isdisjoint(words[max(0, i - reach) : i]):
                categories = [c for c in categories if c != "positive"]
            if categories:
                yield ends[i] - len(words[i]), ends[j - 1], term, categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if w is None else [dict(zip(SPAN.names, s, strict=True)) for s in walk(w, g)] for w, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("categories", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return t.mapInArrow(run, T.StructType([t.schema["doc_id"], T.StructField("spans", T.ArrayType(SPAN))]))


def _joined_spans(t: DataFrame, lexicon: DataFrame, longest: int, negators: Sequence[str]) -> DataFrame:
    """`_spans` by a shuffle join: a row per word and length meets the dictionary, matches meet by text."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if w is None else list(accumulate(g + len(x) for g, x in zip(gaps, w, strict=False))) for w, gaps in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "words", "ends"])

    placed = t.mapInArrow(ends, T.StructType([t.schema["doc_id"], t.schema["words"], T.StructField("ends", T.ArrayType(T.IntegerType()))]))
    words = placed.select("doc_id", "words", "ends", F.posexplode("words").alias("i", "word"))
    off = negated(F.col("words"), F.col("i"), negators) if negators else F.lit(False)
    runs = []
    for n in range(1, longest + 1):
        spaced = [x for j in range(n) for x in (F.lit(" "), F.get("words", F.col("i") + j))][1:]
        runs.append(F.struct(F.lit(n).alias("n"), F.concat(*spaced).alias("term"), F.get("ends", F.col("i") + n - 1).alias("end")))
    start = F.get("ends", F.col("i")) - F.length("word")
    x = words.select("doc_id", "i", start.alias("start"), F.coalesce(off, F.lit(False)).alias("off"), F.inline(F.array(*runs))).where("term IS NOT NULL")
    entries = lexicon.groupBy("term").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    kept = F.filter("categories", lambda c: (c != "positive") | ~F.col("off"))
    hit = F.struct("i", (-F.col("n")).alias("shorter"), "n", "start", "end", "term", kept.alias("categories"))
    found = t.select("doc_id", F.col("words").isNotNull().alias("there")).join(x.join(entries, "term").groupBy("doc_id").agg(F.sort_array(F.collect_list(hit)).alias("found")), "doc_id", "left")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for there, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                free, kept = 0, []
                for h in hits or []:
                    if h["i"] >= free:
                        free = h["i"] + h["n"]
                        if h["categories"]:
                            kept.append({k: h[k] for k in SPAN.names})
                out.append(kept if there else None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("categories", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return found.mapInArrow(take, T.StructType([t.schema["doc_id"], T.StructField("spans", T.ArrayType(SPAN))]))


TOKEN = r"(?U)\b[A-Z][A-Z\-]+\b"


def term_spans(docs: DataFrame, lexicon: DataFrame, negators: Sequence[str] = (), most: int = 100_000) -> DataFrame:
    """doc_id, spans: array of (start, end, term, categories) of a text's single-word terms, by start.

    lexicon: term, category. Offsets count code points of the text; spans are null where upper-casing
    changes the length, and for a null text. A positive term after a negator is left out."""
    return _spans(docs, F.upper("text"), TOKEN, lexicon, 1, negators, most)


def phrase_spans(docs: DataFrame, lexicon: DataFrame, longest: int, negators: Sequence[str] = (), most: int = 100_000) -> DataFrame:
    """doc_id, spans: array of (start, end, term, categories) of greedy longest phrases in lower-case text.

    The rule is that of `longest_matches`; offsets count code points of the text, null where
    lower-casing changes the length."""
    return _spans(docs, F.lower("text"), "[a-zà-ỹđ]+", lexicon, longest, negators, most)


def top_words(spans: DataFrame, most: int = 12) -> DataFrame:
    """doc_id, category, term, n, place: each text's most frequent terms by category, ties by term."""
    s = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.term").alias("term"), F.explode("s.categories").alias("category"))
    n = s.groupBy("doc_id", "category", "term").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy(F.desc("n"), "term"))
    return n.withColumn("place", place).where(F.col("place") <= most)


def apart(spans: Column, others: Column) -> Column:
    """Those spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))
