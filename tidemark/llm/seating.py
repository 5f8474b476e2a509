"""Operator 6: a hierarchical Pitman-Yor language model by Chinese-restaurant seating.

Tokens are words and an end per text. Each token is a customer of the restaurant of its context: the
word before it, whichever it is, or the text's start. All context restaurants share one parent, the
unigram restaurant, whose customers are their tables and whose own parent is uniform over the known
words and one unknown.

How it spreads: tokens go, packed per task, to buckets. After one of the `contexts` most frequent words
or a start that is the bucket of the word's own hash, which so has all customers of its words in these
restaurants, whose totals are summed up for all buckets. After any other word it is the bucket of that
word before, which so has the whole restaurant of it; a token there needs its word's place in the parent,
which for frequent words is global and for others kept by the bucket of the word, its home. Buckets
tell the homes how many tables their restaurants have, and homes tell them the parent's state, by
mail: integers in the order of the words that both know since the packing.
A Gibbs sweep takes every word of every restaurant: its customers leave, and its tables are drawn
again from their conditional given all others, whose totals and parent's probabilities are those of
the sweep before; the parent counts mailed tables from the sweep before, too. A lost bucket is seated again
alike, as its random numbers start from its number and the sweep's.
Occurrences of the `hot` most frequent words after frequent ones travel as counts only, not by document;
their probabilities are broadcast (hot * (contexts + 1) at most) and applied where the texts are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, mix, tasks, word_hashes, written

#: The end token's hash, and a null doc_id's stand-in inside packed blocks.
END = np.uint64(0x5EED0FE2D0000001)
NULL_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Seating:
    """contexts: restaurants whose totals are global, others stay in a bucket; hot: see above; sweeps: Gibbs sweeps, of which the first `burn` are not averaged;
    strengths: of the context and of the parent restaurants; flush: tokens packed at a time;
    bucket_tokens: tokens per bucket, of which under half are not hot; least_buckets: at least so many."""

    contexts: int = 65_000
    hot: int = 64
    sweeps: int = 3
    burn: int = 1
    strengths: tuple[float, float] = (1.0, 1.0)
    flush: int = 1_000_000
    bucket_tokens: int = 4_000_000
    least_buckets: int = 64


def tokens(text: str) -> np.ndarray:
    """Hashes of the text's words, A-Z in lower case, and of its end."""
    return np.append(word_hashes(text.encode().lower().split()), END)


def held_out(docs: DataFrame) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), held_out(docs).alias("held"), text.alias("text"))


def word_counts(docs: DataFrame, flush: int) -> DataFrame:
    """w (hash), c: training tokens by word; each task sums its own before the shuffle."""

    def run(batches):
        def summed(parts):
            w, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

        held, have = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(tokens(text))
                have += len(held[-1])
                if have >= 4 * flush:
                    yield summed(held)
                    held, have = [], 0
        if have:
            yield summed(held)

    return docs.where("NOT held").select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Places:
    """Where words stand among the hot words and the frequent ones, which are numbered as contexts and,
    with the end as number n, as words of the parent restaurant; counts: theirs, by number."""

    def __init__(self, hot: np.ndarray, contexts: np.ndarray, counts: np.ndarray, buckets: int) -> None:
        self.hot = np.sort(hot)
        order = np.argsort(contexts)
        self.contexts, self.number, self.n = contexts[order], order, len(contexts)
        self.counts, self.buckets = counts, buckets
        self.kind = np.uint16 if self.n + 1 < 1 << 16 else np.uint32  # of a context's number where it is packed

    def home(self, w: np.ndarray) -> np.ndarray:
        return (mix(w) % np.uint64(self.buckets)).astype(np.int64)

    def hot_index(self, w: np.ndarray) -> np.ndarray:
        """The place in `hot`, or -1."""
        if not len(self.hot):
            return np.full(len(w), -1)
        i = np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)
        return np.where(self.hot[i] == w, i, -1)

    def number_of(self, w: np.ndarray) -> np.ndarray:
        """Each word's number among the frequent ones: n + 1 if it is none of them."""
        u = np.full(len(w), self.n + 1, self.kind)
        if self.n and len(w):
            i = np.minimum(np.searchsorted(self.contexts, w), self.n - 1)
            same = self.contexts[i] == w
            u[same] = self.number[i[same]]
        u[w == END] = self.n
        return u

    def context_of(self, w: np.ndarray) -> np.ndarray:
        """Each token's context: n is a text's start, n + 1 a word before that is not frequent."""
        return np.append(np.array([self.n], self.kind), self.number_of(w[:-1]))


def squeezed(arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays by planes of their bytes: lowest, second and higher ones are compressed apart, hashes with theirs."""
    import zstandard

    groups: list[list[bytes]] = [[], [], [], []]
    for a in arrays:
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        for i, plane in enumerate(planes):
            groups[(2 if i == 7 else 3) if a.dtype == np.uint64 else min(i, 2)].append(plane.tobytes())
    frames = [zstandard.ZstdCompressor(level=1).compress(b"".join(g)) for g in groups]
    return np.array([len(a) for a in arrays] + [len(f) for f in frames], np.uint32).tobytes() + b"".join(frames)


def expanded(x: bytes, types: Sequence[type]) -> list[np.ndarray]:
    import zstandard

    head = np.frombuffer(x, np.uint32, len(types) + 4).tolist()
    at, groups = 4 * len(head), []
    for size in head[len(types) :]:
        groups.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(x[at : at + size]), np.uint8))
        at += size
    places, arrays = [0] * 4, []
    for n, t in zip(head, types, strict=False):
        size = np.dtype(t).itemsize
        a = np.empty((n, size), np.uint8)
        for i in range(size):
            g = (2 if i == 7 else 3) if t is np.uint64 else min(i, 2)
            a[:, i] = groups[g][places[g] : places[g] + n]
            places[g] += n
        arrays.append(a.view(t).ravel())
    return arrays


def pack(docs: DataFrame, places: Places, p: Seating) -> DataFrame:
    """bucket, payload: the tokens of a task's documents, by bucket."""
    sent = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        row = TaskContext.get().partitionId() << 40  # numbers the documents

        def packed(rows, row):
            at = sent.value
            w = np.concatenate([r[0] for r in rows])
            u = np.concatenate([at.context_of(r[0]) for r in rows])
            d = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(r[0]) for r in rows])
            ids, ties, held = (np.array([r[i] for r in rows], t) for i, t in ((1, np.int64), (2, np.int64), (3, bool)))
            # After words that are not frequent: to the bucket of the word before, and to the word's home.
            rare = np.flatnonzero(u > at.n)
            before, after, rare_d = w[rare - 1], w[rare], d[rare]
            rare_b = at.home(before)
            order = np.lexsort((rare_d, before, rare_b))
            before, after, rare_d, rare_b = before[order], after[order], rare_d[order], rare_b[order]
            number = at.number_of(after)
            guest = np.flatnonzero(number > at.n)
            guest_w, guest_from, guest_held = after[guest], rare_b[guest], held[rare_d[guest]]
            guest_b = at.home(guest_w)
            order = np.lexsort((guest_w, guest_from, guest_b))
            guest_w, guest_from, guest_b, guest_held = guest_w[order], guest_from[order], guest_b[order], guest_held[order]
            first = np.ones(len(order), bool)
            first[1:] = (guest_w[1:] != guest_w[:-1]) | (guest_from[1:] != guest_from[:-1])
            first = np.flatnonzero(first)
            guest_count = np.add.reduceat(~guest_held, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)
            guest_w, guest_from, guest_b = guest_w[first], guest_from[first], guest_b[first]
            # Hot words after frequent ones: counts of training tokens by context. Others: every token with its document.
            w, u, d = (np.delete(x, rare) for x in (w, u, d))
            hot_at = at.hot_index(w)
            hot = hot_at >= 0
            learnt = hot & ~held[d]
            pair, hot_count = np.unique(hot_at[learnt] << 32 | u[learnt].astype(np.int64), return_counts=True)
            w, u, d = w[~hot], u[~hot], d[~hot]
            b = at.home(w)
            order = np.lexsort((d, w, b))
            w, u, d, b = w[order], u[order], d[order], b[order]
            hot_b = at.home(at.hot[pair >> 32])
            far_at = np.cumsum(np.append(0, number > at.n))
            first_row = np.array([row], np.int64)
            listed = at.home(first_row.view(np.uint64))  # one bucket has the documents' list
            for bucket in np.unique(np.concatenate([b, hot_b, rare_b, guest_b, listed])).tolist():
                lo, hi = np.searchsorted(b, [bucket, bucket + 1])
                rare_lo, rare_hi = np.searchsorted(rare_b, [bucket, bucket + 1])
                guest_lo, guest_hi = np.searchsorted(guest_b, [bucket, bucket + 1])
                mine = hot_b == bucket
                kinds, repeat = np.unique(w[lo:hi], return_counts=True)
                rare_kinds, rare_repeat = np.unique(before[rare_lo:rare_hi], return_counts=True)
                doc = np.append(d[lo:hi], rare_d[rare_lo:rare_hi])
                m = len(ids) if bucket == listed[0] else 0
                far = guest[far_at[rare_lo] : far_at[rare_hi]]
                arrays = (
                    kinds, repeat.astype(np.uint32), u[lo:hi], rare_kinds, rare_repeat.astype(np.uint32), number[rare_lo:rare_hi], after[far],
                    doc, np.packbits(held[doc]), first_row, ids[:m], ties[:m],
                    np.diff(pair[mine], prepend=0), hot_count[mine].astype(np.uint32),
                    guest_from[guest_lo:guest_hi].astype(np.uint32), guest_w[guest_lo:guest_hi], guest_count[guest_lo:guest_hi],
                )
                yield bucket, squeezed(arrays)

        def batch_of(rows, row):
            got = list(packed(rows, row))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["bucket", "payload"])

        rows, have = [], 0
        for batch in batches:
            for doc, tie, held, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows.append((tokens(text), NULL_ID if doc is None else doc, tie, held))
                have += len(rows[-1][0])
                if have >= p.flush:
                    yield batch_of(rows, row)
                    row += len(rows)
                    rows, have = [], 0
        if rows:
            yield batch_of(rows, row)

    return docs.select("doc_id", "tie", "held", "text").mapInArrow(run, "bucket int, payload binary")


def payload_types(places: Places) -> tuple[type, ...]:
    """Of a payload's arrays: words, their repeats and contexts; words before that are not frequent, their
    repeats, the numbers of the words after them and the hashes of those without number; documents of
    all these, a bit whether held out; the row number of the first document, and in one bucket ids and
    ties of all; differences of hot pairs (place << 32 | context) and their counts; buckets that have words of
    this one after theirs, the words, their counts."""
    n = places.kind
    return (np.uint64, np.uint32, n, np.uint64, np.uint32, n, np.uint64, np.uint32, np.uint8, np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint32, np.uint64, np.uint32)


class Bucket:
    """A bucket's tokens: customers by (word, context) pair, and where each token belongs. It has all
    hot and frequent words that it is the home of; the hot ones have pairs with all frequent contexts,
    also those without customers.

    Words of pairs: first its own `words`, then those of other homes that its restaurants hold: the
    numbered ones, then `far`, ordered by home. Contexts: the numbered ones, then its own.
    guest_from, guest: buckets whose restaurants hold own words, and these words' places."""

    def __init__(self, payloads: list[bytes | None], places: Places, number: int) -> None:
        types = payload_types(places)
        parts = [[np.zeros(0, t)] for t in types]
        split = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        out = ([np.zeros(0, bool)], [np.zeros(0, bool)])
        listed = [np.zeros(0, np.int64)]
        for x in payloads:
            if x is None:
                continue
            arrays = expanded(x, types)
            arrays[0] = np.repeat(arrays[0], arrays[1])
            arrays[3] = np.repeat(arrays[3], arrays[4])
            row, near = arrays[9][0], len(arrays[0])
            doc, held = row + arrays[7].astype(np.int64), np.unpackbits(arrays[8], count=len(arrays[7])).astype(bool)
            for i, mine in enumerate((slice(None, near), slice(near, None))):
                split[i].append(doc[mine])
                out[i].append(held[mine])
            listed.append(row + np.arange(len(arrays[10])))
            arrays[12] = np.cumsum(arrays[12])
            for part, a in zip(parts, arrays, strict=True):
                part.append(a)
        w, _, u, before, _, after, far, _, _, _, self.ids, self.ties, pair, hot_c, guest_from, guest_w, guest_c = (np.concatenate(x) for x in parts)
        self.doc, self.held = (np.concatenate([*x[0], *x[1]]) for x in (split, out))  # of each token: its document's row number, whether held out
        self.listed = np.concatenate(listed)  # the documents with ids and ties
        n = places.n + 1
        hot = np.flatnonzero(places.home(places.hot) == number)
        numbered = np.append(places.contexts, END)
        hot_w = places.hot[np.append(pair >> 32, np.repeat(hot, n))]
        hot_u = np.append(pair & 0xFFFFFFFF, np.tile(np.arange(n), len(hot)))
        hot_c = np.append(hot_c.astype(np.int64), np.zeros(len(hot) * n, np.int64))
        self.words = np.unique(np.concatenate([w, hot_w, guest_w, numbered[places.home(numbered) == number]]))
        self.number = places.number_of(self.words).astype(np.int64)
        place = lambda w: np.searchsorted(self.words, w).astype(np.int64)
        # The restaurants of its own, and the words in them.
        self.far = np.unique(far)
        home = places.home(self.far)
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        there = after.astype(np.int64)
        there[after > places.n] = n + rank[np.searchsorted(self.far, far)]
        self.far, self.far_home = self.far[order], home[order]
        restaurant = np.unique(before, return_inverse=True)[1]
        self.n_contexts = n
        token = np.append(place(w) << 32 | u.astype(np.int64), (len(self.words) + there) << 32 | (n + restaurant))
        self.pairs, inverse = np.unique(np.append(token, place(hot_w) << 32 | hot_u.astype(np.int64)), return_inverse=True)
        self.token = inverse[: len(token)]  # each token's pair
        weight = np.concatenate([(~self.held).astype(np.float64), hot_c.astype(np.float64)])
        self.c = np.bincount(inverse, weights=weight, minlength=len(self.pairs)).astype(np.int64)
        self.word, self.context = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        guest = place(guest_w)
        self.of_word = by_word(self, self.c) + np.bincount(guest, weights=guest_c, minlength=len(self.words)).astype(np.int64)
        numbered = self.number < n
        self.of_word[numbered] = places.counts[self.number[numbered]]
        links = np.unique(guest_from.astype(np.int64) << 32 | guest)
        self.guest_from, self.guest = links >> 32, links & 0xFFFFFFFF


def by_word(b: Bucket, x: np.ndarray) -> np.ndarray:
    """A number per pair summed by the bucket's own words."""
    return np.bincount(b.word, weights=x, minlength=len(b.words)).astype(np.int64)[: len(b.words)]


#: Up to so many customers of an entry are seated by their exact conditional.
EXACT = 64


@lru_cache(maxsize=4)
def seatings(discount: float) -> np.ndarray:
    """log S[c, t]: the weight of all ways to seat c customers at t tables, c and t up to EXACT.

    One more customer opens a table, or joins one of those seated with their number less the
    discount of their tables."""
    s = np.zeros((EXACT + 1, EXACT + 1))
    s[0, 0] = 1
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT + 1):
        s[c, 1:] = s[c - 1, :-1] + np.maximum(c - 1 - discount * t, 0) * s[c - 1, 1:]
    with np.errstate(divide="ignore"):
        return np.log(s)


def seats(customers: np.ndarray, discount: float, mass: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each entry (a word in a restaurant), all its customers having left and come back.

    mass: strength + discount * the restaurant's other tables; chance: the parent's probability of
    the word. With t tables an entry has weight S[c, t] * prod((mass + discount * k) * chance, k < t);
    up to EXACT customers t is drawn from just that. Further customers come in groups of an eighth of
    those seated, each group drawn by one binomial.
    """
    tables, log_s = (customers > 0).astype(np.int64), seatings(discount)
    first = np.minimum(customers, EXACT)
    order = np.argsort(first, kind="stable")
    ends = np.searchsorted(first[order], np.arange(2, EXACT + 2))
    for c, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), start=2):
        for at in range(lo, hi, 65_536):
            mine = order[at : min(at + 65_536, hi)]
            opened = np.log((mass[mine, None] + discount * np.arange(c)) * chance[mine, None]).cumsum(1)
            weight = log_s[c, 1 : c + 1] + opened
            weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
            tables[mine] = 1 + (weight < rng.random((len(mine), 1)) * weight[:, -1:]).sum(1)
    seated, left = first.astype(np.int64), np.flatnonzero(customers > EXACT)
    while len(left):
        n, t = seated[left], tables[left]
        group = np.minimum(np.maximum(1, n // 8), customers[left] - n)
        fresh = (mass[left] + discount * t) * chance[left]
        tables[left] = t + rng.binomial(group, np.clip(fresh / (fresh + n - discount * t), 0, 1))
        seated[left] = n + group
        left = left[seated[left] < customers[left]]
    return tables


@dataclass(frozen=True)
class Totals:
    """Global state after a sweep: customers and tables by numbered context, customers and tables of the
    parent; what does not change: the discounts, words V; and of the numbered words the parent's
    customers and tables, and the customers from restaurants kept by their bucket."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    discounts: tuple[float, float]
    v: int
    word_tables: np.ndarray | None = None
    word_parents: np.ndarray | None = None
    away: np.ndarray | None = None


#: Kinds of mail. To a word's home: its tables in a bucket's own restaurants. From there: its customers
#: and tables in the parent, and its count in the training texts. To the bucket itself: its state. To
#: all: what is summed up.
TABLES, PARENT, COUNTS, STATE, TOTAL = range(5)
MAIL = "bucket int, sender int, kind int, sweep int, payload binary"


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    import zstandard

    kind = np.min_scalar_type(int(x.max(initial=0)))
    return zstandard.ZstdCompressor(level=1).compress(bytes([kind.itemsize]) + x.astype(kind).tobytes())


def _counts(x: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


class Mail:
    """What a bucket has got: payloads by kind, sweep and sender."""

    def __init__(self, b: Bucket, post: pa.Table) -> None:
        self.b, self.got = b, {}
        for sender, kind, sweep, payload in zip(*(post[c].to_pylist() for c in ("sender", "kind", "sweep", "payload")), strict=True):
            self.got.setdefault((kind, sweep), {})[sender] = _counts(payload)

    def state(self, sweep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (x,) = self.got[STATE, sweep].values()
        return tuple(np.split(x, [len(self.b.pairs), len(self.b.pairs) + len(self.b.words)]))

    def _of_far(self, kind: int, sweep: int, each: int) -> np.ndarray:
        """`each` rows of the far words' numbers, from their homes in order."""
        got = sorted(self.got.get((kind, sweep), {}).items())
        return np.concatenate([np.zeros((each, 0), np.int64), *[x.reshape(each, -1) for _, x in got]], axis=1)

    def parents(self, t: np.ndarray, s: np.ndarray, x: Totals, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """t and s of the own words with those of the words of other homes."""
        far_t, far_s = self._of_far(PARENT, sweep, 2)
        return np.concatenate([t, x.word_tables, far_t]), np.concatenate([s, x.word_parents, far_s])

    def counts(self, places: Places) -> np.ndarray:
        return np.concatenate([self.b.of_word, places.counts, self._of_far(COUNTS, -1, 1)[0]])

    def remote(self, away: np.ndarray, sweep: int) -> np.ndarray:
        """The own words' tables in restaurants that other buckets keep; `away`: of numbered words."""
        got = [x for _, x in sorted(self.got.get((TABLES, sweep), {}).items())]
        x = np.bincount(self.b.guest, weights=np.concatenate([np.zeros(0), *got]), minlength=len(self.b.words)).astype(np.int64)
        numbered = self.b.number < self.b.n_contexts
        x[numbered] += away[self.b.number[numbered]].astype(np.int64)
        return x


def in_restaurants(b: Bucket, x: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """A number per pair summed by restaurant: `totals` of the numbered ones, then the bucket's own."""
    n = len(totals)
    own = b.context >= n
    return np.append(totals, np.bincount(b.context[own] - n, weights=x[own])) if own.any() else totals


def parent_chance(t: np.ndarray, s: np.ndarray, x: Totals, strength: float) -> np.ndarray:
    d = x.discounts[1]
    return (np.maximum(t - d * s, 0) + (strength + d * x.parent_tables) / (x.v + 1)) / (strength + x.parent_customers)


def sweep_states(b: Bucket, number: int, history: list[Totals], p: Seating, mail: Mail | None = None, away: np.ndarray | None = None):
    """The bucket's (tables by pair, parent customers and parent tables by word) after each sweep,
    the first being one table for every pair and word. With mail: after the one sweep that it is for."""
    last = len(history)
    for k in range(last if mail else 0, last + 1):
        if mail and k:
            tables, t, s = mail.state(k - 1)
        if k:
            x = history[k - 1]
            rng = np.random.default_rng([number, k])
            d, d0 = x.discounts
            mass = p.strengths[0] + d * (in_restaurants(b, tables, x.tables)[b.context] - tables)
            chance = parent_chance(*(mail.parents(t, s, x, k - 1) if mail else (t, s)), x, p.strengths[1])
            tables = seats(b.c, d, mass, chance[b.word], rng)
        else:
            tables = (b.c > 0).astype(np.int64)
        t = by_word(b, tables)
        if mail:
            t = t + mail.remote(away, k - 1)
        if k:
            s = seats(t, d0, p.strengths[1] + d0 * (x.parent_tables - s), np.full(len(t), 1 / (x.v + 1)), rng)
        else:
            s = (t > 0).astype(np.int64)
        yield tables, t, s


def _posted(b: Bucket, number: int, sweep: int, tables: np.ndarray, guests: tuple[int, list[np.ndarray]], state: list[np.ndarray], totals: np.ndarray) -> pa.Table:
    """A bucket's mail: the tables of far words to their homes, to the guests' buckets the numbers by own
    word, the state to itself, the totals to all."""
    out = []
    far = np.bincount(b.word, weights=tables, minlength=len(b.words) + b.n_contexts + len(b.far))[len(b.words) + b.n_contexts :].astype(np.int64)
    for to in np.unique(b.far_home).tolist():
        lo, hi = np.searchsorted(b.far_home, [to, to + 1])
        out.append((to, TABLES, _small(far[lo:hi])))
    kind, numbers = guests
    for to in np.unique(b.guest_from).tolist():
        lo, hi = np.searchsorted(b.guest_from, [to, to + 1])
        out.append((to, kind, _small(np.concatenate([x[b.guest[lo:hi]] for x in numbers]))))
    if state:
        out.append((number, STATE, _small(np.concatenate(state))))
    out.append((None, TOTAL, _small(totals.astype(np.int64))))
    return pa.table(
        {
            "bucket": pa.array([x[0] for x in out], pa.int32()),
            "sender": pa.array([number] * len(out), pa.int32()),
            "kind": pa.array([x[1] for x in out], pa.int32()),
            "sweep": pa.array([sweep] * len(out), pa.int32()),
            "payload": pa.array([x[2] for x in out], pa.binary()),
        }
    )


def _away(b: Bucket, tables: np.ndarray) -> np.ndarray:
    """Numbered words' tables in the bucket's own restaurants."""
    return np.bincount(b.word, weights=tables, minlength=len(b.words) + b.n_contexts)[len(b.words) : len(b.words) + b.n_contexts]


def _summed(mail: DataFrame, size: int) -> np.ndarray:
    """The buckets' totals, summed by each task first."""

    def run(batches):
        x = np.zeros(size)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                one = _counts(payload)
                x[: len(one)] += one
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(x[at])], names=["at", "x"])

    parts = mail.where(f"kind = {TOTAL}").select("payload").coalesce(tasks(mail)).mapInArrow(run, "at int, x double")
    got = parts.groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # a few numbers a context at most
    x = np.zeros(size)
    x[got["at"].to_numpy()] = got["x"].to_numpy()
    return x


def introduce(packed: DataFrame, places: Places) -> tuple[DataFrame, np.ndarray]:
    """The first mail, a table for each pair and the words' counts; the numbered words' tables in it."""

    def run(table: pa.Table) -> pa.Table:
        number = table["bucket"][0].as_py()
        b = Bucket(table["payload"].to_pylist(), places, number)
        tables = (b.c > 0).astype(np.int64)
        return _posted(b, number, -1, tables, (COUNTS, [b.of_word]), [], _away(b, tables))

    mail = written(packed.groupBy("bucket").applyInArrow(run, MAIL), "seating-mail")
    return mail, _summed(mail, places.n + 1)


def sweep(packed: DataFrame, mail: DataFrame, away: np.ndarray, history: list[Totals], places: Places, v: int, p: Seating) -> tuple[DataFrame, Totals]:
    """Reseat all buckets once more, given the history and the last mail, and sum their totals."""
    n, k = places.n + 1, len(history)

    def run(key, table: pa.Table, post: pa.Table) -> pa.Table:
        number = key[0].as_py()
        b = Bucket(table["payload"].to_pylist(), places, number)
        ((tables, t, s),) = sweep_states(b, number, history, p, Mail(b, post), away)
        own = b.context >= n
        by = lambda x: np.bincount(b.context[~own], weights=x[~own], minlength=n)
        once = [float((x == m).sum()) for x in (b.c, t) for m in (1, 2)]
        parent = np.zeros((2, n))
        numbered = b.number < n
        parent[:, b.number[numbered]] = t[numbered], s[numbered]
        values = np.concatenate([by(tables), _away(b, tables), *parent, [t.sum(), s.sum()], *([] if k else [once, by(b.c)])])
        return _posted(b, number, k, tables, (PARENT, [t, s]), [tables, t, s], values)

    asked = mail.where(F.col("kind").isin(TABLES, PARENT, STATE))
    mail = written(packed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, MAIL), "seating-mail")
    x = _summed(mail, 5 * n + 6)
    tables, away, word_tables, word_parents = x[: 4 * n].reshape(4, n)
    parent_customers, parent_tables, one, two, parent_one, parent_two = x[4 * n : 4 * n + 6]
    discount = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
    discounts = history[0].discounts if history else (discount(one, two), discount(parent_one, parent_two))
    customers = history[0].customers if history else x[4 * n + 6 :]
    return mail, Totals(customers, tables, parent_customers, parent_tables, discounts, v, word_tables, word_parents, away)


def predictive(b: Bucket, mail: Mail, history: list[Totals], p: Seating) -> np.ndarray:
    """P(word | context) of each of the bucket's pairs, averaged over the sweeps after the burn-in."""
    total = np.zeros(len(b.pairs))
    for k in range(p.burn, len(history)):
        x, (tables, t, s) = history[k], mail.state(k)
        d = x.discounts[0]
        back = p.strengths[0] + d * in_restaurants(b, tables, x.tables)[b.context]
        back *= parent_chance(*mail.parents(t, s, x, k), x, p.strengths[1])[b.word]
        total += (np.maximum(b.c - d * tables, 0) + back) / (p.strengths[0] + in_restaurants(b, b.c, x.customers)[b.context])
    return total / (len(history) - p.burn)


def score_texts(docs: DataFrame, p: Seating = Seating()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Texts whose crc32(doc_id as text) mod 10 is not 0 are learnt from; all are scored. Null and
    empty texts are an end alone. doc_id is a whole number; null ids are learnt from, keep their
    rows, and are told apart by their texts, as are repeated ids; equal rows score alike. Other
    columns are dropped; an empty table gives no rows. Without training texts every word is unknown.
    """
    rows = prepared(docs)
    counts = written(word_counts(rows, p.flush), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    top = counts.orderBy(F.desc("c"), "w").limit(max(p.hot, p.contexts + 1)).toArrow()
    top, top_c = top["w"].to_numpy().view(np.uint64), top["c"].to_numpy()
    hot, frequent = top[: p.hot], np.flatnonzero(top != END)[: p.contexts]
    ends = counts.where(F.col("w") == int(END.view(np.int64))).first()
    buckets = max(p.least_buckets, n // p.bucket_tokens)  # by the data alone, as two buckets may write to each other
    places = Places(hot, top[frequent], np.append(top_c[frequent], ends["c"] if ends else 0).astype(np.int64), buckets)
    n_contexts = places.n + 1
    every = docs.sparkSession.range(buckets).selectExpr("cast(id as int) AS bucket", "cast(null as binary) AS payload")  # none is without a row
    packed = pack(rows, places, p).unionByName(every).repartition(max(tasks(docs), buckets), "bucket").persist(StorageLevel.DISK_ONLY)
    history: list[Totals] = []
    mail, away = introduce(packed, places)
    mails = [mail.where(F.col("kind") == COUNTS)]
    for k in range(p.sweeps + 1):
        mail, x = sweep(packed, mail, away, history, places, v, p)
        away = x.away
        history.append(x)
        if k >= p.burn:
            mails.append(mail.where(F.col("kind").isin(PARENT, STATE)))
    base_of = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    schema = "row long, doc_id long, tie long, w long, known double, base double, score double, scores array<float>"

    def score(table: pa.Table, post: pa.Table) -> pa.Table:
        b = Bucket(table["payload"].to_pylist(), places, table["bucket"][0].as_py())
        mail = Mail(b, post)
        logs, of_word = np.log10(predictive(b, mail, history, p)), mail.counts(places)
        base = base_of(of_word)
        word = b.word[b.token]
        rows, of = np.unique(b.doc, return_inverse=True)
        by = lambda x: np.bincount(of, weights=x, minlength=len(rows))
        # Hot words, a row each: their probabilities in all numbered contexts, which are the word's pairs in order.
        at = places.hot_index(b.words)
        pairs = np.flatnonzero(np.append(at, np.full(n_contexts + len(b.far), -1))[b.word] >= 0)
        hot = np.flatnonzero(at >= 0)
        # Rows of documents with their sums, of those listed here with ids and ties, and of hot words.
        m, o, k = len(rows), len(b.listed), len(hot)
        offsets = np.append(np.zeros(m + o), np.arange(k + 1) * n_contexts).astype(np.int32)
        null = lambda n: pa.nulls(n, pa.int64())
        sums = lambda x, of_hot: pa.array(np.concatenate([by(x), np.zeros(o), of_hot]))
        return pa.table(
            {
                "row": pa.concat_arrays([pa.array(rows), pa.array(b.listed), null(k)]),
                "doc_id": pa.concat_arrays([null(m), pa.array(b.ids), null(k)]),
                "tie": pa.concat_arrays([null(m), pa.array(b.ties), null(k)]),
                "w": pa.concat_arrays([null(m + o), pa.array(at[hot].astype(np.int64))]),
                "known": sums((of_word[word] > 0).astype(float), np.zeros(k)),
                "base": sums(base[word], base[hot]),
                "score": sums(logs[b.token], np.zeros(k)),
                "scores": pa.ListArray.from_arrays(pa.array(offsets), pa.array(logs[pairs].astype(np.float32))),
            }
        )

    asked = reduce(DataFrame.unionByName, mails)
    scored = written(packed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(score, schema), "bucket-scores")
    packed.unpersist()
    got = scored.where("w IS NOT NULL").select("w", "base", "scores").toArrow()  # at most hot rows
    table, hot_base = np.zeros((len(hot), n_contexts), np.float32), np.zeros(len(hot))
    at = got["w"].to_numpy()
    hot_base[at] = got["base"].to_numpy()
    table[at] = got["scores"].combine_chunks().flatten().to_numpy().reshape(-1, n_contexts)
    sent = docs.sparkSession.sparkContext.broadcast((places, table, hot_base))

    def local(batches):
        places, table, hot_base = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out = []
                for text in batch.column(2).to_pylist():
                    w = tokens(text)
                    i, u = places.hot_index(w), places.context_of(w)
                    is_hot = (i >= 0) & (u < n_contexts)
                    out.append((len(w), is_hot.sum(), hot_base[i[is_hot]].sum(), table[i[is_hot], u[is_hot]].sum(dtype=np.float64)))
                a = np.array(out, np.float64)
                ids = batch.column(0).fill_null(NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [ids, batch.column(1), pa.array(np.ones(len(a), np.int64)), *(pa.array(a[:, j]) for j in range(4))],
                    names=["doc_id", "tie", "rows", "tokens", "known", "base", "score"],
                )

    here = rows.select("doc_id", "tie", "text").mapInArrow(
        local, "doc_id long, tie long, rows long, tokens double, known double, base double, score double"
    )
    there = scored.where("w IS NULL").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("tie").alias("tie"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    there = there.select("doc_id", "tie", F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("tokens"), "known", "base", "score")
    sums = here.unionByName(there).groupBy("doc_id", "tie").agg(*[F.sum(c).alias(c) for c in ("rows", "tokens", "known", "base", "score")])
    each = sums.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    each = each.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
    return each.select(
        "doc_id",
        held_out(each).alias("held_out"),
        F.round(F.col("tokens") / F.col("rows")).cast("long").alias("n_tokens"),
        F.round(F.col("known") / F.col("rows")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
