"""Anchors by the syncmer rule itself, and the Pitman-Yor score where the seating leaves no choice."""

import functools
import itertools
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, seating


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashed(*values) -> int:
    """The engine's 64-bit hash of longs or one string, each hash the seed of the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def anchors(text: str, k: int, s: int) -> list[int]:
    """Windows of k pieces whose least inner window of s pieces stands first or last, each hash at its first place."""
    h = [hashed(w) for w in re.findall("[^\\x20\\x09-\\x0D]{1,32}", text)]
    mask, found = (1 << 24) - 1, {}
    for i in range(len(h) - k + 1):
        inner = [functools.reduce(hashed, h[i + j : i + j + s]) for j in range(k - s + 1)]  # two at a time
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(hashed(*h[i : i + k]) >> 24, i)
    if not found:
        seed = 42
        for x in h:
            seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return [signed(seed) & ~mask]
    return sorted((v << 24) | i for v, i in found.items())


@pytest.mark.parametrize("k,s", [(5, 2), (4, 2), (6, 3)])
def test_anchors_are_the_closed_syncmers(spark, k, s):
    r = random.Random(k)
    texts = [" ".join(r.choices([f"w{i}" for i in range(n)], k=m)) for n, m in itertools.product((2, 5, 400), (0, 3, 5, 6, 40, 400))]
    texts += ["x" * 200, "é ☃ \n\t 𝄞 a b c d e f", " ".join(["same"] * 50), "a b c d e f g h " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x["i"]: x["sketch"] for x in fingerprints.add_sketch(df, "text", "sketch", k, s).collect()}
    for i, text in enumerate(texts):
        assert got[i] == anchors(text, k, s), text[:40]


def test_equal_passages_share_their_inner_anchors(spark):
    r = random.Random(1)
    words = lambda n: " ".join(f"v{r.random()}" for _ in range(n))
    passage = words(60)
    df = spark.createDataFrame([(0, words(33) + " " + passage), (1, passage + " " + words(9))], "i int, text string")
    a, b = (set(x >> 24 for x in row["sketch"]) for row in fingerprints.add_sketch(df, "text", "sketch").orderBy("i").collect())
    own = set(x >> 24 for x in anchors(passage, 5, 2))
    assert len(own) > 10 and own <= a & b


def test_score_equals_the_closed_form_of_a_forced_seating(spark):
    """One training text of words that differ: every entry has one customer at one table, in every draw."""
    check_forced_seating(spark, seating.Seating(least_buckets=3))


@pytest.mark.parametrize("contexts, hot", [(0, 0), (0, 3), (1, 64), (2, 1)])
def test_every_word_before_has_its_restaurant(spark, contexts, hot):
    """Words beyond the frequent ones once shared one restaurant."""
    check_forced_seating(spark, seating.Seating(contexts=contexts, hot=hot, least_buckets=3))


def check_forced_seating(spark, p):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    learnt = next(i for i in range(100) if not held(i))
    asked = [i for i in range(2000) if held(i)][:3]
    words = ["a", "B", "c", "d", "e"]
    texts = ["a b x c", "", "E D c b a y z"]
    rows = [(learnt, " ".join(words)), *zip(asked, texts, strict=True)]
    got = {r["doc_id"]: r for r in seating.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    v, d = len(words) + 1, 0.95  # with the end; no entry has two customers, so that the discounts meet their bound
    follows = dict(zip([None, *map(str.lower, words)], [*map(str.lower, words), "</s>"], strict=True))

    def parent(w: str) -> float:
        there = w in follows.values()
        return ((1 - d if there else 0) + (1 + d * v) / (v + 1)) / (1 + v)

    def chance(before: str | None, w: str) -> float:
        if before not in follows:
            return parent(w)  # a restaurant without customers
        return ((1 - d if follows[before] == w else 0) + (1 + d) * parent(w)) / 2

    for i, text in zip(asked, texts, strict=True):
        line = [None, *text.lower().split(), "</s>"]
        assert got[i]["held_out"] and got[i]["n_tokens"] == len(line) - 1 and got[i]["train_tokens"] == v
        assert got[i]["score"] == pytest.approx(sum(math.log10(chance(a, b)) for a, b in itertools.pairwise(line)), abs=1e-4)


def test_rare_restaurants_are_seated_as_global_ones(spark):
    """Where a restaurant is kept changes how its numbers travel, not the model."""
    rng = random.Random(4)
    follow = {w: [rng.randrange(60) for _ in range(4)] for w in range(60)}
    texts = []
    for _ in range(400):
        w, text = rng.randrange(60), []
        for _ in range(30):
            text.append(f"w{w}")
            w = rng.choice(follow[w]) if rng.random() < 0.8 else int(rng.expovariate(0.1)) % 60
        texts.append(" ".join(text))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"new{i} w1 new{i}") for i in range(20)], "doc_id long, text string")
    score = lambda **k: {r["doc_id"]: r for r in seating.score_texts(docs, seating.Seating(least_buckets=5, sweeps=6, **k)).collect()}
    whole = score(contexts=1000, hot=64)
    for p in ({"contexts": 0, "hot": 0}, {"contexts": 20, "hot": 5}, {"contexts": 5, "hot": 10}):
        got = score(**p)
        assert got.keys() == whole.keys()
        for i, r in got.items():
            w = whole[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (w["n_tokens"], w["n_known"], w["train_tokens"], w["held_out"])
            assert r["base_score"] == pytest.approx(w["base_score"])
            assert r["score"] / r["n_tokens"] == pytest.approx(w["score"] / w["n_tokens"], abs=0.04)
        mean = lambda x: sum(r["score"] for r in x.values()) / sum(r["n_tokens"] for r in x.values())
        assert mean(got) == pytest.approx(mean(whole), abs=0.005)
