"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_text, mix, word_hashes


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: per-coordinate rates; l1, l2: penalties; bits: of the hash space.

    l1 holds at any number of rows: a slot counts once its gradients add up to it, that is after some
    six toxic texts, however few rows there are; a lower one learns the accidents of small samples.

    The fit reads at most `most_rows` labelled rows, those with the lowest hash of doc_id: a bound
    on the sample, which is the size of one task's work at any corpus size.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 3
    most_rows: int = 12_000




def features(text: str, bits: int) -> np.ndarray:
    """Distinct hash slots of a text's words, pairs of neighbours and pairs with one word between.

    Slot 0 is the bias, which every text has.
    """
    ws = re.findall(r"[\w']+", text.lower())
    h = word_hashes([w.encode() for w in ws])
    grams = [h]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) > gap:
            grams.append(mix(h[:-gap] * np.uint64(salt) + h[gap:]))
    slots = np.concatenate(grams) >> np.uint64(64 - bits)
    return np.append(np.unique(slots[slots > 0]).astype(np.int64), 0)


def fit(rows: list[tuple[str, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that are not zero, learnt by passing over `rows` in the order given."""
    z, n, l1 = np.zeros(1 << p.bits), np.zeros(1 << p.bits), p.l1

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    prepared = [(features(text, p.bits), y) for text, y in rows]
    for _ in range(p.epochs):
        for x, y in prepared:
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / p.alpha
            z[x], n[x] = zx + g - sigma * w, nx + g * g
    w = weights(z, n)
    slots = np.flatnonzero(w)
    return slots, w[slots]


def learning_rows(docs: DataFrame, labels: DataFrame, p: Ftrl) -> DataFrame:
    """text, toxic of the labelled rows to learn from: crc32(doc_id as text) mod 4 is not 2.

    Null labels and null ids are left out; of repeated labels of a document the largest holds.
    """
    learnt = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    order = F.xxhash64("doc_id")
    chosen = learnt.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(p.most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic", F.lit(0).alias("all"))


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """The sparse weights, fitted in one task over the bounded sample. Without rows: none at all."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=[hash_order(x) for x in pdf["doc_id"]]).sort_values(["h", "text"], kind="stable")
        slots, w = fit(list(zip(pdf["text"].fillna(""), pdf["toxic"], strict=True)), p)
        return pd.DataFrame({"slot": slots, "weight": w})

    fitted = learning_rows(docs, labels, p).groupBy("all").applyInPandas(run, "slot long, weight double")
    rows = fitted.collect()  # at most 2**bits, in practice the few that L1 leaves
    return np.array([r["slot"] for r in rows], np.int64), np.array([r["weight"] for r in rows])


def hash_order(x: object) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(repr(x).encode())


def score_toxicity(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from the whole text alone.

    Null and empty texts score by the bias. A null doc_id is never held out. Repeated rows stay.
    Without any weight, as nothing was learnt, every score is 0: nothing is called toxic.
    The broadcast weights are bounded by 2**bits and L1-sparse.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def compute(texts: list[str]) -> dict[str, object]:
        dense = np.zeros(1 << bits)
        dense[sent.value[0]] = sent.value[1]
        s = np.array([dense[features(x, bits)].sum() for x in texts])
        score = 1 / (1 + np.exp(-np.clip(s, -35, 35))) if len(sent.value[0]) else np.zeros(len(texts))
        return {"score": score, "predicted": (score >= threshold).astype(np.int32)}

    scored = map_text(docs, compute, [("score", T.DoubleType()), ("predicted", T.IntegerType())])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = documents(spark, sf_dir), Ftrl()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_toxicity(docs, train(docs, labels, p), p.bits)
