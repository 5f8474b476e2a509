"""Operator 13: hard negatives by threshold joins over an inverted index with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import extent, first_ranked, integers, lists, matrix, usable

BLOCKS = "block int, ids array<bigint>, labels array<bigint>, asks array<boolean>, cuts array<bigint>, members array<bigint>"
ANCHORS = "anchor_id bigint, label bigint, q array<bigint>, tags array<bigint>, tops array<bigint>, floors array<bigint>"
FOUND = "anchor_id bigint, tag bigint, top bigint, vec_id bigint, score bigint"
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Index:
    """The inverted index of one block of rows.

    Components stand in one order for the whole table, the heaviest first. A row's last components,
    from its cut on, are in no posting list: their norm times the largest norm stays below the
    threshold of the index. Rows stand by falling cut, so that a component's posting list is the
    rows before a place, and its values lie side by side.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cuts: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.labels, self.cuts, self.rows = ids, labels, cuts, rows
        self.plain = rows.astype(np.float64)
        self.suffix = suffix_norms(self.plain)

    def bounds(self, q: np.ndarray, need: np.ndarray, step: int = 8) -> np.ndarray:
        """A bound on every score, at least the score itself where that may reach `need` (one per query).

        Partial scores are accumulated component by component; a pair whose partial score and remaining
        norms cannot reach the need is left at minus infinity, and a row or query without pairs drops out.
        """
        x, own = q.astype(np.float64), suffix_norms(q.astype(np.float64))
        dim = x.shape[1]
        out = np.full((len(x), len(self.ids)), -np.inf)
        asking, open_ = np.arange(len(x)), np.arange(len(self.ids))
        partial = np.zeros((len(x), len(open_)))
        for at in range(0, dim + step, step):
            # Here `at` components are done: what is left of a row starts there or at its cut, if that is less.
            rest = own[asking][:, np.minimum(at, self.cuts[open_])] * self.suffix[open_, np.minimum(at, self.cuts[open_])]
            most = partial + rest + 1e-9 * own[asking][:, :1] * self.suffix[open_, 0]  # rounding included
            alive = most >= need[asking][:, None]
            done = np.flatnonzero(self.cuts[open_] <= at)
            if len(done):
                out[np.ix_(asking, open_[done])] = np.where(alive[:, done], most[:, done], -np.inf)
            going = np.flatnonzero((self.cuts[open_] > at) & alive.any(0))
            still = np.flatnonzero(alive[:, going].any(1)) if len(going) else going
            if not len(still):
                break
            partial = np.where(alive, partial, -np.inf)[np.ix_(still, going)]
            asking, open_ = asking[still], open_[going]
            end = np.minimum(at + step, self.cuts[open_])
            posted = np.where(np.arange(at, min(at + step, dim)) < end[:, None], self.plain[open_, at : at + step], 0.0)
            partial = partial + x[asking, at : at + step] @ posted.T
        return out

    def exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of the pairs (query i, row j)."""
        got = np.empty(len(i), np.int64)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            got[part] = np.einsum("ij,ij->i", q[i[part]], self.rows[j[part]])
        return got

    def fill(self, anchor: pa.Table, dim: int, alike: bool, k: int, levels: int) -> pa.Table:
        """The first k rows of each window of each anchor: of its label (`alike`) or of others, by falling score.

        A window takes scores from its floor to its top. The threshold starts at the highest bound and is
        lowered level by level; pairs that its bound reaches are scored, until k rows at or above the
        threshold lie in the window or the threshold is at the window's floor.
        """
        ids, label, q = anchor["anchor_id"].to_numpy(), anchor["label"].to_numpy(), matrix(anchor["q"], dim)
        size = anchor["tags"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(ids)), size)  # the anchor of each window
        tag, top, floor = (anchor[c].combine_chunks().flatten().to_numpy() for c in ("tags", "tops", "floors"))
        none = pa.table({"anchor_id": ids[:0], "tag": ids[:0], "top": ids[:0], "vec_id": ids[:0], "score": ids[:0]})
        if not len(of) or not len(self.ids):
            return none
        least = np.full(len(ids), np.inf)
        np.minimum.at(least, of, np.where(floor == LOW, -np.inf, floor.astype(np.float64)))
        bound = self.bounds(q, least)
        takes = (self.labels == label[:, None]) if alike else (self.labels != label[:, None])
        bound[~takes | (self.ids == ids[:, None])] = -np.inf
        start = bound.max(1)
        bottom = np.where(np.isfinite(least), least, np.where(np.isfinite(bound), bound, np.inf).min(1))
        filled = np.zeros(len(of), bool)
        scored = np.zeros(bound.shape, bool)
        anchors, places, scores = ids[:0], ids[:0], ids[:0]
        for level in range(1, levels + 1):
            open_ = np.zeros(len(ids), bool)
            open_[of[~filled]] = True
            open_ &= np.isfinite(start)
            if not open_.any():
                break
            falls = bottom if level == levels else start + (bottom - start) * (level / levels) ** 2
            threshold = np.where(open_, falls, np.inf)
            new = (bound >= threshold[:, None]) & ~scored & np.isfinite(bound)
            scored |= new
            i, j = np.nonzero(new)
            anchors, places, scores = np.concatenate([anchors, i]), np.concatenate([places, j]), np.concatenate([scores, self.exact(q, i, j)])
            window, pair = meet(anchors, scores, of, floor, top)
            filled |= np.bincount(window[scores[pair] >= threshold[of[window]]], minlength=len(of)) >= k
        window, pair = meet(anchors, scores, of, floor, top)
        best = first_ranked(window, scores[pair], self.ids[places[pair]], k)
        window, pair = window[best], pair[best]
        return pa.table({"anchor_id": ids[of[window]], "tag": tag[window], "top": top[window], "vec_id": self.ids[places[pair]], "score": scores[pair]})


def meet(anchors: np.ndarray, scores: np.ndarray, of: np.ndarray, floor: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows, by number, and the scored pairs of their anchors (`of`) that lie between floor and top."""
    order = np.argsort(anchors, kind="stable")
    n = int(max(of.max(), anchors.max(initial=0))) + 1
    per = np.bincount(anchors, minlength=n)
    first, many = (np.cumsum(per) - per)[of], per[of]
    window = np.repeat(np.arange(len(of)), many)
    pair = order[np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)]
    inside = (scores[pair] >= floor[window]) & (scores[pair] <= top[window])
    return window[inside], pair[inside]


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """The norm of each row from each place on; one more place for the empty rest."""
    squares = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([squares, np.zeros((len(x), 1))]))


def index_block(table: pa.Table, order: np.ndarray, largest: float, share: float) -> pa.Table:
    """One row of BLOCKS: a block's rows with their components in `order`; of rows of one id the least counts."""
    ids, labels, rows = table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["ints"], len(order))
    kept = np.lexsort((*rows.T[::-1], labels, ids))
    kept = kept[np.concatenate([[True], ids[kept][1:] != ids[kept][:-1]])]
    ids, labels, rows, asks = ids[kept], labels[kept], rows[kept][:, order], table["asks"].to_numpy(zero_copy_only=False)[kept]
    cuts = (suffix_norms(rows.astype(np.float64))[:, :-1] * np.sqrt(largest) >= share * largest).sum(1)
    by = np.argsort(-cuts, kind="stable")
    return pa.table({"block": table["block"][:1], "ids": lists(ids[by][None]), "labels": lists(labels[by][None]), "asks": pa.array([asks[by].tolist()]), "cuts": lists(cuts[by][None].astype(np.int64)), "members": lists(rows[by].reshape(1, -1))})


def index_of(block: pa.Table, dim: int) -> Index:
    ids, labels, cuts, members = (block[c].combine_chunks().flatten().to_numpy() for c in ("ids", "labels", "cuts", "members"))
    return Index(ids, labels, cuts, members.reshape(-1, dim))


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    label: Column,
    k: int = 5,
    positives: int = 5,
    least: tuple[int, int] = (4, 5),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    block: int = 512,
    share: float = 0.25,
    levels: int = 6,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the exact inner product with the anchor, ties go to
    the smaller id. An anchor's positives are its first `positives` other rows of its label. For each the
    first `k` rows of another label whose score is at most the positive's and at least `least` of it (a
    quotient) are returned; a negative score leaves no such window. Rows without id, label or vector, or with a null or
    non-finite component, take no part; of several rows of one id the least by label and vector counts;
    shorter vectors are filled with zeros. An empty table gives no rows; other columns are not read.

    Rows are dealt to blocks of about `block` by a hash of their id, whatever their label, so that no
    label meets one task. A block's inverted index (`Index`; threshold: `share` of the largest squared
    norm) is built once and written. Anchors first fill a window in their own block, whose k-th score
    is the floor of the search for positives in all blocks; negatives have their windows as floors.
    Blocks of anchors meet blocks of rows, and send the first k of each window only.
    """
    spark = rows.sparkSession
    valid = rows.where(F.col(vec_id).isNotNull() & usable(vector) & label.isNotNull())
    base = valid.select(F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), integers(vector, scale).alias("ints"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    n, dim, largest = extent(base, "ints")
    dim = max(1, dim)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for b in batches:
            total += (matrix(b["ints"], dim).astype(np.float64) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["place", "weight"])

    weights = base.select("ints").mapInArrow(weigh, "place bigint, weight double").groupBy("place").agg(F.sum("weight").alias("weight")).collect()
    order = np.array([r.place for r in sorted(weights, key=lambda r: (-r.weight, r.place))] or [0])
    many = max(1, -(-n // block))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int"))
    blocks = written(dealt.groupBy("block").applyInArrow(lambda t: index_block(t, order, largest, share), BLOCKS), "negative-blocks")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                own = pa.table(b.slice(at, 1))
                index, asks = index_of(own, dim), own["asks"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                m = int(asks.sum())
                one = lambda x: pa.array([[x]] * m, pa.list_(pa.int64()))  # noqa: E731, B023
                anchor = pa.table({"anchor_id": index.ids[asks], "label": index.labels[asks], "q": lists(index.rows[asks]), "tags": one(0), "tops": one(HIGH), "floors": one(LOW)})
                found = index.fill(anchor, dim, True, positives, levels)
                to, score = found["anchor_id"].to_numpy(), found["score"].to_numpy()
                floor = [[int(s.min())] if len(s := score[to == i]) == positives else [LOW] for i in index.ids[asks].tolist()]
                anchor = anchor.set_column(5, "floors", pa.array(floor, pa.list_(pa.int64())))
                yield from anchor.to_batches()

    anchors = written(blocks.mapInArrow(home, ANCHORS), "anchors")
    parts = max(1, -(-anchors.count() // block))
    unit = ("block", "part")

    def first(asking: DataFrame, alike: bool, k: int) -> DataFrame:
        """The first k rows of each window of each anchor over all blocks, with their rank."""

        def visit(anchor: pa.Table, own: pa.Table) -> pa.Table:
            if not anchor.num_rows or not own.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "tag", "top", "vec_id", "score")})
            return index_of(own, dim).fill(anchor, dim, alike, k, levels)

        sent = asking.withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        shipped = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        found = sent.groupBy(*unit).cogroup(shipped.groupBy(*unit)).applyInArrow(visit, FOUND)
        place = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    near = written(first(anchors, True, positives), "positives")
    num, den = least
    floor = F.expr(f"(score * {num} + pmod(-score * {num}, {den})) div {den}")  # rounded up
    windows = (
        near.withColumn("floor", floor)
        .where("floor <= score")
        .groupBy("anchor_id")
        .agg(F.collect_list(F.struct("vec_id", "score", "floor")).alias("w"))  # at most `positives` each
        .select("anchor_id", F.col("w.vec_id").alias("tags"), F.col("w.score").alias("tops"), F.col("w.floor").alias("floors"))
    )
    asking = anchors.select("anchor_id", "label", "q").join(windows, "anchor_id")
    return first(asking, False, k).select("anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(100)) == 0, noisy)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS vec_id, a.label = o.label AS alike,
    CAST(list_inner_product(a.ints, o.ints) AS BIGINT) AS score
  FROM v a JOIN v o ON o.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
