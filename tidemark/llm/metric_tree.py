"""Operator 11: exact top-k by inner product, best first in an M-tree whose pages are Spark rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import extent, first_ranked, integers, lists, matrix, products, usable

TREE = ("pivot int", "shard int")
PAGES = ", ".join((*TREE, "nearest double, farthest double", "root array<bigint>, root_radius double", "centre array<bigint>, radius double, parent_distance double", "ids array<bigint>, members array<bigint>, distances array<double>"))
QUERIES = ", ".join((*TREE, "query_id bigint, q array<bigint>, found array<bigint>, scores array<bigint>"))
FOUND = "query_id bigint, vec_id bigint, score bigint"


class Metric:
    """Distances among rows lifted to one sphere, and the scores that they bound.

    A row x gets one more component, the root of (largest squared norm - |x|^2), and a query gets a
    zero there. Then d(q, x)^2 = |q|^2 + largest - 2 <q, x>: the nearest row has the highest product.
    """

    def __init__(self, largest: float) -> None:
        self.largest = largest

    def lift(self, rows: np.ndarray) -> np.ndarray:
        plain = rows.astype(np.float64)
        return np.hstack([plain, np.sqrt(np.maximum(0.0, self.largest - (plain**2).sum(1)))[:, None]])

    def among(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of lifted rows."""
        return np.sqrt(np.maximum(0.0, (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T))

    def to(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        q = queries.astype(np.float64)
        return np.sqrt(np.maximum(0.0, (q**2).sum(1)[:, None] + self.largest - 2 * q @ rows.T.astype(np.float64)))

    def most(self, queries: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """A score that no row at this distance or beyond passes, rounding included."""
        norm = (queries.astype(np.float64) ** 2).sum(1)[:, None]
        slack = 1.0 + 1e-9 * (norm + self.largest)  # roots of rounded squares err by far less
        return (norm + self.largest - np.maximum(0.0, distance) ** 2) / 2 + slack


def _halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in pages of at most `most`: halved between two far rows again and again."""
    open_, done = [np.arange(len(x))], []
    while open_:
        own = open_.pop()
        if len(own) <= most:
            done.append(own)
            continue
        y = x[own]
        one = y[((y - y[0]) ** 2).sum(1).argmax()]
        other = y[((y - one) ** 2).sum(1).argmax()]
        order = np.argsort(((y - one) ** 2).sum(1) - ((y - other) ** 2).sum(1), kind="stable")
        pages = -(-len(own) // most)
        cut = most * (pages // 2)
        open_ += [own[order[cut:]], own[order[:cut]]]
    return done


def build(table: pa.Table, dim: int, metric: Metric, page: int) -> pa.Table:
    """The pages of one tree. A routing object is the member nearest the mean of its page, or of the tree."""
    rows, ids = matrix(table["ints"], dim), table["vec_id"].to_numpy()
    kept = np.unique(np.column_stack([ids, rows]), axis=0, return_index=True)[1]  # a repeated row counts once
    rows, ids, reach = rows[kept], ids[kept], table["reach"].to_numpy()[kept]
    x = metric.lift(rows)
    middle = lambda y: int(((y - y.mean(0)) ** 2).sum(1).argmin())
    root = middle(x)
    made: dict[str, list] = {k: [] for k in ("nearest", "farthest", "centre", "radius", "parent_distance", "ids", "members", "distances")}
    for own in _halves(x, page):
        centre = own[middle(x[own])]
        distances = metric.among(x[own], x[[centre]])[:, 0]
        values = (reach[own].min(), reach[own].max(), rows[centre], distances.max(), metric.among(x[[root]], x[[centre]])[0, 0], ids[own], rows[own].reshape(-1), distances)
        for column, value in zip(made.values(), values, strict=True):
            column.append(value)
    n = len(made["ids"])
    radius = float(metric.among(x, x[[root]]).max())
    return pa.table(
        {
            **{c: table[c][:1].combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in ("pivot", "shard")},
            "nearest": made["nearest"],
            "farthest": made["farthest"],
            "root": lists(np.repeat(rows[[root]], n, 0)),
            "root_radius": pa.array([radius] * n),
            **{k: lists(np.array(v)) if k == "centre" else pa.array([y.tolist() if isinstance(y, np.ndarray) else y for y in v]) for k, v in made.items() if k not in ("nearest", "farthest")},
        }
    )


class Tree:
    """One tree's pages in memory: root, routing objects of pages, entries with their parent distances."""

    def __init__(self, pages: pa.Table, dim: int) -> None:
        self.root = matrix(pages["root"][:1], dim)
        self.centre = matrix(pages["centre"], dim)
        self.radius, self.parent = pages["radius"].to_numpy(), pages["parent_distance"].to_numpy()
        size = pages["ids"].combine_chunks().value_lengths().to_numpy()
        self.ends = np.cumsum(size)
        self.ids = pages["ids"].combine_chunks().flatten().to_numpy()
        self.rows = pages["members"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        self.distance = pages["distances"].combine_chunks().flatten().to_numpy()

    def search(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
        """The k highest scores of each query that reach its floor, and their ids; unused places hold the least long.

        Pages are visited best first. The distance of a page's routing object is bounded by its stored
        distance to the root before it is computed, an entry's by its stored distance to the routing object.
        """
        low = np.iinfo(np.int64).min
        scores, found = np.full((len(q), k), low), np.zeros((len(q), k), np.int64)
        need = floor.astype(np.float64)
        to_root = metric.to(q, self.root)
        bound = np.abs(to_root - self.parent) - self.radius
        open_ = metric.most(q, bound) >= need[:, None]
        computed = open_.any(0)
        to_page = np.full((len(q), len(self.radius)), np.inf)
        to_page[:, computed] = metric.to(q, self.centre[computed])
        bound = np.where(computed, np.maximum(bound, to_page - self.radius), np.inf)
        order = np.argsort(bound, axis=1, kind="stable")
        most = np.where(np.isinf(bound), -np.inf, metric.most(q, np.where(np.isinf(bound), 0.0, bound)))
        for step in range(order.shape[1]):
            at = order[:, step]
            active = np.flatnonzero(most[np.arange(len(q)), at] >= need)
            if not len(active):
                break
            for p in np.unique(at[active]):
                own = active[at[active] == p]
                first, end = self.ends[p - 1] if p else 0, self.ends[p]
                near = np.abs(to_page[own, p][:, None] - self.distance[first:end])
                entries = first + np.flatnonzero((metric.most(q[own], near) >= need[own][:, None]).any(0))
                if not len(entries):
                    continue
                got = products(q[own], self.rows[entries], metric.largest)
                got[self.ids[entries] == ids[own][:, None]] = low
                hit = (got > low) & (got >= need[own][:, None])
                better = np.flatnonzero(hit.any(1))
                if not len(better):
                    continue
                i, j = np.nonzero(hit[better])
                held_i, held_j = np.nonzero(scores[own[better]] > low)
                key = np.concatenate([i, held_i])
                score = np.concatenate([got[better][i, j], scores[own[better]][held_i, held_j]])
                ident = np.concatenate([self.ids[entries][j], found[own[better]][held_i, held_j]])
                best = first_ranked(key, score, ident, k)
                key = key[best]
                rank = np.arange(len(key)) - np.searchsorted(key, key)
                target = own[better]
                scores[target] = low
                scores[target[key], rank], found[target[key], rank] = score[best], ident[best]
                full = scores[target, k - 1]
                need[target] = np.where(full > low, np.maximum(need[target], full), need[target])
        return scores, found


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, tree_rows: int = 512, page: int = 32, pivots: int = 4096, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each row that `is_query` names.

    Components become floor(scale * x); scores are exact, ties go to the smaller vec_id, and a query
    does not find rows of its own id. Rows that have no id or vector, or a null or non-finite component,
    take no part. Rows alike in id and integers count once; other rows of one id count each, and
    as queries together return the k best of what any of them finds. Shorter vectors are filled with
    zeros. An empty table, or one without queries, gives no rows; other columns are not read.

    Rows go to the nearest of at most `pivots` sampled rows, and a pivot's rows to trees of about
    `tree_rows` by hash, so that no group of copies meets one task. A tree's pages are built by the
    task that holds it and written. A query is first searched in its own tree; with the k-th score
    found there it visits only the trees that its distance to their pivot leaves open, in blocks of
    about `block` queries that are near the same sampled row.
    """
    spark = rows.sparkSession
    valid = rows.where(F.col(vec_id).isNotNull() & usable(vector))
    flagged = valid.select(F.col(vec_id).cast("bigint").alias("vec_id"), integers(vector, scale).alias("ints"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = flagged.drop("asks")
    n, dim, largest = extent(base, "ints")
    dim = max(1, dim)
    metric = Metric(largest)
    sample = base.select("ints").orderBy(F.xxhash64("ints")).limit(2 * min(pivots, -(-n // tree_rows))).collect() if n else []
    distinct = list(dict.fromkeys(tuple(r.ints) + (0,) * (dim - len(r.ints)) for r in sample))
    chosen = np.array(distinct[: max(1, len(sample) // 2)] or [[0] * dim], np.int64)
    lifted = metric.lift(chosen)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d = metric.among(metric.lift(matrix(part["ints"], dim)), lifted)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "ints", "asks", "pivot", "reach"])

    placed = written(flagged.mapInArrow(assign, "vec_id bigint, ints array<bigint>, asks boolean, pivot int, reach double"), "tree-rows")
    shards = {r.pivot: -(-r["count"] // tree_rows) for r in placed.groupBy("pivot").count().collect()}  # at most `pivots` rows
    many = np.array([shards.get(p, 0) for p in range(len(chosen))], np.int64)

    def shard(pivot: Column, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.element_at(F.lit([max(1, int(m)) for m in many]), pivot + 1)).cast("int")

    placed = placed.withColumn("shard", shard(F.col("pivot"), "vec_id", "ints"))
    tree = [F.col("pivot"), F.col("shard")]
    pages = written(placed.groupBy(*tree).applyInArrow(lambda t: build(t, dim, metric, page), PAGES), "tree-pages")
    ring = {r.pivot: (r.nearest, r.farthest) for r in pages.groupBy("pivot").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest")).collect()}

    low = np.iinfo(np.int64).min

    def found_table(ids: np.ndarray, scores: np.ndarray, found: np.ndarray) -> pa.Table:
        i, j = np.nonzero(scores > low)
        return pa.table({"query_id": ids[i], "vec_id": found[i, j], "score": scores[i, j]})

    def home(queries: pa.Table, own: pa.Table) -> pa.Table:
        got = queries.select(["pivot", "shard", "query_id", "q"])
        if not own.num_rows:
            own_scores, own_found = [[]] * len(got), [[]] * len(got)
        else:
            ids = queries["query_id"].to_numpy()
            scores, found = Tree(own, dim).search(ids, matrix(queries["q"], dim), np.full(len(ids), -np.inf), k, metric)
            own_scores = [s[s > low].tolist() for s in scores]
            own_found = [f[s > low].tolist() for s, f in zip(scores, found, strict=True)]
        return got.append_column("found", pa.array(own_found, pa.list_(pa.int64()))).append_column("scores", pa.array(own_scores, pa.list_(pa.int64())))

    asked = placed.where("asks").select("pivot", "shard", F.col("vec_id").alias("query_id"), F.col("ints").alias("q")).distinct()
    queries = written(asked.groupBy("pivot", "shard").cogroup(pages.groupBy("pivot", "shard")).applyInArrow(home, QUERIES), "queries")

    # The other trees, by the stored range of distances of a pivot's rows.
    areas = chosen[: max(1, min(256, len(chosen), -(-queries.count() // block)))]
    rings = np.array([ring.get(p, (np.inf, -np.inf)) for p in range(len(chosen))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                q = matrix(part["q"], dim)
                d = metric.to(q, chosen)
                floor = np.array([s[-1] if len(s) == k else -np.inf for s in part["scores"].to_pylist()], np.float64)
                bound = np.maximum(d - rings[:, 1], rings[:, 0] - d)
                seen = (many > 0) & (metric.most(q, np.where(np.isfinite(bound), bound, 0.0)) >= floor[:, None])
                to = [np.flatnonzero(x).astype(np.int32).tolist() for x in seen]
                area = metric.to(q, areas).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["query_id"], part["q"], part["pivot"], part["shard"], pa.array(floor), pa.array(area), pa.array(to, pa.list_(pa.int32()))], names=["query_id", "q", "own", "own_shard", "floor", "area", "to"])

    routed = queries.mapInArrow(route, "query_id bigint, q array<bigint>, own int, own_shard int, floor double, area int, to array<int>")
    routed = written(routed, "routed")
    blocks = {r.area: -(-r["count"] // block) for r in routed.groupBy("area").count().collect()}  # at most 256 rows
    salts = F.element_at(F.lit([max(1, blocks.get(a, 0)) for a in range(len(areas))]), F.col("area") + 1)
    sent = (
        routed.withColumn("salt", F.pmod(F.xxhash64("query_id", "q"), salts).cast("int"))
        .withColumn("pivot", F.explode("to"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(F.lit([int(m) for m in many]), F.col("pivot") + 1).cast("int") - 1)))
        .where(~((F.col("pivot") == F.col("own")) & (F.col("shard") == F.col("own_shard"))))
        .select("pivot", "shard", "area", "salt", "query_id", "q", "floor")
    )
    unit = ("pivot", "shard", "area", "salt")
    units = sent.select(*[F.col(c).alias(c) for c in unit]).distinct()  # new columns, as the parts meet again below
    shipped = pages.select("pivot", "shard", "root", "centre", "radius", "parent_distance", "ids", "members", "distances").join(units, ["pivot", "shard"])

    def visit(asking: pa.Table, own: pa.Table) -> pa.Table:
        if not asking.num_rows or not own.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids = asking["query_id"].to_numpy()
        return found_table(ids, *Tree(own, dim).search(ids, matrix(asking["q"], dim), asking["floor"].to_numpy(), k, metric))

    elsewhere = sent.groupBy(*unit).cogroup(shipped.groupBy(*unit)).applyInArrow(visit, FOUND)
    at_home = queries.select("query_id", F.inline(F.arrays_zip("found", "scores")).alias("vec_id", "score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = at_home.unionByName(elsewhere).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op11_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(50)) == 0)


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.ints AS DOUBLE[]), CAST(c.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
