"""Operators 11 and 13 against plain loops, on odd rows, ties, copies and clustered vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.hard_negatives import Index, hard_negatives, suffix_norms
from tidemark.llm.metric_tree import Metric, Tree, build, exact_top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, ints string, score int, pivot int, block int, q int"


def table(spark, seed: int, n: int, dim: int, kind: str):
    """Rows with nulls, bad components, repeated rows, repeated ids, short vectors and clashing columns."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        if kind == "copies" and i % 3:
            v = [0.25] * dim
        elif kind == "clusters":
            v = [c + r.gauss(0, 0.05) for c in centres[i % 4]]
        else:
            v = [r.gauss(0, 1) for _ in range(dim)]
        rows.append([i, v, r.choice([None, 0, 1, 1, 1, 2])])
    rows += [[n, None, 1], [None, [1.0] * dim, 1], [n + 1, [1.0, None], 1], [n + 2, [float("nan")], 1], [n + 3, [float("-inf")] * dim, 1]]
    rows += [[n + 4, [], 1], [n + 5, [9.0], 1], [-50, [3.0] * dim, 1], [-100, [0.0] * dim, 1]] + [list(rows[0]), list(rows[5]), list(rows[5])]
    r.shuffle(rows)
    return rows, spark.createDataFrame([(*x, "x", 1, 2, 3, 4) for x in rows], SCHEMA).repartition(3)


def whole(rows):
    return [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label) for i, v, label in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


@pytest.mark.parametrize("kind,step,tree_rows,page,block", [("random", 50, 512, 32, 512), ("copies", 5, 20, 4, 3), ("clusters", 5, 30, 5, 512)])
def test_top_k_equals_a_plain_loop(spark, kind, step, tree_rows, page, block):
    rows, df = table(spark, 7, 230, 6, kind)
    got = exact_top_k(df, F.pmod("vec_id", F.lit(step)) == 0, tree_rows=tree_rows, page=page, block=block).collect()
    v = sorted({(i, x) for i, x, _ in whole(rows)})
    want = []
    for i in sorted({i for i, _ in v if i % step == 0}):
        best = sorted((-product(x, y), j) for a, x in v if a == i for j, y in v if j != i)[:5]
        want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == want


def test_top_k_of_few_rows_large_numbers_and_none(spark):
    asks = F.pmod("vec_id", F.lit(50)) == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0]), (50, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert sorted(map(tuple, exact_top_k(few, asks).collect())) == [(0, 1, 3, 2 * 65536), (0, 2, 50, 2 * 65536), (50, 1, 0, 2 * 65536), (50, 2, 3, 0)]
    assert exact_top_k(few.where("vec_id < 0"), asks).count() == 0
    assert exact_top_k(few.where("vec_id = 3"), asks).count() == 0
    assert exact_top_k(few.where("vec_id = 0"), asks).count() == 0
    large = spark.createDataFrame([(0, [2.0**22, 1.0]), (1, [2.0**22, -1.0]), (2, [2.0**22, 2.0])], "vec_id int, embedding array<double>")
    assert [r.score for r in sorted(exact_top_k(large, asks).collect())] == [2**60 + 2 * 65536, 2**60 - 65536]
    with pytest.raises(ValueError, match="fit a long"):
        exact_top_k(few.withColumn("embedding", F.array(F.lit(1e30))), asks)


def test_tree_bounds_hold_and_save_work():
    r = np.random.default_rng(3)
    rows = (r.normal(size=(300, 5)) + 6 * r.integers(0, 4, (300, 1)) * np.eye(5)[r.integers(0, 5, 300)]) * 100
    rows = rows.astype(np.int64)
    metric = Metric(float((rows**2).sum(1).max()))
    t = pa.table({"pivot": pa.array([0] * 300, pa.int32()), "shard": pa.array([0] * 300, pa.int32()), "vec_id": np.arange(300), "ints": pa.array(rows.tolist()), "reach": np.ones(300)})
    pages = build(t, 5, metric, 16)
    assert max(map(len, pages["ids"].to_pylist())) <= 16 and sorted(x for y in pages["ids"].to_pylist() for x in y) == list(range(300))
    for p in pages.to_pylist():
        x = metric.lift(np.array(p["members"]).reshape(-1, 5))
        d = metric.among(x, metric.lift(np.array([p["centre"]])))[:, 0]
        assert np.allclose(d, p["distances"]) and d.max() <= p["radius"] + 1e-6
    tree, looked = Tree(pages, 5), []
    plain = tree.rows
    tree.rows = type("Seen", (), {"__getitem__": lambda s, i: (looked.append(len(i)), plain[i])[1]})()
    scores, found = tree.search(np.arange(20), rows[:20], np.full(20, -np.inf), 3, metric)
    for i in range(20):
        best = sorted((-int(rows[i] @ rows[j]), j) for j in range(300) if j != i)[:3]
        assert best == [(-s, f) for s, f in zip(scores[i].tolist(), found[i].tolist(), strict=True)]
    assert sum(looked) < 0.8 * 300 * len(pages)  # fewer entries are met than pages times queries would have


@pytest.mark.parametrize("kind,step,block", [("random", 10, 512), ("copies", 7, 16), ("clusters", 10, 25)])
def test_negatives_equal_a_plain_loop(spark, kind, step, block):
    rows, df = table(spark, 11, 230, 6, kind)
    got = hard_negatives(df, F.pmod("vec_id", F.lit(step)) == 0, F.col("label"), block=block).collect()
    best = {}
    for i, x, label in whole(rows):
        if label is not None:
            best[i] = min(best.get(i, (label, x)), (label, x)) if i in best else (label, x)
    want = []
    for a, (label, x) in sorted(best.items()):
        if a % step:
            continue
        scored = sorted((-product(x, y), j, other) for j, (other, y) in best.items() if j != a)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            inside = [(n, j) for n, j, other in scored if other != label and -80 * s <= -100 * n <= -100 * s]
            want += [(a, p, rank + 1, j, -s, -n) for rank, (n, j) in enumerate(inside[:5])]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_negatives_of_empty_tables_and_one_label(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (100, [-1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    asks = F.pmod("vec_id", F.lit(100)) == 0
    assert hard_negatives(df, asks, F.col("label")).count() == 0
    assert hard_negatives(df.where("vec_id > 999"), asks, F.col("label")).count() == 0


def test_index_bounds_hold_and_prune():
    r = np.random.default_rng(5)
    rows = (r.normal(size=(200, 24)) * np.linspace(200, 5, 24)).astype(np.int64)
    norms = suffix_norms(rows.astype(float))
    cuts = (norms[:, :-1] * norms.max() >= 0.3 * norms.max() ** 2).sum(1)
    by = np.argsort(-cuts, kind="stable")
    index = Index(np.arange(200), np.zeros(200, np.int64), cuts[by], rows[by])
    assert (cuts < 24).any()
    need = np.full(30, 0.3 * norms.max() ** 2)
    bound, score = index.bounds(rows[:30], need), rows[:30] @ rows[by].T
    assert (bound[score >= need[:, None]] >= score[score >= need[:, None]]).all()
    assert np.isfinite(bound).mean() < 0.5
