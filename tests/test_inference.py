"""p-values against published values and direct counts; quantiles and ranks against numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, market, regression, stats


@pytest.mark.parametrize("t, freedom, p", [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (2.749996, 30, 0.01), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)])
def test_t_tail(t, freedom, p):
    assert inference.t_tail(t, freedom) == pytest.approx(p, abs=1e-6) and inference.t_tail(-t, freedom) == pytest.approx(p, abs=1e-6)


def test_sign_and_rank_tails_count_all_outcomes():
    for n in range(1, 9):
        for k in range(n + 1):
            ways = [math.comb(n, i) / 2**n for i in range(n + 1)]
            assert inference.sign_tail(k, n) == pytest.approx(min(1, sum(w for w in ways if w <= ways[k] * (1 + 1e-9))))
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            far = abs(w - n * (n + 1) / 4)
            assert inference.signed_rank_tail(w, n, 0, True) == pytest.approx(min(1, sum(abs(s - n * (n + 1) / 4) >= far - 1e-9 for s in sums) / 2**n))
    assert inference.signed_rank_tail(700.0, 60, 0, False) == pytest.approx(math.erfc(abs(700 - 915) / math.sqrt(60 * 61 * 121 / 24) / math.sqrt(2)))


def test_mean_tests(spark):
    g = np.random.default_rng(3)
    x, s = g.normal(0.3, 1, 40), g.normal(0.2, 1, 40)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, s)] + [(None, None, 1.0)] * 3, "x double, s double, few double")
    (r,) = inference.mean_tests(df, {"X": "x", "few": "few"}, {"X": "s"}).collect()
    t = x.mean() / (x.std(ddof=1) / math.sqrt(40))
    assert (r["n"], r["label"]) == (40, "X") and r["t"] == pytest.approx(t) and r["median_pct"] == pytest.approx(100 * np.median(x))
    assert r["t_bmp"] == pytest.approx(s.mean() / (s.std(ddof=1) / math.sqrt(40))) and r["p_t"] == pytest.approx(inference.t_tail(t, 39))
    rank = np.abs(x).argsort().argsort() + 1
    assert r["p_wilcoxon"] == pytest.approx(inference.signed_rank_tail(float(rank[x > 0].sum()), 40, 0, True))
    assert r["p_sign"] == pytest.approx(inference.sign_tail(int((x > 0).sum()), 40))


def test_ranks_with_ties(spark):
    v = [1.0, 2.0, 2.0, 2.0, 5.0, None, 0.0, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v double")
    got = {r["id"]: r["rank"] for r in stats.average_ranks(df, "v").collect()}
    assert got == {0: 3.0, 1: 5.0, 2: 5.0, 3: 5.0, 4: 7.0, 6: 1.5, 7: 1.5}


def test_average_ranks_of_a_crowded_value_are_broadcast(spark):
    v = [0.0] * 1800 + [float(i) for i in range(1, 201)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v double").repartition(4)
    ranked = stats.average_ranks(df, "v")
    got = {r["id"]: r["rank"] for r in ranked.collect()}
    assert got[0] == got[1799] == 900.5 and got[1999] == 2000.0 and len(got) == 2000
    assert "BroadcastHashJoin" in ranked._jdf.queryExecution().executedPlan().toString()


def test_quantiles_equal_numpy(spark):
    g = np.random.default_rng(1)
    a, b = np.round(g.normal(size=700), 2), np.where(g.random(700) < 0.8, 0.0, g.normal(size=700))
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, float("nan"), None)], "a double, b double, none double")
    q = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = stats.quantiles_of(df, ["a", "b", "none"], q)
    assert np.allclose(got["a"], np.quantile(a, q)) and np.allclose(got["b"], np.quantile(b, q)) and got["none"] == [None] * 6
    w = stats.winsorize(df, "a").where("a IS NOT NULL").agg(F.min("a"), F.max("a")).first()
    assert np.allclose(list(w), np.quantile(a, [0.01, 0.99]))


def test_ranks_of_a_crowded_value(spark):
    rows = [(i, 0.0 if i % 5 else float(i % 11) - 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    got = {r["id"]: r["rank"] for r in stats.ranked(df, ["v", "id"], "v", 16).collect()}
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert got == want


def test_welch(spark):
    g = np.random.default_rng(2)
    a, b = g.normal(0, 1, 30), g.normal(0.5, 2, 45)
    df = spark.createDataFrame([(1, float(x)) for x in a] + [(3, float(x)) for x in b] + [(2, 1.0), (1, None)], "k int, v double")
    (r,) = inference.welch(df, "v", "k", 1, 3).collect()
    ea, eb = a.var(ddof=1) / 30, b.var(ddof=1) / 45
    assert r["n"] == 75 and r["t"] == pytest.approx((b.mean() - a.mean()) / math.sqrt(ea + eb))
    assert r["freedom"] == pytest.approx((ea + eb) ** 2 / (ea**2 / 29 + eb**2 / 44))
    assert inference.welch(df, "v", "k", 1, 9).count() == 0


def _panel(spark, n=300):
    g = np.random.default_rng(8)
    x, k, firm = g.normal(1000, 1, n), g.integers(0, 9, n), g.integers(0, 40, n)
    y = 5000 + 0.4 * x + 0.3 * firm + g.normal(size=n)
    rows = [(float(a), float(b), int(c), int(f), None) for a, b, c, f in zip(y, x, k, firm)]
    return spark.createDataFrame(rows, "y double, x double, k int, firm int, empty double"), y, x, firm


def test_absorbed_effect_equals_dummies(spark):
    df, y, x, firm = _panel(spark)
    few = {r["term"]: r for r in regression.clustered(df, "y", ["x"], "k", ["firm"]).collect()}
    many = {r["term"]: r for r in regression.clustered(df, "y", ["x"], "k", absorbed="firm").collect()}
    assert few["x"]["coef"] == pytest.approx(many["x"]["coef"]) and few["x"]["se"] == pytest.approx(many["x"]["se"])
    design = np.column_stack([np.ones(len(y)), x, *[(firm == f).astype(float) for f in range(1, 40)]])
    assert few["x"]["coef"] == pytest.approx(np.linalg.lstsq(design, y, rcond=None)[0][1])


def test_models_cells_and_samples(spark):
    df, *_ = _panel(spark)
    df = df.withColumn("x_z", F.col("x") - 1000)
    specs = {"M1": ("y", ["x_z"]), "M2": ("y", ["no_such"]), "M3": ("empty", ["x_z"])}
    f = inference.models(df, specs, "k", least=30).persist()
    assert {r["model"] for r in f.collect()} == {"M1"}
    b = f.where("term = 'x_z'").first()
    got = {(r["model"], r["term"]): r["cell"] for r in inference.cells(f).collect()}
    star = "***" if b["p"] < 0.01 else "**" if b["p"] < 0.05 else "*" if b["p"] < 0.1 else ""
    assert got["M1", "x_z"] == f"{b['coef']:.4f}{star} ({b['se']:.4f})" and got["M1", "N"] == "300" and ("M1", "Adj. R2") in got
    assert inference.magnitudes(f).first()["effect_pct"] == pytest.approx(100 * b["coef"])
    assert inference.corrected(f, 4).first()["alpha"] == pytest.approx(0.0125)
    s = inference.by_sample(df, {"all": F.lit(True), "odd": F.col("k") % 2 == 1}, {"M1": ("y", ["x_z"])}, "k")
    n = {r["sample"]: r["n_obs"] for r in s.where("term = 'x_z'").collect()}
    assert n["all"] == 300 and n["odd"] == df.where("k % 2 = 1").count()
    assert inference.chosen_controls(df, ["x", "empty", "absent"]) == ["x"]


def test_sessions_at_the_calendars_edges(spark):
    cal = spark.createDataFrame([("2020-01-02", 0), ("2020-01-03", 1), ("2020-01-06", 2)], "date string, idx int").withColumn("date", F.to_date("date"))
    rows = [(1, "2015-06-01", False), (2, "2020-01-04", True), (3, "2020-01-06", False), (4, "2020-01-07", False), (5, None, False)]
    ev = spark.createDataFrame(rows, "id int, event_date string, after_close boolean").withColumn("event_date", F.to_date("event_date"))
    assert {r["id"]: r["i0"] for r in market.event_sessions(ev, cal).collect()} == {1: 0, 2: 3, 3: 2, 4: None, 5: None}
    news = spark.createDataFrame([(1, "2019-12-31 16:00:00"), (2, "2020-01-03 15:00:00"), (3, "2020-01-04 16:00:00"), (4, "2020-01-06 15:30:00"), (5, "2021-01-01 09:00:00")], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["id"]: r["session"] for r in market.news_sessions(news, cal).collect()} == {1: 0, 2: 2, 3: 2, 4: 2, 5: 2}
