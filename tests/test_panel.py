import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import drop_numeric_tables, page_gate, sentences, word_error_rate
from tidemark.operators import market, phrases, regression


def _panel(spark, n=240, seed=3):
    g = np.random.default_rng(seed)
    x1, x2, k, year = g.normal(size=n), g.normal(size=n), g.integers(0, 12, n), g.integers(2015, 2019, n)
    y = 0.5 + 0.3 * x1 - 0.2 * x2 + 0.1 * (year - 2015) + 0.2 * (k % 3) + g.normal(size=n)
    rows = [(float(a), float(b), float(c), int(d), int(e)) for a, b, c, d, e in zip(y, x1, x2, k, year)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1, 2015), (1.0, None, 1.0, 1, 2015)], "y double, x1 double, x2 double, k int, year int")
    design = np.column_stack([np.ones(n), x1, x2, *[(year == v).astype(float) for v in (2016, 2017, 2018)]])
    return df, y, design, k, year


def test_clustered_errors_equal_the_sandwich(spark):
    df, y, x, k, _ = _panel(spark)
    got = {r["term"]: r for r in regression.clustered(df, "y", ["x1", "x2"], "k", ["year"]).collect()}
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    meat = sum(np.outer(s, s) for s in (x[k == g].T @ e[k == g] for g in np.unique(k)))
    n, p, g = len(y), x.shape[1], len(np.unique(k))
    se = np.sqrt(np.diag(inv @ meat @ inv) * g / (g - 1) * (n - 1) / (n - p))
    for i, term in enumerate(["const", "x1", "x2", "year=2016", "year=2017", "year=2018"]):
        assert got[term]["coef"] == pytest.approx(b[i]) and got[term]["se"] == pytest.approx(se[i])
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    assert got["x1"]["r2_adj"] == pytest.approx(1 - (1 - r2) * (n - 1) / (n - p)) and got["x1"]["n_obs"] == n


def test_two_absorbed_effects_equal_dummies(spark):
    g = np.random.default_rng(5)
    n = 900
    a, b, k = g.integers(0, 40, n), g.integers(0, 25, n), g.integers(0, 15, n)
    b = np.where(a < 30, b % 15, 15 + b % 10)  # two parts that no pair of levels links
    x1, x2 = g.normal(size=n) + 0.05 * a, g.normal(size=n) * (1 + b % 3)
    y = 100 + 0.3 * x1 - 0.2 * x2 + 0.1 * a + np.sin(b) + g.normal(size=n)
    rows = [(float(p), float(q), float(r), int(c), f"l{d}", int(e)) for p, q, r, c, d, e in zip(y, x1, x2, a, b, k)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 0, "l0", 1), (1.0, 1.0, 1.0, None, "l0", 1)], "y double, x1 double, x2 double, a int, b string, k int")
    got = {r["term"]: r for r in regression.clustered(df, "y", ["x1", "x2"], "k", absorbed=("a", "b")).collect()}
    x = np.column_stack([x1, x2, *[(a == v).astype(float) for v in np.unique(a)], *[(b == v).astype(float) for v in np.unique(b)]])
    inv = np.linalg.pinv(x.T @ x)
    coef = inv @ x.T @ y
    e = y - x @ coef
    meat = sum(np.outer(s, s) for s in (x[k == c].T @ e[k == c] for c in np.unique(k)))
    p = np.linalg.matrix_rank(x)
    assert p == 2 + 40 + 25 - 2
    se = np.sqrt(np.diag(inv @ meat @ inv) * 15 / 14 * (n - 1) / (n - p))
    for i, term in enumerate(["x1", "x2"]):
        assert got[term]["coef"] == pytest.approx(coef[i], rel=1e-7) and got[term]["se"] == pytest.approx(se[i], rel=1e-7)
    assert got["x1"]["n_obs"] == n and regression.clustered(df.where("false"), "y", ["x1"], "k", absorbed=("a", "b")).count() == 0


def test_no_rows_give_no_terms(spark):
    df, *_ = _panel(spark)
    assert regression.clustered(df.where("false"), "y", ["x1"], "k").count() == 0
    assert regression.diagnostics(df.where("false"), "y", ["x1"]).count() == 0


def test_diagnostics_equal_their_definitions(spark):
    df, y, x, _, _ = _panel(spark)
    got = {r["measure"]: r["value"] for r in regression.diagnostics(df, "y", ["x1", "x2"], ["year"]).collect()}
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]

    def r2(target, on):
        res = target - on @ np.linalg.lstsq(on, target, rcond=None)[0]
        return 1 - res @ res / ((target - target.mean()) @ (target - target.mean()))

    assert got["bp_lm"] == pytest.approx(len(y) * r2(e * e, x))
    assert got["vif_x1"] == pytest.approx(1 / (1 - r2(x[:, 1], np.delete(x, 1, 1))))
    assert got["jb_p"] == pytest.approx(math.exp(-got["jb"] / 2))


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (19.675138, 11, 0.05)])
def test_chi_squared_tail(x, df, p):
    assert regression.chi2_sf(x, df) == pytest.approx(p, abs=1e-6)


def test_fama_macbeth_means_periods(spark):
    df, y, x, _, year = _panel(spark)
    got = {r["term"]: r for r in regression.fama_macbeth(df, "y", ["x1", "x2"], "year").collect()}
    b = np.array([np.linalg.lstsq(x[year == v][:, :3], y[year == v], rcond=None)[0][1] for v in range(2015, 2019)])
    d = b - b.mean()
    assert got["x1"]["mean"] == pytest.approx(b.mean()) and got["x1"]["n_periods"] == 4
    assert got["x1"]["t"] == pytest.approx(b.mean() / (math.sqrt(d @ d + d[1:] @ d[:-1]) / 4))


def _lexicon(spark, *rows):
    return spark.createDataFrame(list(rows), "term string, category string")


def test_longest_phrase_wins_and_negation_uses_its_words(spark):
    text = "Chi phí lãi vay giảm. Lãi không cải thiện, lãi vay còn cao; cải thiện chậm."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    lexicon = _lexicon(spark, ("lãi vay", "negative"), ("lãi", "uncertainty"), ("vay giảm", "positive"), ("cải thiện", "positive"))
    got = {r["doc_id"]: r for r in phrases.longest_matches(docs, lexicon, 2, ("không",)).collect()}
    assert (got[1]["negative"], got[1]["positive"], got[1]["uncertainty"]) == (2, 1, 1)
    assert all((got[i]["n_words"], got[i]["negative"]) == (0, 0) for i in (2, 3))
    spans = {r["doc_id"]: r["spans"] for r in phrases.phrase_spans(docs, lexicon, 2, ("không",)).collect()}
    assert [text[s["start"] : s["end"]] for s in spans[1]] == ["lãi vay", "Lãi", "lãi vay", "cải thiện"]
    assert spans[2] is None and spans[3] == []


def test_spans_apart_from_others(spark):
    df = spark.createDataFrame([(1, "A loss on tax, not-tax."), (2, None), (3, "Straße tax"), (4, "")], "doc_id long, text string")
    gen = phrases.term_spans(df, _lexicon(spark, ("LOSS", "negative"), ("TAX", "negative"), ("TAX", "positive")), ("LOSS",)).withColumnRenamed("spans", "g")
    fin = phrases.term_spans(df, _lexicon(spark, ("LOSS", "negative"))).withColumnRenamed("spans", "f")
    got = {r["doc_id"]: r for r in gen.join(fin, "doc_id").withColumn("a", phrases.apart(F.col("g"), F.col("f"))).collect()}
    assert [(s["start"], s["end"], s["categories"]) for s in got[1]["g"]] == [(2, 6, ["negative"]), (10, 13, ["negative"])]
    assert [s["start"] for s in got[1]["a"]] == [10] and got[2]["a"] is None and got[3]["g"] is None and got[4]["g"] == []
    top = phrases.top_words(gen.withColumnRenamed("g", "spans"), 1).collect()
    assert [(r["term"], r["n"]) for r in top] == [("LOSS", 1)]


def test_text_checks(spark):
    df = spark.createDataFrame(
        [("<table><td>7,010</td></table><TABLE><td>Our plants are old</td></TABLE>", "a b c", "a x c d")], "html string, found string, wanted string"
    )
    state, _ = page_gate(F.col("found"))
    r = df.select(drop_numeric_tables(F.col("html")).alias("h"), word_error_rate(F.col("found"), F.col("wanted")).alias("w"), state.alias("s")).first()
    assert "7,010" not in r["h"] and "Our plants are old" in r["h"]
    assert r["w"] == pytest.approx(0.5) and r["s"] == "empty"
    one = spark.createDataFrame([("Too short. " + "word " * 8 + "end! Last.",)], "t string").select(sentences(F.col("t")).alias("s")).first()
    assert len(one["s"]) == 1


def test_controls_count_zero_days_over_all_sessions(spark):
    day = datetime.date(2020, 1, 1)
    rows = [("a", i, 0.0 if i % 2 else 0.01, 2.0, 3.0) for i in range(300)]
    rets = spark.createDataFrame(rows, "ticker string, idx int, ret double, close double, volume double").withColumn("date", F.lit(day))
    mkt = spark.range(300).select(F.col("id").cast("int").alias("idx"), F.lit(0.0).alias("ret"))
    events = spark.createDataFrame([(1, "a", 260)], "doc_id long, ticker string, i0 int")
    r = market.controls(events, rets, mkt).first()
    assert r["zero_share"] == pytest.approx(0.5) and r["log_tradeval"] == pytest.approx(math.log(6))
    assert r["volume_year"] == pytest.approx(3.0 * 247)


def test_news_windows_pass_busy_sessions_as_counts(spark):
    events = spark.createDataFrame([(1, 7, 10), (2, 8, 10)], "doc_id long, ticker int, i0 int")
    news = spark.createDataFrame([(7, 9, "x")] * 5 + [(7, 14, "x"), (None, 9, "x")], "ticker int, idx int, kind string")
    assert [tuple(r) for r in market.news_windows(events, news, -3, 3).collect()] == [(1, -1, "x", 5)]


def test_parts_of_two_effects_in_tasks_and_by_shuffles(spark, monkeypatch):
    g = np.random.default_rng(7)
    n = 1200
    part = g.choice(3, n, p=[0.8, 0.15, 0.05])  # parts of about 960, 180 and 60 rows
    a, b = part * 100 + g.integers(0, 30, n), part * 100 + g.integers(0, 20, n)
    x = g.normal(size=n) + 0.05 * (a % 100)
    y = 5 + 0.3 * x + 0.1 * a + np.sin(b) + g.normal(size=n)
    df = spark.createDataFrame([(float(p), float(q), int(c), int(d)) for p, q, c, d in zip(y, x, a, b)], "y double, x double, a int, b int")
    dummies = np.column_stack([*[(a == v).astype(float) for v in np.unique(a)], *[(b == v).astype(float) for v in np.unique(b)]])
    left = np.column_stack([y, x]) - dummies @ np.linalg.lstsq(dummies, np.column_stack([y, x]), rcond=None)[0] + [y.mean(), x.mean()]
    wanted = sorted(zip(a.tolist(), b.tolist(), left[:, 0], left[:, 1]))
    for in_task in (1_000_000, 500):  # all parts in tasks, the largest by shuffles
        out, free = regression.absorb_two(df, ["y", "x"], "a", "b", in_task=in_task)
        got = sorted((r["a"], r["b"], r["y"], r["x"]) for r in out.collect())
        assert free == len(np.unique(a)) + len(np.unique(b)) - 3
        assert np.allclose(np.array(got), np.array(wanted), atol=1e-9)
    written, write = [], regression.stored
    monkeypatch.setattr(regression, "stored", lambda df, what: written.append(what) or write(df, what))
    regression.clustered(df.withColumn("k", F.col("b") % 7), "y", ["x"], "k", absorbed=("a", "b"))
    assert "less-effects" in written and "level-pairs" not in written  # parts that fit a task shuffle no pairs of levels


def test_levels_that_only_inner_pairs_link(spark, monkeypatch):
    """Least and greatest partners leave p and r apart here; their pairs with 4 make them one part."""
    rows = [(a, b) for a, bs in {"a": (1, 4, 9), "p": (1, 4, 9), "z": (1, 4, 9), "r": (2, 4, 8), "b": (2, 8), "t": (20,)}.items() for b in bs]
    df = spark.createDataFrame([(float(i * i % 7), *r) for i, r in enumerate(rows)], "y double, a string, b int")
    written, write = [], regression.stored
    monkeypatch.setattr(regression, "stored", lambda df, what: written.append(what) or write(df, what))
    lines, free = regression._parted(df, "a", "b")
    assert "part-links" in written
    parts = {r["a"]: r["__part"] for r in lines.collect()}
    assert lines.count() == len(rows) and len(set(parts.values())) == 2 and parts["a"] == parts["p"] == parts["r"] == parts["b"] == parts["z"] != parts["t"]
    assert free == 6 + 6 - 2
