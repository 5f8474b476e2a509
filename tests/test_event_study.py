"""Event windows by running sums against plain loops over one ticker's sessions."""

import datetime
import math

import numpy as np
import pytest

from tidemark.operators import market as mk

N = 420


@pytest.fixture(scope="module")
def world(spark):
    g = np.random.default_rng(8)
    market = [None] + g.normal(0.001, 0.01, N - 1).tolist()
    market[77] = None
    own, close = {}, {}
    for t in range(3):
        x = (0.0005 + (0.5 + t) * np.array([m or 0 for m in market]) + g.normal(0, 0.02, N)).tolist()
        x[0] = None
        for i in g.integers(1, N, 25 if t < 2 else 330):
            x[i] = None if i % 2 and t < 2 else 0.0  # ticker 2 trades on too few days
        own[t], close[t] = x, g.uniform(5, 9, N).tolist()
    own[1][300] = -1.0  # a price of nothing
    rows = [(t, i, datetime.date(2020, 1, 1) + datetime.timedelta(i), close[t][i], None if i % 11 == 0 else float(i), own[t][i]) for t in own for i in range(N)]
    rets = spark.createDataFrame(rows, "ticker int, idx int, date date, close double, volume double, ret double")
    m = spark.createDataFrame([(i, x) for i, x in enumerate(market)], "idx int, ret double")
    return rets, m, own, market, close


def model(own, market, a, b):
    ok = [i for i in range(max(a, 0), b + 1) if own[i] is not None and market[i] is not None and own[i] != 0]
    if len(ok) < 80:
        return None
    x, y = np.array([[1, market[i]] for i in ok]), np.array([own[i] for i in ok])
    c, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ c
    return len(ok), c[0], c[1], math.sqrt(e @ e / (len(ok) - 2))


def event(own, market, close, i0):
    """One event's row by direct sums; None where it has no model."""
    if i0 - 150 < 0 or i0 + 10 >= N or (f := model(own, market, i0 - 150, i0 - 11)) is None:
        return None
    n, alpha, beta, sigma = f
    out = {"n_obs": n, "alpha": alpha, "beta": beta, "sigma": sigma, "zero_ret_share": sum(own[i] == 0 for i in range(i0 - 150, i0 - 10)) / 140}
    for lo, hi in mk.WINDOWS:
        days = [(own[i], market[i]) for i in range(i0 + lo, i0 + hi + 1)]
        whole = all(x is not None and y is not None for x, y in days)
        ar = sum(x - alpha - beta * y for x, y in days) if whole else None
        out |= {mk.span_name("car", lo, hi): ar, mk.span_name("scar", lo, hi): ar / (sigma * math.sqrt(hi - lo + 1)) if whole else None, mk.span_name("carma", lo, hi): sum(x - y for x, y in days) if whole else None}
    prod = lambda xs: math.prod(1 + x for x in xs if x is not None)
    out["bhar_0_3"] = prod(own[i0 : i0 + 4]) - prod(market[i0 : i0 + 4])
    out["pre_ret"] = sum(own[i] - market[i] for i in range(max(0, i0 - 30), i0 - 1) if own[i] is not None and market[i] is not None)
    pre = model(own, market, i0 - 252, i0 - 6)
    out["pre_alpha"] = pre and pre[1]
    worth = [close[i] * i for i in range(i0 - 60, i0) if i % 11]
    out["log_tradeval"] = math.log(sum(worth) / len(worth))
    out["volume_year"] = float(sum(i for i in range(max(0, i0 - 252), i0 - 5) if i % 11))
    out["close_before"] = close[i0 - 1]
    return out


def test_every_session_equals_direct_sums(spark, world):
    rets, m, own, market, close = world
    got = {(r["ticker"], r["i0"]): r for r in mk.session_study(rets, m).collect()}
    there = 0
    for t in own:
        for i0 in range(N):
            want = event(own[t], market, close[t], i0)
            if want is None:
                assert (t, i0) not in got
                continue
            there += 1
            before = event(own[t], market, close[t], i0 - 60)
            want["placebo_car_0_3"] = before and before["car_0_3"]
            for k, v in want.items():
                assert got[t, i0][k] == (None if v is None else pytest.approx(v, abs=1e-9)), (t, i0, k)
    assert there > 300 and not any(t == 2 for t, _ in got)
    # From 150 to 209 an event has a model, but its placebo session has none.
    assert all(got[0, i]["placebo_car_0_3"] is None for i in range(150, 210))
    assert got[0, 215]["placebo_car_0_3"] is not None


def test_parts_agree_with_the_whole(spark, world):
    rets, m, own, market, _ = world
    events = spark.createDataFrame([(1, 0, 200), (2, 1, 299), (3, 2, 250), (4, 0, None), (5, 9, 200)], "doc_id int, ticker int, i0 int")
    fit = mk.market_model(events, rets, m, 80)
    whole = {r["doc_id"]: r for r in mk.event_study(events, mk.session_study(rets, m)).collect()}
    assert sorted(whole) == [1, 2] == sorted(r["doc_id"] for r in fit.collect())
    for r in mk.car(events, fit, rets, m, 0, 3).collect():
        w = whole[r["doc_id"]]
        assert (r["car"], r["scar"], r["bhar"]) == (w["car_0_3"], w["scar_0_3"], pytest.approx(w["bhar_0_3"]))
    path = [r for r in mk.abnormal(events, fit, rets, m, -10, 10).collect() if r["doc_id"] == 1]
    assert sorted(r["k"] for r in path) == list(range(-10, 11))
    w = whole[1]
    for r in path:
        x, y = own[0][200 + r["k"]], market[200 + r["k"]]
        assert r["ar"] == (None if x is None or y is None else pytest.approx(x - w["alpha"] - w["beta"] * y))
    # At the calendar's edges windows hold what is there.
    late = spark.createDataFrame([(1, 0, N - 2), (2, 0, 1)], "doc_id int, ticker int, i0 int")
    ks = {d: [r["k"] for r in mk.abnormal(late, late.selectExpr("doc_id", "0D alpha", "1D beta", "1D sigma"), rets, m, -3, 3).collect() if r["doc_id"] == d] for d in (1, 2)}
    assert sorted(ks[1]) == [-3, -2, -1, 0, 1] and sorted(ks[2]) == [-1, 0, 1, 2, 3]


def test_no_row_per_session_and_event(spark, world):
    rets, m, *_ = world
    events = spark.createDataFrame([(1, 0, 200)], "doc_id int, ticker int, i0 int")
    plan = mk.event_study(events, mk.session_study(rets, m))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 2


def test_events_touch_flagged_periods_within_their_sessions(spark):
    days = [datetime.date(2020, 1, 27) + datetime.timedelta(i) for i in range(0, 60, 2)]
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "date date, idx int")
    events = spark.createDataFrame([(i, i) for i in range(-1, len(days) + 1)] + [(99, None)], "doc_id int, i0 int")
    flagged = spark.createDataFrame([(datetime.datetime(2020, 2, 1),)] * 2, "period timestamp")
    got = {r["doc_id"]: r["touches"] for r in mk.touching(events, cal, flagged, "month", 3).collect()}
    for i in range(len(days)):
        assert got[i] == any(d.month == 2 for d in days[max(0, i - 3) : i + 4]), i
    assert got[99] is False and got[-1] is False and len(got) == len(days) + 3
    assert not any(r["touches"] for r in mk.touching(events, cal, flagged.where("false"), "month").collect())


def test_lags_of_two_dates(spark):
    lags = spark.createDataFrame([(0,), (0,), (3,), (-2,), (7,), (None,)], "lag int")
    r = mk.date_lags(lags).first()
    assert (r["n"], r["median"], r["same"], r["later"], r["earlier"]) == (5, 0.0, 2, 2, 1) and r["p90"] == pytest.approx(5.4) and r["p10"] == pytest.approx(-1.2)
    none = mk.date_lags(lags.where("false")).first()
    assert none["n"] == 0 and none["median"] is None


def test_placebo_has_all_measures_of_the_shifted_window(spark, world):
    """Once the query gave the placebo's car alone."""
    rets, m, own, market, close = world
    got = {(r["ticker"], r["i0"]): r for r in mk.session_study(rets, m).where("i0 % 7 = 0").collect()}
    there = 0
    for (t, i0), r in got.items():
        want = event(own[t], market, close[t], i0 - 60)
        there += want is not None
        for k in ("car_0_3", "scar_0_3", "bhar_0_3"):
            assert r[f"placebo_{k}"] == (None if want is None or want[k] is None else pytest.approx(want[k], abs=1e-9)), (t, i0, k)
    assert 20 < there < len(got)


def test_placebo_query_keeps_its_columns(spark):
    from tidemark.plans.queries import QUERIES

    got = QUERIES["placebo_car"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "car", "scar", "bhar"]
    whole = got.collect()
    assert whole and all(r["bhar"] is not None for r in whole if r["car"] is not None)
