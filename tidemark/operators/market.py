"""Trading calendars, returns, event windows and as-of joins over long price tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import fiscal_year
from .stats import quantiles


def calendar(prices: DataFrame) -> DataFrame:
    """date, idx: the sessions, numbered from 0. One row per trading day: small at any scale."""
    return prices.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def returns(prices: DataFrame) -> DataFrame:
    """ticker, idx, date, close, volume, ret on the full grid of sessions and tickers.

    A missing session nulls its own return and the next one. Calendar and tickers are both small.
    """
    grid = calendar(prices).crossJoin(F.broadcast(prices.select("ticker").distinct()))
    full = grid.join(prices, ["ticker", "date"], "left")
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("idx"))
    return full.select("ticker", "idx", "date", "close", "volume", (F.col("close") / before - 1).alias("ret"))


def session_of(days: DataFrame, sessions: DataFrame, day: str) -> DataFrame:
    """days with `idx`, the first session at or after the date `day`; null after the last session.

    Sessions are spread over civil days once, from the least day asked on, so that the as-of join is an
    equi-join of the days with a calendar."""
    prev, next_ = F.lag("date").over(Window.orderBy("idx")), F.lead("date").over(Window.orderBy("idx"))
    least = days.agg(F.min(day).alias("least"))
    known = sessions.select("idx", "date", prev.alias("prev"), next_.alias("next")).crossJoin(F.broadcast(least))  # one row
    first = F.coalesce(F.date_add("prev", 1), F.least("date", F.coalesce("least", "date")))
    civil = known.select("idx", F.explode(F.sequence(first, F.col("date"))).alias(day))
    return days.join(civil, day, "left")


def event_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """events with i0: the first session at or after event_date, one later if after_close; null after
    the last session. An event before the first session has that one."""
    met = session_of(events, sessions, "event_date")
    return met.withColumn("i0", F.col("idx") + F.col("after_close").cast("int")).drop("idx")


def news_sessions(news: DataFrame, sessions: DataFrame, close_hour: int = 15, clamp: bool = True) -> DataFrame:
    """news (ts) with `session`: that of its date, the next one where it is a session and the hour is
    close_hour or later; with clamp at most the last session, else the number of sessions beyond it."""
    x = session_of(news.withColumn("__day", F.to_date("ts")), sessions, "__day")
    dates = sessions.select(F.col("date").alias("__day"), F.lit(1).alias("__open"))
    size = sessions.agg(F.count(F.lit(1)).cast("int").alias("__n"))
    x = x.join(dates, "__day", "left").crossJoin(F.broadcast(size))  # one row
    late = F.when(F.col("__open").isNotNull() & (F.hour("ts") >= close_hour), 1).otherwise(0)
    at = F.coalesce("idx", "__n") + late
    return x.withColumn("session", F.least(at, F.col("__n") - 1) if clamp else at).drop("idx", "__day", "__open", "__n")


#: Running sums that windows are differences of: what is summed and where, as SQL. Traded days have both
#: returns and an own one that is not 0; whole days have both. cx and cy are the means of the market's and
#: the own return, taken off for the digits of sums of squares.
_BOTH = "ret IS NOT NULL AND mret IS NOT NULL"
_TRADED = f"{_BOTH} AND ret <> 0"
_SUMS = {
    "n": ("1D", _TRADED), "x": ("mret - cx", _TRADED), "y": ("ret - cy", _TRADED), "xx": ("(mret - cx) * (mret - cx)", _TRADED),
    "yy": ("(ret - cy) * (ret - cy)", _TRADED), "xy": ("(mret - cx) * (ret - cy)", _TRADED),
    "days": ("1D", "true"), "whole": ("1D", _BOTH), "own": ("ret", _BOTH), "mkt": ("mret", _BOTH), "zero": ("1D", "ret = 0"),
    "own_log": ("ln(abs(1 + ret))", "ret <> -1"), "own_none": ("1D", "ret = -1"), "own_minus": ("1D", "ret < -1"),
    "mkt_log": ("ln(abs(1 + mret))", "mret <> -1"), "mkt_none": ("1D", "mret = -1"), "mkt_minus": ("1D", "mret < -1"),
    "worth": ("close * volume", "close * volume IS NOT NULL"), "worths": ("1D", "close * volume IS NOT NULL"), "volume": ("volume", "volume IS NOT NULL"), "volumes": ("1D", "volume IS NOT NULL"),
}
FIT = ("n", "x", "y", "xx", "yy", "xy")
SUMS = ("whole", "own", "mkt")
PRODUCTS = ("own_log", "own_none", "own_minus", "mkt_log", "mkt_none", "mkt_minus")


def over_sessions(rets: DataFrame, market: DataFrame, spans: Mapping[str, tuple[int, int, Sequence[str]]]) -> DataFrame:
    """rets with mret, cx, cy, `last` (the ticker's last idx) and, for each span (lo, hi, sums), the columns
    <span>__<sum> over the sessions idx + lo to idx + hi; sessions outside the calendar add nothing.

    rets: the full grid of `returns`. A window is the difference of two running sums, which stand some
    sessions before and after its own: one shuffle and one sort by (ticker, idx) serve all spans, and a
    session costs the same however long the spans are. A ticker has a row per session, no more.
    """
    by, order = "OVER (PARTITION BY ticker)", "OVER (PARTITION BY ticker ORDER BY idx)"
    upto = order.replace(")", " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    x = rets.join(F.broadcast(market.select("idx", F.col("ret").alias("mret"))), "idx", "left")  # a row per session
    x = x.selectExpr(*rets.columns, "mret", f"coalesce(avg(mret) {by}, 0D) AS cx", f"coalesce(avg(ret) {by}, 0D) AS cy", f"max(idx) {by} AS last")
    used = {k: f"CASE WHEN {where} THEN {what} ELSE 0D END" for k, (what, where) in _SUMS.items() if any(k in f for _, _, f in spans.values())}
    ahead = {k for _, hi, f in spans.values() if hi > 0 for k in f}
    kept = [*rets.columns, "mret", "cx", "cy", "last"]
    x = x.selectExpr(*kept, *[f"sum({c}) {upto} AS run_{k}" for k, c in used.items()], *[f"sum({used[k]}) {by} AS all_{k}" for k in sorted(ahead)])
    edges = sorted({(e, k) for lo, hi, f in spans.values() for e in (lo - 1, hi) for k in f})

    def at(e: int, k: str) -> str:
        if e > 0:
            return f"coalesce(lead(run_{k}, {e}) {order}, all_{k})"
        return f"lag(run_{k}, {-e}, 0D) {order}" if e else f"run_{k}"

    place = {edge: f"at_{i}" for i, edge in enumerate(edges)}
    x = x.selectExpr(*kept, *[f"{at(*edge)} AS {name}" for edge, name in place.items()])
    return x.selectExpr(*kept, *[f"{place[hi, k]} - {place[lo - 1, k]} AS {name}__{k}" for name, (lo, hi, f) in spans.items() for k in f])


def _of(span: str, k: str, whole: bool = False) -> Column:
    """A sum of a span; `whole`: one that counts, without what rounding leaves."""
    c = F.col(f"{span}__{k}")
    return F.round(c) if whole else c


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _fitted(x: DataFrame, span: str, least: int, only: Sequence[str] = ("n_obs", "alpha", "beta", "sigma"), prefix: str = "") -> DataFrame:
    """x with n_obs, alpha, beta, sigma of a span's traded days; nulls under `least` of them or without spread."""
    n = F.greatest(_of(span, "n", True), F.lit(1.0))
    x = x.withColumns({f"{prefix}s_{ab}": _of(span, ab) - _of(span, a) * _of(span, b) / n for ab, a, b in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y"))})
    sxx, sxy, syy = (F.col(f"{prefix}s_{ab}") for ab in ("xx", "xy", "yy"))
    x = x.withColumn(f"{prefix}b", F.when((_of(span, "n", True) >= max(least, 1)) & (sxx > 1e-13 * _of(span, "xx")), _ratio(sxy, sxx)))
    beta = F.col(f"{prefix}b")
    made = {
        "n_obs": _of(span, "n", True).cast("long"), "alpha": F.col("cy") + _of(span, "y") / n - beta * (F.col("cx") + _of(span, "x") / n), "beta": beta,
        "sigma": F.when(n > 2, F.sqrt(F.greatest(syy - beta * sxy, F.lit(0.0)) / F.greatest(n - 2, F.lit(1.0)))),
    }
    return x.withColumns({prefix + k: made[k] for k in only}).drop(*[f"{prefix}s_{ab}" for ab in ("xx", "xy", "yy")], f"{prefix}b")


def _summed(span: str, size: int) -> tuple[Column, Column, Column]:
    """car, scar and carma of a span of `size` sessions; nulls unless every abnormal return is there."""
    n = F.lit(float(size))
    there = _of(span, "whole", True) == size
    car = F.when(there, _of(span, "own") - F.col("alpha") * n - F.col("beta") * _of(span, "mkt"))
    return car, _ratio(car, F.col("sigma") * F.sqrt(n)), F.when(there & F.col("alpha").isNotNull(), _of(span, "own") - _of(span, "mkt"))


def _bhar(span: str) -> Column:
    """The product of 1 + return over a span less the market's; missing returns are left out."""

    def product(side: str) -> Column:
        sign = 1 - 2 * F.pmod(_of(span, f"{side}_minus", True), F.lit(2.0))
        return F.when(_of(span, f"{side}_none", True) > 0, 0.0).otherwise(sign * F.exp(_of(span, f"{side}_log")))

    return product("own") - product("mkt")


def span_name(prefix: str, lo: int, hi: int) -> str:
    """car, -1, 1: car_m1_1."""
    return "_".join([prefix, *[f"m{-k}" if k < 0 else str(k) for k in (lo, hi)]])


WINDOWS = ((0, 3), (0, 1), (-1, 1), (0, 5), (0, 10))


def session_study(
    rets: DataFrame, market: DataFrame, spans: Sequence[tuple[int, int]] = WINDOWS, main: tuple[int, int] = (0, 3), estimation: tuple[int, int] = (-150, -11), least: int = 80, shift: int = -60
) -> DataFrame:
    """What an event on each session of each ticker would show, a row per (ticker, i0) that has a model.

    day0; n_obs, alpha, beta, sigma of the market model; zero_ret_share of the estimation window; car_,
    scar_ and carma_ of each span; bhar_ of the main span; placebo_car_, placebo_scar_ and placebo_bhar_, the
    main span's at i0 + shift where that session has a model too; pre_ret over sessions -30 to -2; pre_alpha, the intercept over -252
    to -6; log_tradeval over -60 to -1; volume_year over -252 to -6; close_before. A session has a model if the
    estimation window and the longest span lie in the calendar and `least` days were traded.
    """
    named = {span_name("w", lo, hi): (lo, hi, (*SUMS, *PRODUCTS) if (lo, hi) == main else SUMS) for lo, hi in spans}
    own = {"est": (*estimation, (*FIT, "days", "zero")), "year": (-252, -6, (*FIT, "volume", "volumes")), "month": (-30, -2, ("own", "mkt")), "quarter": (-60, -1, ("worth", "worths"))}
    x = over_sessions(rets, market, {**own, **named})
    lo, hi = estimation
    inside = (_of("est", "days", True) == hi - lo + 1) & (F.col("idx") + max(b for _, b in spans) <= F.col("last"))
    x = _fitted(_fitted(x, "est", least), "year", least, ["alpha"], "pre_")
    x = x.withColumns({k: F.when(inside, F.col(k)) for k in ("n_obs", "alpha", "beta", "sigma")})
    value = _ratio(_of("quarter", "worth"), _of("quarter", "worths", True))
    columns = {"zero_ret_share": _of("est", "zero", True) / (hi - lo + 1)}
    for name, (a, b, _) in named.items():
        for prefix, c in zip(("car", "scar", "carma"), _summed(name, b - a + 1), strict=True):
            columns[span_name(prefix, a, b)] = c
    a, b = main
    columns[span_name("bhar", a, b)] = _bhar(span_name("w", a, b))
    columns |= {"pre_ret": _of("month", "own") - _of("month", "mkt"), "log_tradeval": F.when(value > 0, F.log(value)), "volume_year": F.when(_of("year", "volumes", True) > 0, _of("year", "volume"))}
    x = x.withColumns(columns)
    order = Window.partitionBy("ticker").orderBy("idx")
    placebo = {span_name(f"placebo_{k}", a, b): F.lag(F.when(F.col("beta").isNotNull(), F.col(span_name(k, a, b))), -shift).over(order) for k in ("car", "scar", "bhar")}
    x = x.withColumns(placebo | {"close_before": F.lag("close").over(order)})
    kept = [*columns, "pre_alpha", *placebo, "close_before"]
    return x.where("beta IS NOT NULL").select("ticker", F.col("idx").alias("i0"), F.col("date").alias("day0"), "n_obs", "alpha", "beta", "sigma", *kept)


def event_study(events: DataFrame, study: DataFrame) -> DataFrame:
    """events (with ticker, i0) that have a model, with their session's columns: one equi-join."""
    return events.join(study, ["ticker", "i0"])


def market_model(events: DataFrame, rets: DataFrame, market: DataFrame, least: int, lo: int = -150, hi: int = -11) -> DataFrame:
    """doc_id, n_obs, alpha, beta, sigma by least squares on the days with returns that are not 0.

    With lo = -252 and hi = -6 alpha is the abnormal return before the event (`pre_alpha`)."""
    x = _fitted(over_sessions(rets, market, {"est": (lo, hi, FIT)}), "est", least).select("ticker", F.col("idx").alias("i0"), "n_obs", "alpha", "beta", "sigma")
    return events.select("doc_id", "ticker", "i0").join(x.where("beta IS NOT NULL"), ["ticker", "i0"]).drop("ticker", "i0")


def abnormal(events: DataFrame, fit: DataFrame, rets: DataFrame, market: DataFrame, lo: int, hi: int) -> DataFrame:
    """doc_id, k, ret, mret, ar, sigma: a row per event and session from lo to hi of its own session i0.

    Every session gets the array of its neighbours' returns in one pass, so that events meet one row each."""
    order = Window.partitionBy("ticker").orderBy("idx")
    x = rets.select("ticker", "idx", "ret").join(F.broadcast(market.select("idx", F.col("ret").alias("mret"))), "idx")  # a row per session
    steps = range(lo, hi + 1)
    near = [F.lag(F.struct("ret", "mret"), -k).over(order) if k < 0 else F.lead(F.struct("ret", "mret"), k).over(order) for k in steps]
    near = [F.struct(F.lit(k).alias("k"), c["ret"].alias("ret"), c["mret"].alias("mret"), c.isNotNull().alias("there")) for k, c in zip(steps, near, strict=True)]
    x = x.select("ticker", F.col("idx").alias("i0"), F.array(*near).alias("near"))
    met = events.select("doc_id", "ticker", "i0").join(fit, "doc_id").join(x, ["ticker", "i0"]).select("doc_id", "alpha", "beta", "sigma", F.inline("near")).where("there")
    return met.select("doc_id", "k", "ret", "mret", (F.col("ret") - F.col("alpha") - F.col("beta") * F.col("mret")).alias("ar"), "sigma")


def _spanned(events: DataFrame, fit: DataFrame, rets: DataFrame, market: DataFrame, spans: Sequence[tuple[int, int]], sums: Sequence[str] = SUMS) -> DataFrame:
    named = {span_name("w", lo, hi): (lo, hi, sums) for lo, hi in spans}
    x = over_sessions(rets, market, named).select("ticker", F.col("idx").alias("i0"), *[f"{name}__{k}" for name in named for k in sums])
    return events.select("doc_id", "ticker", "i0").join(fit, "doc_id").join(x, ["ticker", "i0"])


def car(events: DataFrame, fit: DataFrame, rets: DataFrame, market: DataFrame, lo: int, hi: int) -> DataFrame:
    """doc_id, car, scar, bhar. CAR needs every abnormal return; BHAR skips missing ones."""
    name = span_name("w", lo, hi)
    own, scaled, _ = _summed(name, hi - lo + 1)
    x = _spanned(events, fit, rets, market, [(lo, hi)], (*SUMS, *PRODUCTS))
    return x.select("doc_id", own.alias("car"), scaled.alias("scar"), _bhar(name).alias("bhar"))


def car_family(events: DataFrame, fit: DataFrame, rets: DataFrame, market: DataFrame, spans: Sequence[tuple[int, int]]) -> DataFrame:
    """doc_id, lo, hi, car, scar, carma (market-adjusted) of every window with all its abnormal returns."""
    x = _spanned(events, fit, rets, market, spans)
    rows = [F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), *[c.alias(k) for k, c in zip(("car", "scar", "carma"), _summed(span_name("w", lo, hi), hi - lo + 1), strict=True)]) for lo, hi in spans]
    return x.select("doc_id", F.inline(F.array(*rows))).where("car IS NOT NULL")


def latest_fact(asked: DataFrame, facts: DataFrame, fresh_days: int = 400, annual: bool = False) -> DataFrame:
    """Per (id, day) the fact with the last period end, then filing, filed up to 3 days later and
    not older than fresh_days. annual: only facts whose period, from `start`, is 350 to 380 days."""
    if annual:
        facts = facts.where(F.datediff("end", "start").between(350, 380))
    x = asked.join(facts, "id").where(
        (F.col("filed") <= F.date_add("day", 3)) & (F.col("end") <= F.col("day")) & (F.col("end") > F.date_sub("day", fresh_days))
    )
    return x.groupBy("id", "day").agg(F.max(F.struct("end", "filed", "val")).alias("m")).select("id", "day", "m.end", "m.filed", "m.val")


def fact_by_priority(asked: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """id, day, val, end, source: the latest fact of the first source that has one; null without any.

    sources: (name, facts) in order of preference, each as `latest_fact` returns them."""
    out = asked.select("id", "day").distinct()
    for name, found in sources:
        out = out.join(found.select("id", "day", F.struct("val", "end").alias(name)), ["id", "day"], "left")
    label = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n, _ in sources])
    return out.select("id", "day", F.coalesce(*[n for n, _ in sources]).alias("f"), label.alias("source")).select("id", "day", "f.val", "f.end", "source")


def fundamentals(events: DataFrame, rets: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, log_mcap, bm, turnover: facts has doc_id, shares, equity. Nulls where a part is missing
    or not positive; volume is that of sessions -252 to -6."""
    none = rets.select("idx").distinct().withColumn("ret", F.lit(None).cast("double"))
    x = over_sessions(rets, none, {"year": (-252, -6, ("volume",))})
    x = x.select("ticker", F.col("idx").alias("i0"), F.lag("close").over(Window.partitionBy("ticker").orderBy("idx")).alias("close_before"), _of("year", "volume").alias("volume_year"))
    return sized(events.select("doc_id", "ticker", "i0").join(x, ["ticker", "i0"], "left"), facts)


def sized(events: DataFrame, facts: DataFrame) -> DataFrame:
    """doc_id, log_mcap, bm, turnover of events with close_before and volume_year (see `fundamentals`)."""
    x = events.select("doc_id", "close_before", "volume_year").join(facts, "doc_id", "left").withColumn("mcap", F.col("close_before") * F.col("shares"))
    known = F.col("mcap") > 0
    return x.select(
        "doc_id", F.when(known, F.log("mcap")).alias("log_mcap"), F.when(known & (F.col("equity") > 0), F.col("equity") / F.col("mcap")).alias("bm"),
        F.when(F.col("shares") > 0, F.coalesce("volume_year", F.lit(0.0)) / F.col("shares")).alias("turnover"),
    )


def controls(events: DataFrame, rets: DataFrame, market: DataFrame) -> DataFrame:
    """doc_id, log_tradeval, pre_ret, zero_share, volume_year: what the sessions before an event show.

    Sessions outside the calendar do not count; pre_ret is 0 without a day that has both returns."""
    spans = {"est": (-150, -11, ("zero", "days")), "year": (-252, -6, ("volume", "volumes")), "month": (-30, -2, ("own", "mkt")), "quarter": (-60, -1, ("worth", "worths"))}
    x = over_sessions(rets, market, spans)
    value = _ratio(_of("quarter", "worth"), _of("quarter", "worths", True))
    x = x.select(
        "ticker", F.col("idx").alias("i0"), F.when(value > 0, F.log(value)).alias("log_tradeval"), (_of("month", "own") - _of("month", "mkt")).alias("pre_ret"),
        _ratio(_of("est", "zero", True), _of("est", "days", True)).alias("zero_share"), F.when(_of("year", "volumes", True) > 0, _of("year", "volume")).alias("volume_year"),
    )
    return events.select("doc_id", "ticker", "i0").join(x, ["ticker", "i0"]).drop("ticker", "i0")


def news_windows(events: DataFrame, news: DataFrame, lo: int, hi: int, topics: Sequence[str] = ()) -> DataFrame:
    """Every item of the event's ticker in sessions [lo, hi] around it, with its offset k: doc_id, k, kind, n
    and whether one of them has each topic.

    Items are counted per (ticker, idx, kind) before the join, so a busy session is one row.
    """
    daily = news.groupBy("ticker", "idx", "kind").agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(t).alias(t) for t in topics])
    spread = events.select("doc_id", "ticker", "i0", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("k"))
    return spread.withColumn("idx", F.col("i0") + F.col("k")).join(daily, ["ticker", "idx"]).select("doc_id", "k", "kind", "n", *topics)


def news_counts(events: DataFrame, news: DataFrame, spans: Mapping[str, tuple[int, int]], kinds: Sequence[str], topics: Mapping[str, tuple[int, int]] = {}) -> DataFrame:  # noqa: B006
    """doc_id and, by window, n_<window> (all items) and <kind>_<window> of the event's ticker, zeros where
    there are none; and by topic whether an item within its sessions has it. spans: window -> sessions
    (lo, hi) around the event; topics: a boolean column of news -> sessions."""
    every = [*spans.values(), *topics.values()]
    lo, hi = min(a for a, _ in every), max(b for _, b in every)
    x = news_windows(events.where("i0 IS NOT NULL"), news, lo, hi, list(topics))
    sums = []
    for name, (a, b) in spans.items():
        here = F.col("k").between(a, b)
        sums.append(F.sum(F.when(here, F.col("n"))).alias(f"n_{name}"))
        sums += [F.sum(F.when(here & (F.col("kind") == kind), F.col("n"))).alias(f"{kind}_{name}") for kind in kinds]
    met = [F.bool_or(F.col(t) & F.col("k").between(a, b)).alias(t) for t, (a, b) in topics.items()]
    return events.select("doc_id").join(x.groupBy("doc_id").agg(*sums, *met), "doc_id", "left").na.fill(0).na.fill(False)


def coverage(news: DataFrame, unit: str, crawled: Column, least_tickers: int = 10, share: float = 0.25) -> DataFrame:
    """period, n, n_tickers, per_ticker, gap over the whole spine of periods between the first and last item.

    news: ticker, ts. n_tickers: tickers whose first day is not after the period's start; a period is judged
    where they are least_tickers or more and it lies before the period of `crawled`; it is a gap if
    its items per ticker, rounded to 2 places, are under `share` of the median of the judged ones."""
    start = F.date_trunc(unit, F.col("ts"))
    n = news.groupBy(start.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    spine = n.agg(F.min("period").alias("a"), F.max("period").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("period"))
    first = news.groupBy("ticker").agg(F.min("ts").alias("first"))
    covered = F.when(F.date_trunc(unit, "first") == F.col("first"), F.col("first")).otherwise(F.date_trunc(unit, "first") + F.expr(f"interval 1 {unit}"))
    new = first.groupBy(covered.alias("period")).agg(F.count(F.lit(1)).alias("new"))
    x = spine.join(n, "period", "left").join(new, "period", "left").na.fill(0)
    tickers = F.sum("new").over(Window.orderBy("period"))  # a row per period
    x = x.select("period", "n", tickers.alias("n_tickers"))
    x = x.withColumn("per_ticker", F.when(F.col("n_tickers") > 0, F.round(F.col("n") / F.col("n_tickers"), 2)))
    judged = (F.col("n_tickers") >= least_tickers) & (F.col("period") < F.date_trunc(unit, crawled))
    middle = x.where(judged).agg(F.median("per_ticker").alias("middle"))  # a row per period
    gap = judged & (F.col("per_ticker") < share * F.col("middle"))
    return x.crossJoin(F.broadcast(middle)).select("period", "n", "n_tickers", "per_ticker", F.coalesce(gap, F.lit(False)).alias("gap"))


def touching(events: DataFrame, sessions: DataFrame, periods: DataFrame, unit: str, reach: int = 10) -> DataFrame:
    """doc_id, touches of events (doc_id, i0): whether a session up to `reach` before or after i0 lies in one of
    the `periods` (column period, the start of a unit). False for an event without a session.

    Sessions outside the calendar do not count. Marks are made on the calendar, a row per session; events
    meet it by one equi-join."""
    flagged = periods.select(F.col("period").cast("timestamp_ntz").alias("period")).distinct().withColumn("hit", F.lit(1))
    marked = sessions.withColumn("period", F.date_trunc(unit, F.col("date").cast("timestamp_ntz")).cast("timestamp_ntz")).join(F.broadcast(flagged), "period", "left")  # a row per period
    near = F.max("hit").over(Window.orderBy("idx").rowsBetween(-reach, reach))
    met = marked.select(F.col("idx").alias("i0"), near.isNotNull().alias("touches"))
    return events.select("doc_id", "i0").join(met, "i0", "left").select("doc_id", F.coalesce("touches", F.lit(False)).alias("touches"))


def date_lags(lags: DataFrame, column: str = "lag") -> DataFrame:
    """n, median, p10, p90, same, later, earlier of the sessions between two dates of events; nulls are left
    out. Lags are summed up by value, of which there are few, before the quantiles."""
    known = lags.where(F.col(column).isNotNull())
    q = quantiles(known, column, [0.5, 0.1, 0.9])
    lag = F.col(column)
    made = [F.lit(v).cast("double").alias(n) for v, n in zip(q, ("median", "p10", "p90"), strict=True)]
    return known.agg(F.count(F.lit(1)).alias("n"), *made, F.count_if(lag == 0).alias("same"), F.count_if(lag > 0).alias("later"), F.count_if(lag < 0).alias("earlier"))


def earliest(disclosures: DataFrame, wanted: str, excluded: str) -> DataFrame:
    """ticker, fy, ts, title of the first disclosure (ticker, ts, title) of each ticker and fiscal year
    whose title matches `wanted` and not `excluded`; fy is the last year 20xx it names. Ties by title."""
    x = disclosures.where(F.col("title").rlike(wanted) & ~F.col("title").rlike(excluded)).withColumn("fy", fiscal_year(F.col("title")))
    first = x.where("fy IS NOT NULL").groupBy("ticker", "fy").agg(F.min(F.struct("ts", "title")).alias("m"))
    return first.select("ticker", "fy", "m.ts", "m.title")
