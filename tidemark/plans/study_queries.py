"""Queries on the event study's further columns, its tests, and the tables of models, with their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import inference, regression, stats
from ..operators import market as mk
from ..sources import tables as src
from ..sources.files import stored
from .panel_queries import CONTROLS_A, CONTROLS_B, EVENTS_OF, FUND, MAIN, NEWS, PANEL, PRE, TONE_CTES, TONES, WINDOWS, _clip, _clipped_tones, _facts, _news, _panel, _tone_panel
from .queries import DOCS, EVENTS, ITEMS, PLACEBO, TONE, TOUCHED, _events, _gap_months, _study, query, r

SPANS = ((0, 3), (0, 1), (-1, 1), (0, 5), (0, 10))

_window = "SELECT doc_id, {a} AS lo, {b} AS hi, sum(ar) AS car, sum(ar) / (any_value(sigma) * sqrt({n})) AS scar, sum(ret - mret) AS carma FROM win WHERE k BETWEEN {a} AND {b} GROUP BY doc_id HAVING count(ar) = {n}"
FAMILY = " UNION ALL ".join(_window.format(a=a, b=b, n=b - a + 1) for a, b in SPANS)


def _family(spark, sf_dir):
    _, ok, rets, m = _events(spark, sf_dir)
    return mk.car_family(ok, mk.market_model(ok, rets, m, 80), rets, m, SPANS)


@query(f"WITH {EVENTS}, f AS ({FAMILY}) SELECT doc_id, lo, hi, round(car, 8) AS car, round(scar, 6) AS scar, round(carma, 8) AS carma FROM f")
def car_family(spark, sf_dir):
    return _family(spark, sf_dir).select("doc_id", "lo", "hi", r(F.col("car")).alias("car"), r(F.col("scar"), 6).alias("scar"), r(F.col("carma")).alias("carma"))


@query(f"WITH {EVENTS}, {PRE} SELECT doc_id, n_obs, round(pre_alpha, 8) AS pre_alpha FROM pa")
def pre_alpha(spark, sf_dir):
    """The market model's intercept over sessions -252 to -6, cut off at the first session."""
    _, ok, rets, m = _events(spark, sf_dir)
    return mk.market_model(ok, rets, m, 80, -252, -6).select("doc_id", "n_obs", r(F.col("alpha")).alias("pre_alpha"))


@query(f"WITH {EVENTS}, {FUND} SELECT doc_id, round(log_mcap, 8) AS log_mcap, round(bm, 10) AS bm, round(turnover, 8) AS turnover FROM funda")
def event_fundamentals(spark, sf_dir):
    _, ok, rets, _ = _events(spark, sf_dir)
    x = mk.fundamentals(ok, rets, _facts(spark, sf_dir))
    return x.select("doc_id", r(F.col("log_mcap")).alias("log_mcap"), r(F.col("bm"), 10).alias("bm"), r(F.col("turnover")).alias("turnover"))


ANNUAL = (
    "WITH f AS (SELECT o_custkey AS id, o_orderdate::DATE AS filed, (o_orderdate::DATE - 30)::DATE AS \"end\", (o_orderdate::DATE - 30 - 300 - (o_orderkey % 100)::INT)::DATE AS start, o_totalprice AS val FROM orders), "
    "a AS (SELECT c_custkey AS id, (DATE '1996-01-01' + (c_custkey % 1500)::INT)::DATE AS day FROM customer), "
    "j AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"end\" DESC, filed DESC, val DESC) AS k FROM a JOIN f USING (id) WHERE filed <= day + 3 AND \"end\" <= day AND \"end\" > day - 400 {more}) "
)
_pick = "SELECT id, day, val, \"end\" FROM j WHERE k = 1"
PRIORITY = ANNUAL.format(more='AND "end" - start BETWEEN 350 AND 380').replace("WITH f", "WITH p AS (WITH f", 1) + _pick + "), " + ANNUAL.format(more="").replace("WITH f", "l AS (WITH f", 1) + _pick + ") "


@query(
    PRIORITY + "SELECT c.c_custkey AS id, coalesce(p.val, l.val) AS val, CASE WHEN p.id IS NOT NULL THEN p.\"end\" ELSE l.\"end\" END AS \"end\", CASE WHEN p.id IS NOT NULL THEN 'annual' WHEN l.id IS NOT NULL THEN 'any' END AS source "
    "FROM customer c LEFT JOIN p ON p.id = c.c_custkey LEFT JOIN l ON l.id = c.c_custkey"
)
def fact_by_priority(spark, sf_dir):
    """The latest fact of a year's period, else of any period, with its source."""
    o, filed = src.table(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    end = F.date_sub(filed, 30)
    start = F.date_sub(end, (300 + F.col("o_orderkey") % 100).cast("int"))
    facts = o.select(F.col("o_custkey").alias("id"), filed.alias("filed"), end.alias("end"), start.alias("start"), F.col("o_totalprice").alias("val"))
    c = src.table(spark, sf_dir, "customer")
    asked = c.select(F.col("c_custkey").alias("id"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 1500).cast("int")).alias("day"))
    found = mk.fact_by_priority(asked, [("annual", mk.latest_fact(asked, facts, annual=True)), ("any", mk.latest_fact(asked, facts))])
    return found.select("id", "val", "end", "source")


TITLES = "SELECT o_custkey % 50 AS ticker, o_orderdate AS ts, 'annual report ' || (year(o_orderdate) + 5) || ' of ' || o_orderpriority AS title FROM orders"


@query(f"""WITH t AS ({TITLES}), k AS (SELECT *, regexp_extract(title, '20[0-9][0-9]')::INT AS fy FROM t WHERE regexp_matches(title, 'annual report') AND NOT regexp_matches(title, '(?i)urgent|high') AND regexp_matches(title, '20[0-9][0-9]'))
SELECT ticker, fy, ts, title FROM (SELECT *, row_number() OVER (PARTITION BY ticker, fy ORDER BY ts, title) AS n FROM k) WHERE n = 1""")
def earliest_disclosure(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders")
    title = F.concat(F.lit("annual report "), F.year("o_orderdate") + 5, F.lit(" of "), F.col("o_orderpriority"))
    return mk.earliest(o.select((F.col("o_custkey") % 50).alias("ticker"), F.col("o_orderdate").alias("ts"), title.alias("title")), "annual report", "(?i)urgent|high")


#: Label -> the event study's column that is tested, and that of its standardised form.
TESTED = {f"CAR[{a},{b}]": mk.span_name("car", a, b) for a, b in SPANS} | {f"CAR market-adjusted[{a},{b}]": mk.span_name("carma", a, b) for a, b in SPANS} | {"BHAR[0,3]": "bhar_0_3", "PLACEBO CAR[0,3]": "placebo_car_0_3"}
SCALED = {f"CAR[{a},{b}]": mk.span_name("scar", a, b) for a, b in SPANS}


def _tested(spark, sf_dir):
    return stored(_study(spark, sf_dir).select("doc_id", *TESTED.values(), *SCALED.values()), "car-wide")


@query()
def car_tests(spark, sf_dir):
    """Tests of mean 0 of every window, the market-adjusted, buy-and-hold and placebo returns, with p-values;
    `car_sign_tests` holds what SQL can say of them."""
    return inference.mean_tests(_tested(spark, sf_dir), TESTED, SCALED)


_values = ["SELECT 'CAR[' || lo || ',' || hi || ']' AS label, car AS v, scar AS z FROM f", "SELECT 'CAR market-adjusted[' || lo || ',' || hi || ']', carma, NULL FROM f", "SELECT 'BHAR[0,3]', bhar, NULL FROM cr", "SELECT 'PLACEBO CAR[0,3]', placebo, NULL FROM pc"]


@query(f"""WITH {EVENTS}, {WINDOWS}, {PLACEBO}, f AS ({FAMILY}), lv AS ({' UNION ALL '.join(_values)}), s AS (SELECT label, count(v) AS n, count(*) FILTER (v > 0) AS up, avg(v) AS m, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS med, avg(z) AS sm, stddev_samp(z) AS ss, count(z) AS nz FROM lv GROUP BY label)
SELECT label, n, round(100 * m, 6) AS mean_pct, round(100 * med, 6) AS median_pct, round(m / (sd / sqrt(n)), 5) AS t, round(100.0 * up / n, 6) AS pct_positive, CASE WHEN nz > 0 THEN round(sm / (ss / sqrt(n)), 5) END AS t_bmp,
round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))) FROM range(0, least(up, n - up) + 1) g(i))), 6) AS p_sign FROM s""")
def car_sign_tests(spark, sf_dir):
    t = inference.mean_tests(_tested(spark, sf_dir), TESTED, SCALED)
    return t.select("label", "n", *[r(F.col(c), 6).alias(c) for c in ("mean_pct", "median_pct", "pct_positive", "p_sign")], r(F.col("t"), 5).alias("t"), r(F.col("t_bmp"), 5).alias("t_bmp"))


def fit_sql(model: str, y: str, x: str, others: Sequence[str] = (), panel: str = "panel", where: str = "true", digits: int = 6) -> str:
    """One tone with controls and year effects, clustered by ticker, as a row of a table of models.

    Year means are taken off, then each control's part in turn; what is left of y and x gives the
    tone's coefficient and error as the whole regression would."""
    names = [y, x, *others]
    steps = [f"u AS (SELECT ticker, year, {', '.join(f'({c})::DOUBLE AS v{i}' for i, c in enumerate(names))} FROM {panel} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names)} AND ({where}))"]
    steps.append(f"d{len(names)} AS (SELECT ticker, {', '.join(f'v{i} - avg(v{i}) OVER (PARTITION BY year) AS v{i}' for i in range(len(names)))} FROM u)")
    for k in range(len(names) - 1, 1, -1):
        steps.append(f"d{k} AS (SELECT ticker, {', '.join(f'v{i} - v{k} * (sum(v{i} * v{k}) OVER ()) / (sum(v{k} * v{k}) OVER ()) AS v{i}' for i in range(k))} FROM d{k + 1})")
    return f"""SELECT '{model}' AS model, '{y}' AS y, '{x}' AS term, round(b, {digits}) AS coef, round(sqrt(m / sxx ^ 2 * g / (g - 1) * (n - 1) / (n - k)), {digits}) AS se, n AS n_obs FROM (
WITH {', '.join(steps)}, b AS (SELECT sum(v1 * v0) / sum(v1 * v1) AS b, sum(v1 * v1) AS sxx, count(*) AS n, (SELECT count(DISTINCT year) FROM u) + {1 + len(others)} AS k FROM d2), s AS (SELECT ticker, sum(v1 * (v0 - b * v1)) AS s FROM d2, b GROUP BY ticker)
SELECT b, sxx, n, k, sum(s * s) AS m, count(*) AS g FROM s, b GROUP BY ALL)"""


def _rows(fitted, *more):
    return fitted.where(F.col("term").endswith("_z")).select(*more, "model", "y", "term", r(F.col("coef"), 6).alias("coef"), r(F.col("se"), 6).alias("se"), "n_obs")


#: All other returns than the main one.
ROBUST = {"market-adjusted": "carma", "BHAR": "bhar", "placebo": "placebo", "CAR[0,1]": "car_0_1", "CAR[-1,1]": "car_m1_1", "CAR[0,5]": "car_0_5", "CAR[0,10]": "car_0_10"}
#: The tones of each model of the main return; a model whose tones the panel lacks falls away.
OWN = {
    "M1 base": [], "M2 fin_neg": ["neg_z"], "M3 gen_neg": ["gen_neg_z"], "M4 both": ["neg_z", "gen_neg_z"], "M5 net and unc": ["net_z", "unc_z"],
    "M6 tf-idf": ["neg_tfidf_z"], "M7 section": ["finA_neg_z"], "M8 model": ["finbert_net_z"],
}
MORE = ("gen_neg", "neg_tfidf", "finA_neg")
WIDE = f"""{PANEL}, {TONE_CTES}, w0 AS (SELECT panel.*, gen_neg, fin_neg_tfidf AS neg_tfidf, finA_neg FROM panel JOIN tp USING (doc_id)),
wide AS (SELECT *, {', '.join(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_z' for c in MORE)} FROM w0)"""


def _main_sql(digits: int = 6) -> str:
    there = {f"{c}_z" for c in (*TONES, *MORE)}
    return " UNION ALL ".join(fit_sql(m, "car", x, [*[t for t in tones if t != x], *CONTROLS_A], "wide", digits=digits) for m, tones in OWN.items() if set(tones) <= there for x in tones)


def _robust_sql(digits: int = 6) -> str:
    return " UNION ALL ".join(fit_sql(n, y, "neg_z", CONTROLS_A, digits=digits) for n, y in ROBUST.items())


def _with_general(spark, sf_dir):
    """The panel with the general lexicon's, the tf-idf and the alternative text's measure, standardised."""
    t = _tone_panel(spark, sf_dir).select("doc_id", "gen_neg", F.col("fin_neg_tfidf").alias("neg_tfidf"), "finA_neg")
    x = stored(_panel(spark, sf_dir).join(t, "doc_id"), "panel-general")
    for c in MORE:
        x = stats.zscore(x, c, f"{c}_z")
    return stored(x, "panel-wide")


def _main_models(p):
    controls = inference.chosen_controls(p, CONTROLS_A)
    return inference.models(p, {n: ("car", [*tones, *controls]) for n, tones in OWN.items()}, "ticker", ["year"])


def _robust_models(p):
    """The tone coefficient for other returns; a model needs more than 30 of them, and its columns."""
    controls = inference.chosen_controls(p, CONTROLS_A)
    specs = {n: (y, ["neg_z", *controls]) for n, y in ROBUST.items()} | {"absent": ("no_such_return", ["neg_z"])}
    return inference.models(p, specs, "ticker", ["year"], 30)


@query(f"WITH {PANEL} {_robust_sql()}")
def robustness_fits(spark, sf_dir):
    return _rows(_robust_models(_panel(spark, sf_dir)))


@query(f"WITH {WIDE}, mag AS (SELECT 'main' AS sheet, * FROM ({_main_sql(15)}) UNION ALL SELECT 'robustness', * FROM ({_robust_sql(15)})) SELECT sheet, model, term, round(coef, 5) AS coef, round(100 * coef, 3) AS effect_pct FROM mag")
def economic_magnitude(spark, sf_dir):
    """Points of return, in percent, for one standard deviation of tone, from both tables of models."""
    p = _with_general(spark, sf_dir)
    f = _main_models(p).withColumn("sheet", F.lit("main")).unionByName(_robust_models(p).withColumn("sheet", F.lit("robustness")))
    m = inference.magnitudes(f, "sheet")
    return m.select("sheet", "model", "term", r(F.col("coef"), 5).alias("coef"), r(F.col("effect_pct"), 3).alias("effect_pct"))


CONTAMINATED = "hit AS (SELECT doc_id, EXISTS (SELECT 1 FROM news n WHERE n.ticker = ev.ticker AND n.kind = '1-URGENT' AND n.pos BETWEEN i0 AND i0 + 3) AS overlap FROM ev)"
SAMPLES = {"all": "true", "clean": "NOT overlap", "overlapping": "overlap"}
SAMPLE_TONES = ("neg_z", "gen_neg_z")


def _overlap(spark, sf_dir, events):
    met = mk.news_windows(events, _news(spark, sf_dir, False).where("kind = '1-URGENT'"), 0, 3).select("doc_id").distinct()
    return events.select("doc_id").join(met.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("overlap"))


@query(
    f"WITH {WIDE}, {NEWS}, {CONTAMINATED}, marked AS (SELECT * FROM wide JOIN hit USING (doc_id)) "
    + " UNION ALL ".join(f"SELECT '{s}' AS sample, * FROM ({fit_sql(x, 'car', x, CONTROLS_B, 'marked', w)})" for s, w in SAMPLES.items() for x in SAMPLE_TONES)
)
def subsample_fits(spark, sf_dir):
    """Both tones' coefficients on all events, and on those without and with other news in sessions 0 to 3."""
    p = _with_general(spark, sf_dir)
    p = stored(p.join(_overlap(spark, sf_dir, p.select("doc_id", "ticker", "i0")), "doc_id"), "panel-marked")
    controls = inference.chosen_controls(p, CONTROLS_B)
    specs = {x: ("car", [x, *controls]) for x in SAMPLE_TONES}
    return _rows(inference.by_sample(p, {s: F.expr(w) for s, w in SAMPLES.items()}, specs, "ticker", ["year"]), "sample")


#: The registered tests: label, whether by second dates, sample, tone, return. S1 takes second event dates
#: (documents of even id, three days later), S2 the change of tone over the year before, S3 events that no
#: other news overlaps (then also none that touches a gap month), S4 all of these.
TESTS = (
    ("M2", False, "true", "neg", "car"), ("S1 first dates", False, "dated", "neg", "car"), ("S1", True, "true", "neg", "car"), ("S1", True, "true", "neg", "car_0_5"),
    ("S2", False, "true", "d_neg", "car"), ("S2", False, "true", "d_neg", "car_0_5"), ("S2 net", False, "true", "d_net", "car"),
    ("S3", False, "NOT overlap", "neg", "car"), ("S3", False, "NOT overlap", "neg", "car_0_5"), ("S3 no gap", False, "NOT overlap AND NOT touches", "neg", "car"),
    ("S4", True, "NOT overlap", "d_neg", "car"), ("S4", True, "NOT overlap", "d_neg", "car_0_5"),
)
_moved = "event_date) + after_close::INT AS i0 FROM docs d"
assert _moved in EVENTS
EVENTS2 = EVENTS.replace(_moved, "event_date + 3) + after_close::INT AS i0 FROM docs d WHERE doc_id % 2 = 0")
_t = TONE.replace(DOCS + ", ", "")
_change = """yearly AS (SELECT ticker, year, avg(neg) AS neg, avg(net) AS net FROM tw JOIN docs USING (doc_id) GROUP BY ALL),
delta AS (SELECT doc_id, t.neg - p.neg AS d_neg, t.net - p.net AS d_net FROM tw t JOIN docs USING (doc_id) JOIN yearly p ON p.ticker = docs.ticker AND p.year + 1 = docs.year)"""
_columns = "doc_id, ticker, year, neg, net, d_neg, d_net, car, car_0_5, pre_ret, log_tradeval, beta, ln(greatest(n_words, 1)) AS log_len, (ticker % 2 = 0)::INT AS vn30, overlap, touches"


def _base_sql(events: str) -> str:
    return f"WITH {events}, {_t}, {EVENTS_OF}, {NEWS}, {CONTAMINATED}, {ITEMS}, touch AS ({TOUCHED}), {_change} SELECT {_columns} FROM j0 JOIN hit USING (doc_id) JOIN touch USING (doc_id) LEFT JOIN delta USING (doc_id)"


def _test_sql(label: str, second: bool, where: str, x: str, y: str) -> str:
    q = f"(SELECT quantile_cont({y}, [0.01, 0.99]) AS {y}, quantile_cont(pre_ret, [0.01, 0.99]) AS pre_ret FROM s) q"
    rows = f"""(WITH s AS (SELECT * FROM base WHERE second = {str(second).lower()} AND ({where})), w AS (SELECT s.* REPLACE ({_clip(y, 's')} AS {y}, {_clip('pre_ret', 's')} AS pre_ret) FROM s, {q})
SELECT *, ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () AS {x}_z FROM w WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""
    return fit_sql(label, y, f"{x}_z", CONTROLS_A, rows)


REGISTERED = f"""WITH b1 AS ({_base_sql(EVENTS)}), b2 AS ({_base_sql(EVENTS2)}),
base AS MATERIALIZED (SELECT *, doc_id IN (SELECT doc_id FROM b2) AS dated, false AS second FROM b1 UNION ALL SELECT *, true, true FROM b2), f AS ({' UNION ALL '.join(_test_sql(*t) for t in TESTS)})
SELECT *, 0.0125::DOUBLE AS alpha FROM f"""


def _base(spark, sf_dir):
    """Events by both sets of dates, with the change of tone, other news, gap months; returns are not clipped."""
    ev, _, rets, m = _events(spark, sf_dir)
    cal = mk.calendar(rets.select("date"))
    study, tones = stored(mk.session_study(rets, m), "session-study"), _clipped_tones(spark, sf_dir)
    d = src.disclosures(spark, sf_dir).drop("text")
    later = mk.event_sessions(d.where("doc_id % 2 = 0").withColumn("event_date", F.date_add("event_date", 3)), cal)
    both = ev.withColumn("second", F.lit(False)).unionByName(later.withColumn("second", F.lit(True)))
    x = mk.event_study(both, study).withColumnsRenamed(MAIN)
    t = stored(tones.join(d.select("doc_id", "ticker", "year"), "doc_id"), "dated-tones")
    last = t.groupBy("ticker", (F.col("year") + 1).alias("year")).agg(F.avg("neg").alias("neg0"), F.avg("net").alias("net0"))
    t = t.join(last, ["ticker", "year"], "left").select("doc_id", "n_words", "neg", "net", (F.col("neg") - F.col("neg0")).alias("d_neg"), (F.col("net") - F.col("net0")).alias("d_net"))
    x = stored(x.join(t, "doc_id").withColumn("event", F.concat_ws(":", "doc_id", "second")), "dated-events")
    keyed = x.select(F.col("event").alias("doc_id"), "ticker", "i0")
    marks = [_overlap(spark, sf_dir, keyed), mk.touching(keyed, cal, _gap_months(spark, sf_dir), "month")]
    for mark in marks:
        x = x.join(mark.withColumnRenamed("doc_id", "event"), "event")
    dated = x.where("second").select("doc_id", F.lit(True).alias("dated"))
    x = x.join(dated, "doc_id", "left").na.fill(False, ["dated"])
    return stored(x.withColumns({"log_len": F.log(F.greatest("n_words", F.lit(1))), "vn30": (F.col("ticker") % 2 == 0).cast("int")}), "dated-base")


_both = f"WITH a AS (WITH {EVENTS} SELECT doc_id, i0 FROM ev), b AS (WITH {EVENTS2} SELECT doc_id, i0 FROM ev), l AS (SELECT b.i0 - a.i0 AS lag FROM a JOIN b USING (doc_id) WHERE a.i0 IS NOT NULL AND b.i0 IS NOT NULL)"


@query(f"{_both} SELECT count(*) AS n, quantile_cont(lag, 0.5) AS median, quantile_cont(lag, 0.1) AS p10, quantile_cont(lag, 0.9) AS p90, count(*) FILTER (lag = 0) AS same, count(*) FILTER (lag > 0) AS later, count(*) FILTER (lag < 0) AS earlier FROM l")
def event_date_lags(spark, sf_dir):
    """Sessions from an event's first date to its second: quantiles, and how many agree, are later or earlier."""
    d, cal = src.disclosures(spark, sf_dir).drop("text"), mk.calendar(stored(src.prices(spark, sf_dir), "prices"))
    first = mk.event_sessions(d, cal).select("doc_id", "i0")
    second = mk.event_sessions(d.where("doc_id % 2 = 0").withColumn("event_date", F.date_add("event_date", 3)), cal).select("doc_id", F.col("i0").alias("i1"))
    return mk.date_lags(first.join(second, "doc_id").select((F.col("i1") - F.col("i0")).alias("lag")))


@query(REGISTERED)
def preregistered_tests(spark, sf_dir):
    """The registered tests and their controls: a sample's returns are clipped and its tone standardised
    within the sample; each of four main tests must pass .05 over four."""
    f = inference.sample_models(_base(spark, sf_dir), [(label, F.expr(f"second = {second} AND ({where})"), x, y) for label, second, where, x, y in TESTS], CONTROLS_A, "ticker", ["year"], clipped=("pre_ret",))
    return _rows(inference.corrected(f, 4), "alpha")


def _partial_sql(rounds: int = 14) -> str:
    """CTEs: lines, then alternately less the means of part and customer, and y and x less what z explains."""
    columns = ("y", "x", "z")
    out = "u AS (SELECT l_suppkey AS g, l_partkey AS a, o_custkey AS b, l_extendedprice / 1000 AS y, l_quantity AS x, l_discount AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    last = "u"
    for i in range(rounds):
        for by in "ab":
            out += f", {by}{i} AS (SELECT g, a, b, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}' for c in columns)} FROM {last})"
            last = f"{by}{i}"
    return out + f", w AS (SELECT g, y - z * (sum(y * z) OVER ()) / (sum(z * z) OVER ()) AS y, x - z * (sum(x * z) OVER ()) / (sum(z * z) OVER ()) AS x FROM {last})"


@query(f"""WITH {_partial_sql()}, f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, 2 + (SELECT count(DISTINCT a) + count(DISTINCT b) - 1 FROM u) AS k FROM w),
s AS (SELECT g, sum(x * (y - f.b * x)) AS s FROM w, f GROUP BY g), v AS (SELECT sum(s * s) AS m, count(*) AS c FROM s)
SELECT 'quantity' AS term, round(b, 7) AS coef, round(sqrt(m / sxx ^ 2 * c / (c - 1) * (n - 1) / (n - k)), 7) AS se, n AS n_obs, c AS n_clusters FROM f, v""")
def two_way_effects(spark, sf_dir):
    """Price on quantity and discount with effects of parts and customers, clustered by supplier."""
    x = src.table(spark, sf_dir, "lineitem").join(src.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = stored(x.select("l_suppkey", "l_partkey", "o_custkey", (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")), "lines")
    f = regression.clustered(x, "price", ["quantity", "discount"], "l_suppkey", absorbed=("l_partkey", "o_custkey"))
    return f.where("term = 'quantity'").select("term", r(F.col("coef"), 7).alias("coef"), r(F.col("se"), 7).alias("se"), "n_obs", "n_clusters")


CANDIDATES = (*CONTROLS_A, "log_mcap", "no_such_control")


@query(f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS control, count({c}) / count(*) > 0.5 AS chosen FROM panel" for c in CANDIDATES[:-1]) + " UNION ALL SELECT 'no_such_control', false")
def control_choice(spark, sf_dir):
    """Which controls a model takes: columns that exist and are known for over half of the rows."""
    chosen = inference.chosen_controls(_panel(spark, sf_dir), CANDIDATES)
    return spark.createDataFrame([(c, c in chosen) for c in CANDIDATES], "control string, chosen boolean")


@query()
def ols_specifications(spark, sf_dir):
    """All model specifications side by side: a row per model and term; models without their variables
    are left out. `specification_tones` holds what SQL can say of them."""
    return _main_models(_with_general(spark, sf_dir))


@query(f"WITH {WIDE} {_main_sql()}")
def specification_tones(spark, sf_dir):
    """The tones' rows of the table of models."""
    return _rows(_main_models(_with_general(spark, sf_dir)))


@query()
def regression_cells(spark, sf_dir):
    """The table of models as printed: "b* (se)" by term, N and adjusted R2."""
    return inference.cells(_main_models(_with_general(spark, sf_dir)))
