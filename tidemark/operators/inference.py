"""Tests of means, tables of models, and the arithmetic of p-values; Spark sums, the driver solves.

Only counts and moments reach the driver. The signed-rank test needs ranks of absolute values: they
come from `stats.average_ranks`, which spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from . import regression, stats


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 500):
        step = 1.0
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or tiny)
            c = 1 + k / c or tiny
            step *= c * d
            total *= c * d
        if abs(step - 1) < 1e-14:
            break
    return front * total


def t_tail(t: float | None, freedom: float) -> float | None:
    """Two-sided p of a t statistic."""
    if t is None or freedom <= 0 or math.isnan(t):
        return None
    return beta_share(freedom / 2, 0.5, freedom / (freedom + t * t))


def sign_tail(k: int, n: int) -> float:
    """Two-sided exact p of k of n signs, each as likely as not; outcomes no likelier than k count."""
    if not n:
        return 1.0
    log_half = n * math.log(0.5)
    far = min(k, n - k)  # by symmetry both tails are alike
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + log_half) for i in range(far + 1))
    return min(1.0, 2 * tail)


#: From so many differences on, or with ties or zeros, the signed-rank sum is taken as normal.
EXACT_RANKS = 50


def signed_rank_tail(positive: float, n: int, tie_term: float, exact: bool) -> float | None:
    """Two-sided p of the sum of the positive ranks of n differences that are not zero.

    exact: over all 2**n signs, by counting the subsets of 1..n with each sum; else normal, with the
    variance less tie_term / 48 (the sum of t**3 - t over groups of t equal ranks)."""
    if n < 1:
        return None
    total = n * (n + 1) / 2
    least = min(positive, total - positive)
    if exact:
        ways = [1] + [0] * int(total)
        for r in range(1, n + 1):
            for s in range(int(total), r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    return math.erfc(abs(positive - total / 2) / spread / math.sqrt(2)) if spread else 1.0


TESTS = "label string, n long, mean_pct double, median_pct double, t double, p_t double, p_wilcoxon double, pct_positive double, p_sign double, t_bmp double"


def mean_tests(df: DataFrame, columns: Mapping[str, str], scaled: Mapping[str, str] | None = None, least: int = 5) -> DataFrame:
    """A row per label: n, mean and median in percent, t, signed-rank and exact sign test of mean 0.

    columns: label -> column; scaled: label -> column of standardised values, whose t is t_bmp. Nulls
    are left out; a column with fewer than `least` values has no row; without spread t is null.
    """
    spark, rows = df.sparkSession, []
    labels, scaled = list(columns), scaled or {}
    asked = list(dict.fromkeys([*columns.values(), *scaled.values()]))
    moments = [f(F.col(c)).alias(f"{k}_{c}") for c in asked for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("up", lambda x: F.count_if(x > 0)), ("zero", lambda x: F.count_if(x == 0)))]
    m = df.agg(*moments).first()
    labels = [x for x in labels if m[f"n_{columns[x]}"] >= least]
    if not labels:
        return spark.createDataFrame([], TESTS)
    used = list(dict.fromkeys(columns[x] for x in labels))
    middle = {c: q[0] for c, q in stats.quantiles_of(df, used, [0.5]).items()}
    ranks = {r["name"]: r for r in stats.signed_ranks(df, used).collect()}  # a row per column
    for label in labels:
        c = columns[label]
        n, mean, sd, up, zero = (m[f"{k}_{c}"] for k in ("n", "mean", "sd", "up", "zero"))
        w = ranks.get(c)
        exact = n - zero <= EXACT_RANKS and not zero and w is not None and w["most"] == 1
        t = mean / (sd / math.sqrt(n)) if sd else None
        z = scaled.get(label)
        bmp = m[f"mean_{z}"] / (m[f"sd_{z}"] / math.sqrt(m[f"n_{z}"])) if z and m[f"sd_{z}"] else None
        p_rank = signed_rank_tail(w["up"], n - zero, w["ties"], exact) if w else None
        rows.append((label, n, 100 * mean, 100 * middle[c], t, t_tail(t, n - 1), p_rank, 100 * up / n, sign_tail(up, n), bmp))
    return spark.createDataFrame(rows, TESTS)


def welch(df: DataFrame, value: str, group: str, one: object, two: object) -> DataFrame:
    """n, gap (mean of two less one), t, freedom, p of two groups by Welch's test; nulls are left out."""
    m = {r[group]: r for r in df.where(F.col(group).isin(one, two)).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).collect()}
    schema, spark = "n long, gap double, t double, freedom double, p double", df.sparkSession
    if one not in m or two not in m or min(m[one]["n"], m[two]["n"]) < 2:
        return spark.createDataFrame([], schema)
    a, b = m[one], m[two]
    ea, eb = a["v"] / a["n"], b["v"] / b["n"]
    gap = b["m"] - a["m"]
    if ea + eb == 0:
        return spark.createDataFrame([(a["n"] + b["n"], gap, None, None, None)], schema)
    t, freedom = gap / math.sqrt(ea + eb), (ea + eb) ** 2 / (ea**2 / (a["n"] - 1) + eb**2 / (b["n"] - 1))
    return spark.createDataFrame([(a["n"] + b["n"], gap, t, freedom, t_tail(t, freedom))], schema)


def chosen_controls(df: DataFrame, candidates: Sequence[str], least: float = 0.5) -> list[str]:
    """Those candidates that are columns and are not null in over `least` of the rows."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        return []
    share = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in there]).first()
    return [c for c in there if (share[c] or 0) > least]


def models(df: DataFrame, specs: Mapping[str, tuple[str, Sequence[str]]], cluster: str, effects: Sequence[str] = (), least: int = 0) -> DataFrame:
    """All models (name -> y, terms) side by side: the rows of `regression.clustered` with `model`, y.

    A model with a variable that is no column is dropped, as is one whose y has `least` values or fewer.
    """
    there = {n: (y, xs) for n, (y, xs) in specs.items() if {y, *xs} <= set(df.columns)}
    out = df.sparkSession.createDataFrame([], "model string, y string, " + regression.SCHEMA)
    if not there:
        return out
    counts = df.agg(*[F.count(y).alias(y) for y in {y for y, _ in there.values()}]).first()
    shared = regression.known(df, [c for y, xs in there.values() for c in (y, *xs)], effects)
    for name, (y, xs) in there.items():
        if counts[y] > least:
            f = regression.clustered(df, y, xs, cluster, effects, shared=shared)
            out = out.unionByName(f.withColumns({"model": F.lit(name), "y": F.lit(y)}))
    return out


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def cells(fitted: DataFrame, digits: int = 4) -> DataFrame:
    """model, term, cell: "b* (se)" per term but fixed effects, and rows N and Adj. R2 per model."""
    form = f"%.{digits}f"
    cell = F.concat(F.format_string(form, "coef"), stars(F.col("p")), F.lit(" ("), F.format_string(form, "se"), F.lit(")"))
    rows = fitted.where(~F.col("term").contains("=")).select("model", "term", cell.alias("cell"))
    one = fitted.groupBy("model").agg(F.max("n_obs").alias("n"), F.max("r2_adj").alias("r2"))
    sizes = one.select("model", F.lit("N").alias("term"), F.col("n").cast("string").alias("cell"))
    return rows.unionByName(sizes).unionByName(one.select("model", F.lit("Adj. R2").alias("term"), F.format_string(form, "r2").alias("cell")))


def magnitudes(fitted: DataFrame, *more: str) -> DataFrame:
    """model, term, coef, se, effect_pct of standardised terms: points of y, in percent, per deviation."""
    return fitted.where(F.col("term").endswith("_z")).select(*more, "model", "term", "coef", "se", (100 * F.col("coef")).alias("effect_pct"))


def corrected(fitted: DataFrame, tests: int, level: float = 0.05) -> DataFrame:
    """`fitted` with alpha, the level over the number of tests, and whether p is below it."""
    alpha = level / max(tests, 1)
    return fitted.withColumns({"alpha": F.lit(alpha), "significant": F.col("p") < alpha})


def by_sample(df: DataFrame, samples: Mapping[str, Column], specs: Mapping[str, tuple[str, Sequence[str]]], cluster: str, effects: Sequence[str] = ()) -> DataFrame:
    """The models on each sample (name -> condition; null is outside), with a column `sample`."""
    out = None
    for name, condition in samples.items():
        part = models(df.where(F.coalesce(condition, F.lit(False))), specs, cluster, effects).withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def sample_models(df: DataFrame, asked: Sequence[tuple[str, Column, str, str]], controls: Sequence[str], cluster: str, effects: Sequence[str] = (), clipped: Sequence[str] = ()) -> DataFrame:
    """Models each on a sample of its own: the rows of `regression.clustered` with `model` and `y`.

    asked: (label, sample, x, y). Within the sample y and the `clipped` controls are clipped to their .01 and
    .99 quantiles, and x is standardised over its rows with both. Every sample's columns stand side by side
    in one table, null outside, so that all quantiles take one pass and all means another. The term is x_z.
    """
    wide, place = {}, {}
    for _, sample, x, y in asked:
        for c in (y, *clipped):
            key = (str(sample), c)
            if key not in place:
                place[key] = f"__c{len(place)}"
                wide[place[key]] = F.when(F.coalesce(sample, F.lit(False)), F.col(c))
    t = stored(df.withColumns(wide), "samples")
    t = stats.winsorize(t, *wide)
    own = {i: F.when(F.coalesce(sample, F.lit(False)) & F.col(place[str(sample), y]).isNotNull(), F.col(x)) for i, (_, sample, x, y) in enumerate(asked)}
    m = t.agg(*[f(c).alias(f"{k}{i}") for i, c in own.items() for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    t = stored(t.withColumns({f"__x{i}": (c - m[f"m{i}"]) / m[f"s{i}"] for i, c in own.items() if m[f"s{i}"]}), "samples-scaled")
    chosen = chosen_controls(df, controls)
    specs = {f"{i}": (place[str(sample), y], [f"__x{i}", *[place.get((str(sample), c), c) for c in chosen]]) for i, (_, sample, _, y) in enumerate(asked)}
    fitted = models(t, specs, cluster, effects)
    names = df.sparkSession.createDataFrame([(str(i), label, y, f"__x{i}", f"{x}_z") for i, (label, _, x, y) in enumerate(asked)], "model string, label string, own string, variable string, shown string")
    back = {v: c for (_, c), v in place.items()}
    fitted = fitted.drop("y").join(F.broadcast(names), "model")  # a row per model
    term = F.when(F.col("term") == F.col("variable"), F.col("shown"))
    for v, c in back.items():
        term = term.when(F.col("term") == v, c)
    return fitted.withColumns({"term": term.otherwise(F.col("term")), "model": F.col("label"), "y": F.col("own")}).drop("label", "own", "variable", "shown")
