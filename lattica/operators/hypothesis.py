"""Classical tests: aggregates in Spark, p-values on the result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dist
from lattica.operators.descriptive import number
from lattica.plans.finish import finish, frame
from lattica.plans.stages import cumulative_counts, ordered_values, running_extremes, running_sums, same

ALTERNATIVES = ("two-sided", "less", "greater")
TEST = "statistic double, df double, p_value double, estimate double, conf_low double, conf_high double"


def _sides(alternative: str) -> str:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    return alternative


def _interval(est: float, half, alternative: str, level: float) -> tuple[float, float]:
    """`half(p)`: the margin at a one-sided level p."""
    if alternative == "less":
        return -math.inf, est + half(level)
    if alternative == "greater":
        return est - half(level), math.inf
    return est - half((1 + level) / 2), est + half((1 + level) / 2)


def _moments(c: Column, name: str) -> list[Column]:
    return [F.count(c).cast("double").alias(f"n{name}"), F.avg(c).alias(f"m{name}"), F.var_samp(c).alias(f"v{name}")]


def _t_row(est: float, null: float, se: float, df: float, alternative: str, level: float) -> dict:
    if not se > 0:
        return dict(statistic=math.nan, df=df, p_value=math.nan, estimate=est, conf_low=math.nan, conf_high=math.nan)
    t = (est - null) / se
    lo, hi = _interval(est, lambda p: dist.t_ppf(p, df) * se, alternative, level)
    return dict(statistic=t, df=df, p_value=dist.tail(t, alternative, lambda v: dist.t_sf(v, df)), estimate=est, conf_low=lo, conf_high=hi)


def t_test(
    df: DataFrame, x: str, y: str | None = None, group: str | None = None, groups: tuple | None = None, by: list[str] | None = None,
    alternative: str = "two-sided", pop_mean: float = 0.0, paired: bool = False, equal_var: bool = False, conf_level: float = 0.95,
) -> DataFrame:
    """One-sample, paired (y) or two-sample t-test; two samples are columns x and y or the two `groups` of `group`.

    One aggregation. Missing values are dropped (pairs as pairs). Without spread the statistic is null.
    """
    _sides(alternative)
    by = by or []
    df = df.withColumn(x, number(x))
    if group:
        a, b = (F.when(F.col(group) == g, F.col(x)) for g in groups)
    elif y:
        df = df.withColumn(y, number(y))
        a, b = F.col(x), F.col(y)
    else:
        a, b = F.col(x), None
    if paired and b is not None:
        a, b = F.when(a.isNotNull() & b.isNotNull(), a - b), None
    stats = df.groupBy(*by).agg(*_moments(a, "1"), *(_moments(b, "2") if b is not None else []))
    one_sample = b is None

    def row(r: dict) -> dict:
        if one_sample:
            return _t_row(r["m1"], pop_mean, math.sqrt(r["v1"] / r["n1"]) if r["n1"] > 1 else 0.0, r["n1"] - 1, alternative, conf_level)
        n1, n2, v1, v2 = r["n1"], r["n2"], r["v1"], r["v2"]
        if equal_var:
            d = n1 + n2 - 2
            se = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / d * (1 / n1 + 1 / n2))
        else:
            se = math.sqrt(v1 / n1 + v2 / n2)
            d = se**4 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) if se > 0 else math.nan
        return _t_row(r["m1"] - r["m2"], pop_mean, se, d, alternative, conf_level)

    return finish(stats, by, row, TEST)


def var_test(df: DataFrame, x: str, group: str, groups: tuple, by: list[str] | None = None, ratio: float = 1.0, alternative: str = "two-sided", conf_level: float = 0.95) -> DataFrame:
    """F test of the ratio of two groups' variances."""
    _sides(alternative)
    df = df.withColumn(x, number(x))
    a, b = (F.when(F.col(group) == g, F.col(x)) for g in groups)

    def row(r: dict) -> dict:
        d1, d2, est = r["n1"] - 1, r["n2"] - 1, r["v1"] / r["v2"]
        f = est / ratio
        up = dist.f_sf(f, d1, d2)
        p = {"greater": up, "less": 1 - up}.get(alternative, 2 * min(up, 1 - up))
        q = lambda p: dist.f_ppf(p, d1, d2)
        lo, hi = {"less": (0.0, est / q(1 - conf_level)), "greater": (est / q(conf_level), math.inf)}.get(alternative, (est / q((1 + conf_level) / 2), est / q((1 - conf_level) / 2)))
        return dict(statistic=f, df=d1, df2=d2, p_value=p, estimate=est, conf_low=lo, conf_high=hi)

    stats = df.groupBy(*(by or [])).agg(*_moments(a, "1"), *_moments(b, "2"))
    return finish(stats, by or [], row, "statistic double, df double, df2 double, p_value double, estimate double, conf_low double, conf_high double")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every pair of levels, zeros included: the table a chi-squared test needs."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = counts.select(a).distinct(), counts.select(b).distinct().withColumn("_k", F.lit(1))
    frame = rows.withColumn("_k", F.lit(1)).join(cols, "_k").drop("_k")  # levels by levels: the table itself
    return frame.join(counts, [a, b], "left").fillna(0, ["n"])


def _table(df: DataFrame, a: str, b: str) -> tuple[list, list, np.ndarray]:
    pdf = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).toPandas()
    wide = pdf.pivot(index=a, columns=b, values="n").fillna(0).sort_index().sort_index(axis=1)
    return list(wide.index), list(wide.columns), wide.to_numpy(float)


def random_tables(rows: np.ndarray, cols: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Random two-way tables with given margins: rows by multivariate hypergeometric draws."""
    out = np.zeros((n, len(rows), len(cols)), np.int64)
    for k in range(n):
        left = cols.astype(np.int64).copy()
        for i, r in enumerate(rows.astype(np.int64)[:-1]):
            out[k, i] = rng.multivariate_hypergeometric(left, int(r))
            left = left - out[k, i]
        out[k, -1] = left
    return out


def _simulated(spark, n_resamples: int, seed: int, count) -> int:
    """Replicates over tasks: `count(rng, n)` gives how many of n reach the observed value."""
    seeds = spark.range(0, max(1, n_resamples // 500), 1, min(64, max(1, n_resamples // 500)))
    sizes = [n_resamples // max(1, n_resamples // 500)] * max(1, n_resamples // 500)
    sizes[-1] += n_resamples - sum(sizes)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"c": [count(np.random.default_rng([seed, int(i)]), sizes[int(i)]) for i in pdf["id"]]})

    return int(seeds.mapInPandas(run, "c long").agg(F.sum("c")).first()[0])


def chisq_test(df: DataFrame, a: str, b: str | None = None, probs: dict | None = None, correct: bool = True, simulate: bool = False, n_resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Chi-squared test of independence of a and b, or of a's counts against `probs` (even without)."""
    spark = df.sparkSession
    if b is None:
        pdf = df.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("k")).agg(F.count("*").alias("n")).orderBy("k").toPandas()
        obs = pdf["n"].to_numpy(float)
        p = np.array([probs[k] for k in pdf["k"]], float) if probs else np.full(len(obs), 1 / len(obs))
        exp = obs.sum() * p
        stat, d = float(((obs - exp) ** 2 / exp).sum()), float(len(obs) - 1)
        draw = lambda rng, n: int((((rng.multinomial(int(obs.sum()), p, n) - exp) ** 2 / exp).sum(1) >= stat - 1e-12).sum())
    else:
        _, _, obs = _table(df, a, b)
        exp = np.outer(obs.sum(1), obs.sum(0)) / obs.sum()
        yates = min(0.5, float(np.abs(obs - exp).min())) if correct and obs.shape == (2, 2) and not simulate else 0.0
        stat, d = float(((np.abs(obs - exp) - yates) ** 2 / exp).sum()), float((obs.shape[0] - 1) * (obs.shape[1] - 1))
        draw = lambda rng, n: int((((random_tables(obs.sum(1), obs.sum(0), n, rng) - exp) ** 2 / exp).sum((1, 2)) >= stat - 1e-12).sum())
    p_value = (1 + _simulated(spark, n_resamples, seed, draw)) / (n_resamples + 1) if simulate else dist.chi2_sf(stat, d)
    return frame(spark, [(stat, math.nan if simulate else d, p_value)], "statistic double, df double, p_value double")


def chisq_residuals(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts, Pearson and standardised residuals of every cell; windows over the crosstab."""
    t = crosstab(df, a, b)
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    total = t.groupBy().agg(F.sum("n").alias("total"))
    t = t.withColumns({"row": over(a), "col": over(b), "_k": F.lit(1)}).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    exp = F.col("row") * F.col("col") / F.col("total")
    return t.select(
        a, b, F.col("n").alias("observed"), exp.alias("expected"), ((F.col("n") - exp) / F.sqrt(exp)).alias("residual"),
        ((F.col("n") - exp) / F.sqrt(exp * (1 - F.col("row") / F.col("total")) * (1 - F.col("col") / F.col("total")))).alias("stdres"),
    )


def _wilson(x: float, n: float, level: float, alternative: str, yates: float) -> tuple[float, float]:
    z = dist.norm_ppf(level if alternative != "two-sided" else (1 + level) / 2)
    p, w = x / n, z * z / (2 * n)
    up = (p + yates / n + w + z * math.sqrt((p + yates / n) * (1 - p - yates / n) / n + w / (2 * n))) / (1 + 2 * w) if p + yates / n < 1 else 1.0
    lo = (p - yates / n + w - z * math.sqrt((p - yates / n) * (1 - p + yates / n) / n + w / (2 * n))) / (1 + 2 * w) if p - yates / n > 0 else 0.0
    if alternative == "two-sided":
        return max(lo, 0.0), min(up, 1.0)
    return (max(lo, 0.0), 1.0) if alternative == "greater" else (0.0, min(up, 1.0))


def prop_test(df: DataFrame, success: str, group: str | None = None, null_value: float | None = None, alternative: str = "two-sided", correct: bool = True, conf_level: float = 0.95) -> DataFrame:
    """Test of one proportion against `null_value` (one half), or of equal proportions of groups; `success` is a boolean expression."""
    s = F.expr(success).cast("int")
    keys = [group] if group else []
    pdf = df.groupBy(*keys).agg(F.sum(s).alias("x"), F.count(s).alias("n")).toPandas()
    pdf = pdf.sort_values(keys) if keys else pdf
    x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(float)
    k, p = len(x), x / n
    if k == 1 or null_value is not None:
        p0 = np.full(k, 0.5 if null_value is None else null_value)
        yates = min(0.5, float(np.abs(x - n * p0).min())) if correct and k <= 2 else 0.0
        d, exp = float(k), np.column_stack([n * p0, n * (1 - p0)])
    else:
        pool = x.sum() / n.sum()
        delta = p[0] - p[1]
        yates = min(0.5, abs(delta) / (1 / n).sum()) if correct and k == 2 else 0.0
        d, exp = float(k - 1), np.column_stack([n * pool, n * (1 - pool)])
    obs = np.column_stack([x, n - x])
    stat = float(((np.abs(obs - exp) - yates) ** 2 / exp).sum())
    lo = hi = math.nan
    if k == 1:
        z = math.copysign(math.sqrt(stat), p[0] - p0[0])
        lo, hi = _wilson(x[0], n[0], conf_level, alternative, yates)
    elif k == 2 and null_value is None:
        z = math.copysign(math.sqrt(stat), p[0] - p[1])
        width = dist.norm_ppf(conf_level if alternative != "two-sided" else (1 + conf_level) / 2) * math.sqrt((p * (1 - p) / n).sum()) + yates * (1 / n).sum()
        lo, hi = (max(delta - width, -1.0) if alternative != "less" else -1.0), (min(delta + width, 1.0) if alternative != "greater" else 1.0)
    else:
        z, alternative = math.nan, "two-sided"
    pv = dist.chi2_sf(stat, d) if alternative == "two-sided" else dist.tail(z, alternative, dist.norm_sf)
    out = [(stat, d, pv, float(p[0]), lo, hi)]
    return frame(df.sparkSession, out, TEST)


def fisher_test(df: DataFrame, a: str, b: str, alternative: str = "two-sided", conf_level: float = 0.95, n_resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """Fisher's exact test: conditional odds ratio and interval for 2 x 2 tables, simulation beyond."""
    spark = df.sparkSession
    _, _, t = _table(df, a, b)
    if t.shape != (2, 2):
        const = sum(math.lgamma(v + 1) for v in [*t.sum(0), *t.sum(1)]) - math.lgamma(t.sum() + 1)
        lg = np.vectorize(math.lgamma)
        seen = const - lg(t + 1).sum()
        hits = _simulated(spark, n_resamples, seed, lambda rng, n: int((const - lg(random_tables(t.sum(1), t.sum(0), n, rng) + 1.0).sum((1, 2)) <= seen + 1e-7).sum()))
        return frame(spark, [(math.nan, (1 + hits) / (n_resamples + 1), math.nan, math.nan)], "estimate double, p_value double, conf_low double, conf_high double")
    m, n, k, x = int(t[:, 0].sum()), int(t[:, 1].sum()), int(t[0].sum()), int(t[0, 0])
    lo, hi = max(0, k - n), min(k, m)
    sup = np.arange(lo, hi + 1)
    logd = dist.hypergeom_logpmf(sup, m, n, k)

    def pmf(odds: float) -> np.ndarray:
        d = logd + sup * math.log(odds)
        d = np.exp(d - d.max())
        return d / d.sum()

    up = lambda odds: float(pmf(odds)[sup >= x].sum())
    down = lambda odds: float(pmf(odds)[sup <= x].sum())
    d1 = pmf(1.0)
    p = {"greater": up(1.0), "less": down(1.0)}.get(alternative, float(d1[d1 <= d1[x - lo] * (1 + 1e-7)].sum()))
    grid = lambda f, target: math.exp(dist._solve(lambda v: f(math.exp(v)), -40.0, 40.0, target))
    mean = lambda odds: float((sup * pmf(odds)).sum())
    est = math.nan if lo == hi else 0.0 if x == lo else math.inf if x == hi else grid(mean, x)
    tail = (1 - conf_level) if alternative != "two-sided" else (1 - conf_level) / 2
    low = 0.0 if x == lo or alternative == "less" else grid(up, tail)
    high = math.inf if x == hi or alternative == "greater" else grid(lambda o: -down(o), -tail)
    return frame(spark, [(est, min(1.0, p), low, high)], "estimate double, p_value double, conf_low double, conf_high double")


def wilcox_rank_sum(df: DataFrame, x: str, group: str, groups: tuple, alternative: str = "two-sided", null_value: float = 0.0, correct: bool = True, exact: bool | None = None) -> DataFrame:
    """Rank-sum test; ranks come from distributed cumulative counts. Exact without ties below 50 a group."""
    _sides(alternative)
    d = df.where(F.col(group).isin(*groups)).select(number(x).alias("v"), (F.col(group) == groups[0]).alias("first")).where("v is not null")
    d = d.withColumn("v", F.when(F.col("first"), F.col("v") - null_value).otherwise(F.col("v")))
    ranks = cumulative_counts(d, "v").withColumn("r", F.col("before") + (F.col("count") + 1) / 2)
    own = d.groupBy("v").agg(F.sum(F.col("first").cast("int")).alias("k"), F.count("*").alias("c"))
    s = own.join(ranks, own["v"] == ranks["value"]).agg(F.sum(F.col("k") * F.col("r")), F.sum("k"), F.sum("c"), F.sum(F.expr("c * (c * c - 1)")), F.max("c")).first()
    rank_sum, n1, n, ties, top = float(s[0]), int(s[1]), int(s[2]), float(s[3]), int(s[4])
    n2 = n - n1
    w = rank_sum - n1 * (n1 + 1) / 2
    if exact if exact is not None else (n1 < 50 and n2 < 50 and top == 1):
        less, more = dist.ranksum_cdf(w, n1, n2), 1 - dist.ranksum_cdf(w - 1, n1, n2)
        p = {"less": less, "greater": more}.get(alternative, min(1.0, 2 * min(less, more)))
    else:
        z = w - n1 * n2 / 2
        shift = {"two-sided": math.copysign(0.5, z) if z else 0.0, "greater": 0.5, "less": -0.5}[alternative] if correct else 0.0
        z = (z - shift) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        p = dist.tail(z, alternative, dist.norm_sf)
    return frame(df.sparkSession, [(w, p, n1, n2)], "statistic double, p_value double, n1 long, n2 long")


def wilcox_signed_rank(df: DataFrame, x: str, y: str | None = None, alternative: str = "two-sided", null_value: float = 0.0, correct: bool = True, exact: bool | None = None) -> DataFrame:
    """Signed-rank test of x, or of x - y; zeros are dropped. Exact without ties or zeros below 50."""
    _sides(alternative)
    d = df.select((number(x) - (number(y) if y else F.lit(0.0)) - null_value).alias("d")).where("d is not null")
    zeros = d.where("d = 0").count()
    d = d.where("d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).cast("int").alias("up"))
    ranks = cumulative_counts(d, "v").withColumn("r", F.col("before") + (F.col("count") + 1) / 2)
    own = d.groupBy("v").agg(F.sum("up").alias("k"), F.count("*").alias("c"))
    s = own.join(ranks, own["v"] == ranks["value"]).agg(F.sum(F.col("k") * F.col("r")), F.sum("c"), F.sum(F.expr("c * (c * c - 1)")), F.max("c")).first()
    v, n, ties, top = float(s[0] or 0), int(s[1] or 0), float(s[2] or 0), int(s[3] or 0)
    if exact if exact is not None else (n < 50 and top <= 1 and not zeros):
        less, more = dist.signrank_cdf(v, n), 1 - dist.signrank_cdf(v - 1, n)
        p = {"less": less, "greater": more}.get(alternative, min(1.0, 2 * min(less, more)))
    else:
        z = v - n * (n + 1) / 4
        shift = {"two-sided": math.copysign(0.5, z) if z else 0.0, "greater": 0.5, "less": -0.5}[alternative] if correct else 0.0
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        p = dist.tail((z - shift) / sd, alternative, dist.norm_sf) if sd else math.nan
    return frame(df.sparkSession, [(v, p, n)], "statistic double, p_value double, n long")


def ks_test(df: DataFrame, x: str, group: str | None = None, groups: tuple | None = None, distribution: str = "norm", alternative: str = "two-sided", **params: float) -> DataFrame:
    """Kolmogorov-Smirnov: two groups, or one sample against norm, unif or exp. Distinct values stay distributed."""
    spark = df.sparkSession
    if group:
        d = df.where(F.col(group).isin(*groups)).select(number(x).alias("v"), (F.col(group) == groups[0]).cast("int").alias("k")).where("v is not null")
        n1, n = (int(v) for v in d.agg(F.sum("k"), F.count("*")).first())
        n2 = n - n1
        # At each distinct value: rows of either group up to it, from the cumulative counts of the signed steps.
        own = d.groupBy(F.col("v").alias("value")).agg(F.sum("k").alias("k"))
        both = running_sums(cumulative_counts(d, "v").join(own, "value"), "value", "k")
        gap = F.col("k_sum") / n1 - (F.col("before") + F.col("count") - F.col("k_sum")) / n2
        hi, lo = both.agg(F.max(gap), F.min(gap)).first()
        up, down = max(0.0, float(hi)), max(0.0, -float(lo))
        size = n1 * n2 / n
    else:
        d = df.select(number(x).alias("v")).where("v is not null")
        n = d.count()
        pdf = cumulative_counts(d, "v")

        def gaps(batches):
            cdf = {
                "norm": lambda v: dist.norm_cdf((v - params.get("mean", 0.0)) / params.get("sd", 1.0)),
                "unif": lambda v: min(1.0, max(0.0, (v - params.get("min", 0.0)) / (params.get("max", 1.0) - params.get("min", 0.0)))),
                "exp": lambda v: 1 - math.exp(-max(0.0, v) * params.get("rate", 1.0)),
            }[distribution]
            for b in batches:
                f = np.array([cdf(v) for v in b["value"]])
                yield pd.DataFrame({"up": [((b["before"] + b["count"]) / n - f).max()], "down": [(f - b["before"] / n).max()]})

        hi, lo = pdf.mapInPandas(gaps, "up double, down double").agg(F.max("up"), F.max("down")).first()
        up, down, size = float(hi), float(lo), n
    stat = {"two-sided": max(up, down), "greater": up, "less": down}[alternative]
    p = dist.kolmogorov_sf(math.sqrt(size) * stat) if alternative == "two-sided" else math.exp(-2 * size * stat * stat)
    return frame(spark, [(stat, min(1.0, max(0.0, p)))], "statistic double, p_value double")


P_METHODS = ("holm", "hochberg", "hommel", "bonferroni", "BH", "fdr", "BY", "none")


def p_adjust(df: DataFrame, p: str, method: str = "holm", by: list[str] | None = None, out: str = "p_adjusted") -> DataFrame:
    """`df` with adjusted p-values; null and NaN stay. Ties share a value by taking the extreme. See `p_adjust_many`."""
    return p_adjust_many(df, p, {out: method}, by)


def p_adjust_many(df: DataFrame, p: str, methods: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """`df` with a column of adjusted p-values for each of `methods` (column: method), from one ordering.

    A family of tests (all, or one of `by`) is cut into ranges of distinct p-values, each with its rank; no task
    sees a whole family. Adjusted values join the rows by p-value.
    """
    for m in methods.values():
        if m not in P_METHODS:
            raise ValueError(f"method must be one of {P_METHODS}")
    by = by or []
    rows = df.withColumn("_v", number(p))
    t = ordered_values(rows, "_v", by)
    v, n, low, high = F.col("value"), F.col("total"), F.col("before") + 1, F.col("before") + F.col("count")
    raw = {
        "holm": (v * (n - low + 1), False, F.max), "hochberg": (v * (n - high + 1), True, F.min),
        "BH": (v * n / high, True, F.min), "fdr": (v * n / high, True, F.min), "BY": (v * n / high * harmonic(n), True, F.min),
    }
    if "hommel" in methods.values():
        t = hommel_values(t, by)
    ordered = {m: raw[m] for m in methods.values() if m in raw}
    t = running_extremes(t, by, **ordered) if ordered else t
    value = {"none": v, "bonferroni": v * n} | {m: F.col(m) for m in methods.values() if m in raw or m == "hommel"}
    t = t.select(*by, F.col("value").alias("_v"), *(F.least(F.lit(1.0), value[m]).alias(c) if m != "none" else v.alias(c) for c, m in methods.items()))
    kept = [c for c in df.columns if c not in methods or c in by]
    return same(rows.select(*kept, "_v"), t, [*by, "_v"]).select(*df.columns, *(c for c in methods if c not in df.columns))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, from 64 on by its expansion (exact to double precision there)."""
    x = n.cast("double")
    short = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.greatest(n.cast("long"), F.lit(1).cast("long")), F.lit(63).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / i)
    return F.when(n < 64, short).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x) - 1 / (252 * x * x * x * x * x * x))


def lower_hull(rank: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Positions of the corners of the lower convex hull of points with rising ranks."""
    keep: list[int] = []
    x, y = rank.tolist(), p.tolist()
    for k in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (y[b] - y[a]) * (x[k] - x[b]) < (y[k] - y[b]) * (x[b] - x[a]):
                break
            keep.pop()
        keep.append(k)
    return np.array(keep, int)


class Simes:
    """Simes p-values of the upper ends of an ordered family of n tests, read off the lower hull of its (rank, p) points.

    The upper end of size i has the least i p / (rank - (n - i)) over the ranks beyond n - i: the lowest tangent from
    (n - i, 0), which touches a corner of the hull. Sizes go up and tangents move down, so the value falls with i.
    """

    def __init__(self, rank: np.ndarray, p: np.ndarray, n: int):
        self.rank, self.p, self.n = rank.astype(float), p, n
        step = np.diff(p) / np.diff(self.rank)
        self.meets = np.maximum.accumulate(self.rank[:-1] - p[:-1] / step) if len(step) else step  # where edges meet p = 0

    def touch(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.meets, self.n - size, "left")

    def __call__(self, size: np.ndarray) -> np.ndarray:
        at, best = self.touch(size), np.full(len(size), np.inf)
        for shift in (-1, 0, 1):  # rounding may put the tangent a corner off
            k = np.clip(at + shift, 0, len(self.p) - 1)
            far = self.rank[k] - (self.n - size)
            best = np.where(far > 0, np.minimum(best, size * self.p[k] / np.where(far > 0, far, 1)), best)
        return np.where(size > 0, np.where(size <= self.n, best, 0.0), np.inf)

    def crossing(self, p: np.ndarray) -> np.ndarray:
        """The least size i with i p at or above the Simes value of size i + 1."""
        lo, hi = np.zeros(len(p)), np.full(len(p), float(self.n))
        while (lo < hi).any():
            mid = np.floor((lo + hi) / 2)
            reached = mid * p >= self(mid + 1)
            lo, hi = np.where(reached, lo, np.minimum(mid + 1, hi)), np.where(reached, mid, hi)
        return hi

    def adjust(self, p: np.ndarray) -> np.ndarray:
        """Closed testing: a test falls at level a if the largest upper end that Simes keeps at a, of size h, has h p <= a."""
        i = self.crossing(p)
        return np.minimum(1.0, np.minimum(np.maximum(i * p, self(i + 1)), self(i)))


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjustment of one family by closed testing in n log n; NaN stays."""
    ok, out = ~np.isnan(p), np.full(len(p), np.nan)
    if ok.any():
        v, back, count = np.unique(p[ok], return_inverse=True, return_counts=True)
        rank = np.cumsum(count)
        at = lower_hull(rank, v)
        out[ok] = Simes(rank[at], v[at], int(rank[-1])).adjust(v)[back]
    return out


def hommel_values(t: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `ordered_values` with `hommel`, adjusted values of their families.

    Each range of values gives its hull; a task merges a family's hulls and deals every range the corners that its
    values touch, so that only corners meet in one task.
    """
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*by, "part").schema)
    corners = f"{keys}, r long, p double, n long"

    def hull(a: pa.Table) -> pa.Table:
        a = a.take(pc.sort_indices(a, [("value", "ascending")]))
        rank, p = a["before"].to_numpy() + a["count"].to_numpy(), a["value"].to_numpy()
        at = lower_hull(rank, p)
        return a.select([*by, "part"]).take(pa.array(at)).append_column("r", pa.array(rank[at])).append_column("p", pa.array(p[at])).append_column("n", a["total"].take(pa.array(at)))

    def deal(a: pa.Table) -> pa.Table:
        a = a.take(pc.sort_indices(a, [("r", "ascending")]))
        rank, p, part = a["r"].to_numpy(), a["p"].to_numpy(), a["part"].to_numpy()
        at = lower_hull(rank, p)
        whole = Simes(rank[at], p[at], a["n"][0].as_py())
        first = np.flatnonzero(np.r_[True, np.diff(part) != 0])
        last = np.r_[first[1:], len(part)] - 1
        # A hull keeps its ends, so a range's least and greatest value are here; sizes fall as values rise.
        most, least = whole.crossing(p[first]), whole.crossing(p[last])
        lo = np.maximum(whole.touch(np.minimum(most + 2, whole.n)) - 2, 0)
        hi = np.minimum(whole.touch(np.maximum(least - 1, 0)) + 2, len(at) - 1)
        take = np.concatenate([np.arange(x, y + 1) for x, y in zip(lo, hi)])
        owner = np.repeat(first, hi - lo + 1)
        return a.select([*by, "part"]).take(pa.array(owner)).append_column("r", pa.array(rank[at][take])).append_column("p", pa.array(p[at][take])).append_column("n", a["n"].take(pa.array(owner)))

    def adjust(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b, [("r", "ascending")]))
        own = Simes(b["r"].to_numpy(), b["p"].to_numpy(), b["n"][0].as_py())
        return a.append_column("hommel", pa.array(own.adjust(a["value"].to_numpy())))

    hulls = t.groupBy(*by, "part").applyInArrow(hull, corners)
    dealt = hulls.groupBy(*by).applyInArrow(deal, corners)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema)
    return t.groupBy(*by, "part").cogroup(dealt.groupBy(*by, "part")).applyInArrow(adjust, f"{schema}, hommel double")


def wilcox_conf_int(df: DataFrame, x: str, y: str | None = None, group: str | None = None, groups: tuple | None = None, conf_level: float = 0.95, exact_below: int = 50) -> DataFrame:
    """Hodges-Lehmann estimate and interval: of Walsh averages (one sample or pairs) or of differences (two groups).

    The ends are order statistics of pairwise values, found by bisection on counts over sorted samples
    (n log n a step), so pairs are never listed. Samples are held sorted on the driver.
    """
    a = (1 - conf_level) / 2
    if group:
        s = [np.sort(df.where(F.col(group) == g).select(number(x).alias("v")).dropna().toPandas()["v"].to_numpy()) for g in groups]
        m, n = len(s[0]), len(s[1])
        total = m * n
        below = lambda v: int(np.searchsorted(s[1], s[0] - v, "left").size * n - np.searchsorted(s[1], s[0] - v, "left").sum())  # noqa: E731  pairs with x - y <= v
        lo, hi = s[0][0] - s[1][-1], s[0][-1] - s[1][0]
        if m < exact_below and n < exact_below:
            k = next((q for q in range(total + 1) if dist.ranksum_cdf(q, m, n) >= a), 0)
        else:
            k = round(m * n / 2 - dist.norm_ppf(1 - a) * math.sqrt(m * n * (m + n + 1) / 12))
    else:
        v = df.select((number(x) - (number(y) if y else F.lit(0.0))).alias("v")).dropna().toPandas()["v"].to_numpy()
        d = np.sort(v)
        n = len(d)
        total = n * (n + 1) // 2
        below = lambda q: int((np.searchsorted(d, 2 * q - d, "right") - np.arange(n)).clip(0).sum())
        lo, hi = d[0], d[-1]
        if n < exact_below:
            k = next((q for q in range(total + 1) if dist.signrank_cdf(q, n) >= a), 0)
        else:
            k = round(n * (n + 1) / 4 - dist.norm_ppf(1 - a) * math.sqrt(n * (n + 1) * (2 * n + 1) / 24))

    def kth(r: int) -> float:
        u, w = lo - 1e-9 * (1 + abs(lo)), hi + 1e-9 * (1 + abs(hi))
        for _ in range(200):
            mid = (u + w) / 2
            if mid in (u, w):
                break
            u, w = (u, mid) if below(mid) >= r else (mid, w)
        return float(w)

    k = max(1, k)
    middle = (kth((total + 1) // 2) + kth(total // 2 + 1)) / 2
    return frame(df.sparkSession, [(middle, kth(k), kth(total + 1 - k))], "estimate double, conf_low double, conf_high double")
