"""Analysis of variance: one-way, factorial of types 1 to 3, repeated measures, Levene and post-hoc tests."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dist
from lattica.functions.design import C, build
from lattica.operators.descriptive import number
from lattica.plans.blocks import block_sum
from lattica.plans.finish import finish, frame

ANOVA = "term string, df double, sum_sq double, mean_sq double, f double, p_value double, eta_sq double, partial_eta_sq double, omega_sq double"


def group_moments(df: DataFrame, y: str, group: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean and variance of each group: all that the one-way tests need."""
    return df.withColumn(y, number(y)).where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(*(by or []), group).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("var")
    )


def anova_oneway(df: DataFrame, y: str, group: str, by: list[str] | None = None) -> DataFrame:
    """Between and within rows with effect sizes: an aggregation of group moments, then one of groups."""
    by = by or []
    g = group_moments(df, y, group, by)
    total = Window.partitionBy(*(by or [F.lit(0)]))
    grand = F.sum(F.col("n") * F.col("mean")).over(total) / F.sum("n").over(total)
    s = g.withColumn("grand", grand).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"), F.sum((F.col("n") - 1) * F.col("var")).alias("ssw")
    )

    def row(r: dict) -> list[dict]:
        d1, d2 = r["k"] - 1.0, r["n"] - float(r["k"])
        msw = r["ssw"] / d2
        return [_line(group, d1, r["ssb"], r["ssw"], d2, r["ssb"] + r["ssw"]), dict(term="Residuals", df=d2, sum_sq=r["ssw"], mean_sq=msw)]

    return finish(s, by, row, ANOVA)


def _line(term: str, d: float, ss: float, sse: float, dfe: float, sst: float) -> dict:
    ms, mse = ss / d, sse / dfe
    f = ms / mse if mse > 0 else math.nan
    return dict(term=term, df=d, sum_sq=ss, mean_sq=ms, f=f, p_value=dist.f_sf(f, d, dfe), eta_sq=ss / sst, partial_eta_sq=ss / (ss + sse), omega_sq=(ss - d * mse) / (sst + mse))


def _rss(g: np.ndarray, keep: list[int]) -> tuple[float, int]:
    """Residual sum of squares and rank of the regression on some columns, from the Gram matrix of [X | y]."""
    a = g[np.ix_(keep, keep)]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    w, v = np.linalg.eigh(a / np.outer(scale, scale))
    ok = w > 1e-10 * w.max()
    b = (v[:, ok].T @ (g[keep, -1] / scale)) / np.sqrt(w[ok])
    return float(g[-1, -1] - b @ b), int(ok.sum())


def anova(df: DataFrame, y: str, factors: list[str], covariates: list[str] | None = None, ss_type: int = 2, interactions: bool = True) -> DataFrame:
    """Factorial analysis (of covariance) by sums of squares of type 1, 2 or 3, from one Gram matrix."""
    coding = "deviation" if ss_type == 3 else "dummy"
    mains = [C(f, coding=coding) for f in sorted(factors)]
    terms: list = [*mains, *sorted(covariates or []), *(combinations(mains, 2) if interactions else [])]
    d = build(df, terms)
    k = len(d.columns) + 1
    mid = df.agg(F.avg(number(y))).first()[0] or 0.0
    g = block_sum(df, [*d.columns, F.col(y) - F.lit(mid)], lambda m: m.T @ m).reshape(k, k)
    of = lambda ts: [i for i, a in enumerate(d.assign) if a == 0 or a in ts]
    every = set(range(1, len(terms) + 1))
    sse, rank = _rss(g, of(every))
    dfe = g[0, 0] - rank
    sst = _rss(g, of(set()))[0]
    parts = [set(t) if isinstance(t, tuple) else {t} for t in terms]
    rows = []
    for t in range(1, len(terms) + 1):
        if ss_type == 1:
            base, full = set(range(1, t)), set(range(1, t + 1))
        elif ss_type == 2:
            base = {u for u in every if u != t and not parts[t - 1] < parts[u - 1]}
            full = base | {t}
        else:
            base, full = every - {t}, every
        (r0, k0), (r1, k1) = _rss(g, of(base)), _rss(g, of(full))
        if k1 > k0:
            rows.append(_line(d.terms[t], float(k1 - k0), r0 - r1, sse, dfe, sst))
    rows.append(dict(term="Residuals", df=float(dfe), sum_sq=sse, mean_sq=sse / dfe))
    names = [c.split()[0] for c in ANOVA.split(", ")]
    return frame(df.sparkSession, [tuple(None if r.get(c) is None else r[c] if c == "term" else float(r[c]) for c in names) for r in rows], ANOVA)


def levene_test(df: DataFrame, y: str, group: str, location: str = "median") -> DataFrame:
    """Levene's test on deviations from group means or (Brown-Forsythe) medians."""
    df = df.withColumn(y, number(y)).where(F.col(y).isNotNull() & F.col(group).isNotNull())
    centre = F.percentile(y, F.lit(0.5)) if location == "median" else F.avg(y)
    centres = df.groupBy(group).agg(centre.alias("_centre"))
    return anova_oneway(df.join(centres, group).withColumn(y, F.abs(F.col(y) - F.col("_centre"))), y, group)


def anova_posthoc(df: DataFrame, y: str, group: str, method: str = "tukey", control: str | None = None, conf_level: float = 0.95) -> DataFrame:
    """All pairs of groups (or all against `control`): tukey, bonferroni, games-howell or dunnett.

    `dunnett` integrates the joint distribution of the comparisons; cohens_d divides by the pair's pooled deviation.
    """
    g = group_moments(df, y, group)
    rows = {str(r[group]): (r["n"], r["mean"], r["var"]) for r in g.collect()}
    k, n = len(rows), sum(r[0] for r in rows.values())
    dfe = n - k
    mse = sum((r[0] - 1) * r[2] for r in rows.values()) / dfe
    pairs = [(a, b) for a, b in combinations(sorted(rows), 2)] if method != "dunnett" else [(control or sorted(rows)[0], b) for b in sorted(rows) if b != (control or sorted(rows)[0])]
    if method not in ("tukey", "bonferroni", "games-howell", "dunnett"):
        raise ValueError(f"no post-hoc method {method!r}")
    if method == "dunnett" and pairs[0][0] not in rows:
        raise ValueError(f"no control group {control!r}")
    share = tuple(rows[b][0] / (rows[b][0] + rows[a][0]) for a, b in pairs) if method == "dunnett" else ()
    out = []
    for a, b in pairs:
        (n1, m1, v1), (n2, m2, v2) = rows[a], rows[b]
        diff, d = m2 - m1, float(dfe)
        se = math.sqrt(mse * (1 / n1 + 1 / n2))
        if method == "games-howell":
            se = math.sqrt(v1 / n1 + v2 / n2)
            d = se**4 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
        stat = diff / se
        if method in ("tukey", "games-howell"):
            p, half = dist.tukey_sf(abs(stat) * math.sqrt(2), k, d), dist.tukey_ppf(conf_level, k, d) / math.sqrt(2) * se
        elif method == "dunnett":
            p, half = 1 - dist.dunnett_cdf(abs(stat), share, d), dist.dunnett_ppf(conf_level, share, d) * se
        else:
            p = min(1.0, 2 * dist.t_sf(abs(stat), d) * len(pairs))
            half = dist.t_ppf(1 - (1 - conf_level) / (2 * len(pairs)), d) * se
        pooled = math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
        out.append((a, b, float(diff), float(se), float(stat), float(d), float(p), float(diff - half), float(diff + half), float(diff / pooled) if pooled else math.nan))
    return frame(df.sparkSession, out, "group1 string, group2 string, diff double, std_error double, statistic double, df double, p_value double, conf_low double, conf_high double, cohens_d double")


def _within(df: DataFrame, y: str, subject: str, within: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Subjects with every level, means of the levels and their covariance, in one pass over subjects pivoted to rows."""
    lv = [r[0] for r in df.where(F.col(within).isNotNull()).select(F.col(within).cast("string")).distinct().orderBy(F.col(within).cast("string")).collect()]
    wide = df.groupBy(subject).agg(*(F.avg(F.when(F.col(within).cast("string") == v, number(y))).alias(f"v{i}") for i, v in enumerate(lv))).dropna()
    k = len(lv)
    s = block_sum(wide, [F.lit(1.0), *(f"v{i}" for i in range(k))], lambda m: m.T @ m).reshape(k + 1, k + 1)
    n = s[0, 0]
    mean = s[0, 1:] / n
    return n, mean, (s[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)


def mauchly_test(df: DataFrame, y: str, subject: str, within: str) -> DataFrame:
    """Mauchly's W for sphericity of the levels' contrasts, with the second-order chi-squared approximation of its p-value."""
    n, mean, cov = _within(df, y, subject, within)
    p = len(mean) - 1
    # Contrasts: an orthonormal basis of what is orthogonal to the mean.
    c = np.linalg.svd(np.eye(p + 1) - 1 / (p + 1))[0][:, :p]
    roots = np.linalg.eigvalsh(c.T @ cov @ c)
    w = float(np.clip(np.prod(roots / roots.mean()), 0.0, 1.0)) if roots.mean() > 0 else 0.0
    d, m = p * (p + 1) / 2 - 1, n - 1
    rho = 1 - (2 * p * p + p + 2) / (6 * p * m)
    pv = math.nan if d <= 0 else 0.0
    if w > 0 and d > 0:
        z = -m * rho * math.log(w)
        second = (p + 2) * (p - 1) * (p - 2) * (2 * p**3 + 6 * p * p + 3 * (p + 1) + 2) / (288 * (m * p * rho) ** 2)
        pv = (1 - second) * dist.chi2_sf(z, d) + second * dist.chi2_sf(z, d + 4)
    return frame(df.sparkSession, [(within, w, d, pv)], "term string, w double, df double, p_value double")


def anova_rm(df: DataFrame, y: str, subject: str, within: str) -> DataFrame:
    """One within-subject factor: F with sphericity corrections (Greenhouse-Geisser, Huynh-Feldt).

    Subjects are pivoted to rows of level means; their covariance matrix is one pass.
    """
    n, mean, cov = _within(df, y, subject, within)
    k = len(mean)
    centre = np.eye(k) - 1 / k
    sc = centre @ cov @ centre
    ssa, sse = n * ((mean - mean.mean()) ** 2).sum(), (n - 1) * np.trace(sc)
    d1, d2 = k - 1.0, (k - 1.0) * (n - 1)
    f = ssa / d1 / (sse / d2)
    gg = float(np.trace(sc) ** 2 / ((k - 1) * (sc**2).sum()))
    hf = min(1.0, (n * (k - 1) * gg - 2) / ((k - 1) * (n - 1 - (k - 1) * gg)))
    row = (within, d1, d2, float(ssa), float(sse), float(f), dist.f_sf(f, d1, d2), gg, float(hf), dist.f_sf(f, d1 * gg, d2 * gg), dist.f_sf(f, d1 * hf, d2 * hf))
    return frame(df.sparkSession, [row], "term string, df double, df_error double, sum_sq double, sse double, f double, p_value double, gg_eps double, hf_eps double, p_gg double, p_hf double")
