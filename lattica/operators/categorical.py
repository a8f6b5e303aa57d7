"""Multinomial and ordinal regression by Newton steps over distributed scores and information."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import dist
from lattica.functions.design import build, levels
from lattica.operators.regression import Fit
from lattica.plans.blocks import block_sum


def _newton(step, start: np.ndarray, tol: float = 1e-9, max_iter: int = 50):
    """Maximise by Newton with step halving; `step(b)` gives value, score, information."""
    b, (ll, g, h) = start, step(start)
    for it in range(1, max_iter + 1):
        move, size = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        new = step(b + move)
        while not new[0] >= ll - 1e-10 * abs(ll) and size > 1e-6:
            size /= 2
            new = step(b + size * move)
        done = abs(new[0] - ll) < tol * (abs(new[0]) + tol)
        b, (ll, g, h) = b + size * move, new
        if done:
            return b, ll, h, it
    raise ArithmeticError(f"the likelihood did not settle in {max_iter} steps")


def multinomial(df: DataFrame, y: str, terms: list) -> Fit:
    """Baseline-category logits; levels sort as strings and the last is the reference."""
    lv = levels(df, y)
    lv = [lv[-1], *lv[:-1]]
    d = build(df, terms)
    p, j = len(d.columns), len(lv) - 1
    code = sum((F.when(F.col(y).cast("string") == v, float(i)).otherwise(0.0) for i, v in enumerate(lv)), F.lit(0.0))
    rows = df.where(F.col(y).isNotNull()).select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate([*d.columns, code]))).dropna().persist()

    def step(b):
        beta = b.reshape(j, p)

        def fold(m):
            x, t = m[:, :p], m[:, p].astype(int)
            e = np.column_stack([np.zeros(len(x)), x @ beta.T])
            e -= e.max(1, keepdims=True)
            pr = np.exp(e)
            pr /= pr.sum(1, keepdims=True)
            ind = np.eye(j + 1)[t][:, 1:]
            g = (ind - pr[:, 1:]).T @ x
            h = np.zeros((j, p, j, p))
            for a in range(j):
                for c in range(a, j):
                    w = pr[:, a + 1] * ((a == c) - pr[:, c + 1])
                    h[a, :, c, :] = x.T @ (x * w[:, None])
                    h[c, :, a, :] = h[a, :, c, :].T
            return np.concatenate([[np.log(pr[np.arange(len(t)), t] + 1e-300).sum()], g.ravel(), h.ravel(), [len(x)]])

        s = block_sum(rows, [f"c{i}" for i in range(p + 1)], fold)
        k = j * p
        step.n = int(s[-1])
        return s[0], s[1 : 1 + k], s[1 + k : 1 + k + k * k].reshape(k, k)

    try:
        b, ll, h, it = _newton(step, np.zeros(j * p))
    finally:
        rows.unpersist()
    cov = np.linalg.pinv(h)
    labels = [f"{v}:{c}" for v in lv[1:] for c in d.labels]
    return Fit(labels, b, np.sqrt(np.diag(cov)), cov, step.n, step.n - len(b), 1.0, {"log_lik": ll, "deviance": -2 * ll, "aic": -2 * ll + 2 * len(b), "iterations": it}, use_t=False)


_cdf = np.vectorize(dist.norm_cdf)
#: Latent distributions: (distribution function, density, its slope).
LATENT = {
    "logit": (lambda e: 1 / (1 + np.exp(-np.clip(e, -500, 500))), None, None),
    "probit": (_cdf, lambda e: np.exp(-e * e / 2) / math.sqrt(2 * math.pi), lambda e: -e * np.exp(-e * e / 2) / math.sqrt(2 * math.pi)),
    "loglog": (
        lambda e: np.exp(-np.exp(-np.clip(e, -30, 500))),
        lambda e: np.exp(-np.clip(e, -30, 500) - np.exp(-np.clip(e, -30, 500))),
        lambda e: np.exp(-np.clip(e, -30, 500) - np.exp(-np.clip(e, -30, 500))) * (np.exp(-np.clip(e, -30, 500)) - 1),
    ),
    "cauchit": (lambda e: 0.5 + np.arctan(e) / math.pi, lambda e: 1 / (math.pi * (1 + e * e)), lambda e: -2 * e / (math.pi * (1 + e * e) ** 2)),
    "cloglog": (lambda e: -np.expm1(-np.exp(np.clip(e, -500, 30))), lambda e: np.exp(np.clip(e, -500, 30) - np.exp(np.clip(e, -500, 30))), lambda e: np.exp(np.clip(e, -500, 30) - np.exp(np.clip(e, -500, 30))) * (1 - np.exp(np.clip(e, -500, 30)))),
}


def ordinal(df: DataFrame, y: str, terms: list, link: str = "logit") -> Fit:
    """Cumulative-link regression, P(Y <= k) = F(zeta_k - x b), for outcomes coded 0 to K - 1; Newton on slopes and thresholds."""
    d = build(df, terms, intercept=False)
    p = len(d.columns)
    counts = {int(r[0]): r[1] for r in df.where(F.col(y).isNotNull()).groupBy(F.col(y).cast("int")).count().collect()}
    k = max(counts) + 1
    if sorted(counts) != list(range(k)) or k < 2:
        raise ValueError("outcomes must be coded 0, 1, ... without gaps")
    cdf, pdf, slope = LATENT[link]
    if link == "logit":
        pdf = lambda e: cdf(e) * (1 - cdf(e))
        slope = lambda e: pdf(e) * (1 - 2 * cdf(e))
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate([*d.columns, F.col(y)]))).dropna().persist()
    q = k - 1

    def step(b):
        beta, zeta = b[:p], b[p:]
        if np.any(np.diff(zeta) <= 0):
            return -math.inf, np.zeros(p + q), np.eye(p + q)

        def fold(m):
            x, t = m[:, :p], m[:, p].astype(int)
            eta = x @ beta
            up, lo = np.where(t < q, zeta[np.minimum(t, q - 1)] - eta, np.inf), np.where(t > 0, zeta[np.maximum(t - 1, 0)] - eta, -np.inf)
            fin_u, fin_l = t < q, t > 0
            fu, fl = np.where(fin_u, up, 0.0), np.where(fin_l, lo, 0.0)
            pr = np.maximum(np.where(fin_u, cdf(fu), 1.0) - np.where(fin_l, cdf(fl), 0.0), 1e-300)
            du, dl = np.where(fin_u, pdf(fu), 0.0), np.where(fin_l, pdf(fl), 0.0)
            su, sl = np.where(fin_u, slope(fu), 0.0), np.where(fin_l, slope(fl), 0.0)
            # Derivatives of each argument: -x for slopes, an indicator for its threshold.
            au = np.column_stack([-x, (np.arange(q) == t[:, None]) * 1.0])
            al = np.column_stack([-x, (np.arange(q) == (t - 1)[:, None]) * 1.0])
            g = (au * du[:, None] - al * dl[:, None]) / pr[:, None]
            h = g.T @ g - (au.T @ (au * (su / pr)[:, None]) - al.T @ (al * (sl / pr)[:, None]))
            return np.concatenate([[np.log(pr).sum()], g.sum(0), h.ravel(), [len(x)]])

        s = block_sum(rows, [f"c{i}" for i in range(p + 1)], fold)
        n = p + q
        step.n = int(s[-1])
        return s[0], s[1 : 1 + n], s[1 + n : 1 + n + n * n].reshape(n, n)

    total = sum(counts.values())
    share = np.cumsum([counts[i] for i in range(q)]) / total
    quantile = {
        "logit": lambda v: np.log(v / (1 - v)), "probit": np.vectorize(dist.norm_ppf), "cloglog": lambda v: np.log(-np.log1p(-v)),
        "loglog": lambda v: -np.log(-np.log(v)), "cauchit": lambda v: np.tan(math.pi * (v - 0.5)),
    }[link]
    start = np.concatenate([np.zeros(p), quantile(share)])
    try:
        b, ll, h, it = _newton(step, start)
    finally:
        rows.unpersist()
    cov = np.linalg.pinv(h)
    labels = [*d.labels, *(f"{i}|{i + 1}" for i in range(q))]
    return Fit(labels, b, np.sqrt(np.diag(cov)), cov, step.n, step.n - len(b), 1.0, {"log_lik": ll, "deviance": -2 * ll, "aic": -2 * ll + 2 * len(b), "iterations": it}, use_t=False)


def predict_multinomial(df: DataFrame, terms: list, fit: Fit, keep: list[str] | None = None) -> DataFrame:
    """Class probabilities of every row, a column a class (the reference last), and the likeliest class: column expressions."""
    d = build(df, terms)
    p = len(d.columns)
    names = list(dict.fromkeys(label.split(":", 1)[0] for label in fit.labels))
    eta = [sum((c * float(b) for c, b in zip(d.columns, fit.coef[i * p : (i + 1) * p])), F.lit(0.0)) for i in range(len(names))] + [F.lit(0.0)]
    top = F.greatest(*eta)
    total = sum((F.exp(e - top) for e in eta), F.lit(0.0))
    names = [*names, "reference"]
    best = F.array_position(F.array(*eta), top)
    return df.select(*(keep or []), *((F.exp(e - top) / total).alias(f"p_{n}") for e, n in zip(eta, names)), F.element_at(F.array(*map(F.lit, names)), best.cast("int")).alias("predicted"))


def predict_ordinal(df: DataFrame, terms: list, fit: Fit, link: str = "logit", keep: list[str] | None = None) -> DataFrame:
    """Probabilities p_0, p_1, ... of the outcomes and the likeliest of every row; column expressions but for probit, which has no built-in."""
    d = build(df, terms, intercept=False)
    p = len(d.columns)
    eta = sum((c.cast("double") * float(b) for c, b in zip(d.columns, fit.coef)), F.lit(0.0))
    cdf = {
        "logit": lambda e: 1 / (1 + F.exp(-e)), "loglog": lambda e: F.exp(-F.exp(-e)), "cloglog": lambda e: -F.expm1(-F.exp(e)), "cauchit": lambda e: F.atan(e) / math.pi + 0.5,
        "probit": F.pandas_udf(lambda e: e.map(dist.norm_cdf, na_action="ignore"), "double") if link == "probit" else None,
    }[link]
    below = [F.lit(0.0), *(cdf(F.lit(float(z)) - eta) for z in fit.coef[p:]), F.lit(1.0)]
    probs = [hi - lo for lo, hi in zip(below, below[1:])]
    rows = df.select(*(keep or []), F.array(*probs).alias("_p"))
    return rows.select(*(keep or []), *(F.col("_p")[i].alias(f"p_{i}") for i in range(len(probs))), (F.array_position("_p", F.array_max("_p")) - 1).cast("int").alias("predicted"))
