"""Linear mixed models with a random intercept, and penalised additive models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.design import build
from lattica.operators.regression import Fit
from lattica.plans.blocks import block_sum, total
from lattica.plans.finish import frame


def group_sums(df: DataFrame, y: str, group: str, columns: list) -> DataFrame:
    """(group, n, s): each group's rows and sums of [X | y]; with the Gram matrix all that the model reads."""
    z = [*columns, F.col(y).cast("double")]
    d = df.select(F.col(group).alias("g"), *(c.cast("double").alias(f"z{i}") for i, c in enumerate(z))).dropna()
    return d.groupBy("g").agg(F.count("*").alias("n"), F.array(*(F.sum(f"z{i}") for i in range(len(z)))).alias("s"))


def lmm(df: DataFrame, y: str, terms: list, group: str, reml: bool = True) -> Fit:
    """Random-intercept model by profiled (restricted) likelihood over the variance ratio.

    One pass for the Gram matrix, one for group sums; each search step scores a grid of ratios in
    one pass over groups, whose vectors never gather on the driver.
    """
    d = build(df, terms)
    p = len(d.columns)
    gram = block_sum(df.where(F.col(group).isNotNull()), [*d.columns, F.col(y)], lambda m: m.T @ m).reshape(p + 1, p + 1)
    n = gram[0, 0]
    groups = group_sums(df.where(F.col(group).isNotNull()), y, group, d.columns).persist()
    k = groups.count()

    def totals(ratios: np.ndarray) -> np.ndarray:
        """For each ratio: sum of s s' r / (1 + n r) and of log(1 + n r)."""
        def run(batches):
            out = np.zeros((len(ratios), (p + 1) ** 2 + 1))
            for pdf in batches:
                s, m = np.array(pdf["s"].to_list()).reshape(-1, p + 1), pdf["n"].to_numpy(float)
                for i, r in enumerate(ratios):
                    w = r / (1 + m * r)
                    out[i, :-1] += (s.T @ (s * w[:, None])).ravel()
                    out[i, -1] += np.log1p(m * r).sum()
            yield pd.DataFrame({"v": [out.ravel().tolist()]})

        got = groups.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(len(got))
        flat[got["i"]] = got["x"]
        return flat.reshape(len(ratios), -1)

    def profile(t: np.ndarray):
        a = gram - t[:-1].reshape(p + 1, p + 1)
        beta = np.linalg.solve(a[:p, :p], a[:p, p])
        rss = a[p, p] - beta @ a[:p, p]
        dof = n - p if reml else n
        dev = dof * math.log(2 * math.pi * rss / dof) + dof + t[-1] + (np.linalg.slogdet(a[:p, :p])[1] if reml else 0.0)
        return dev, beta, rss / dof, a

    try:
        lo, hi, zero = -12.0, 8.0, profile(totals(np.zeros(1))[0])
        for _ in range(6):
            grid = np.exp(np.linspace(lo, hi, 33))
            devs = [profile(t)[0] for t in totals(grid)]
            at, width = int(np.argmin(devs)), (hi - lo) / 32
            lo, hi = math.log(grid[at]) - width, math.log(grid[at]) + width
        ratio = grid[at]
        dev, beta, sigma2, a = profile(totals(np.array([ratio]))[0])
        if zero[0] <= dev:
            ratio, (dev, beta, sigma2, a) = 0.0, zero
    finally:
        groups.unpersist()
    cov = np.linalg.inv(a[:p, :p]) * sigma2
    info = {"sigma2": float(sigma2), "tau2": float(ratio * sigma2), "icc": float(ratio / (1 + ratio)), "deviance": float(dev), "log_lik": -dev / 2, "groups": k}
    return Fit(d.labels, beta, np.sqrt(np.diag(cov)), cov, int(n), n - p, float(sigma2), info)


def blups(df: DataFrame, y: str, terms: list, group: str, fit: Fit) -> DataFrame:
    """Predicted random intercepts of every group: column expressions over group sums."""
    d = build(df, terms)
    s = group_sums(df.where(F.col(group).isNotNull()), y, group, d.columns)
    r = fit.info["tau2"] / fit.info["sigma2"]
    res = F.element_at("s", len(d.columns) + 1) - sum((F.element_at("s", i + 1) * float(b) for i, b in enumerate(fit.coef)), F.lit(0.0))
    return s.select(F.col("g").alias(group), "n", (r * res / (1 + F.col("n") * r)).alias("intercept"))


def curvature(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(jumps, gram) of a natural cubic spline: gram times the second derivatives at inner knots equals jumps times the values at all knots.

    Jumps are differences of slopes, gram holds the integrals of products of hat functions.
    """
    gaps = np.diff(knots)
    slopes = np.diff(np.eye(len(knots)), axis=0) / gaps[:, None]
    hats = np.diag((gaps[:-1] + gaps[1:]) / 3) + np.diag(gaps[1:-1] / 6, 1) + np.diag(gaps[1:-1] / 6, -1)
    return np.diff(slopes, axis=0), hats


def cubic_basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Natural cubic regression spline by values at the knots; constant beyond them."""
    jumps, hats = curvature(knots)
    bends = np.pad(np.linalg.solve(hats, jumps), ((1, 1), (0, 0)))  # second derivatives at the knots, zero at the ends
    x = np.clip(x, knots[0], knots[-1])
    left = np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)
    gap = (knots[left + 1] - knots[left])[:, None]
    share = (x - knots[left])[:, None] / gap
    values = np.eye(len(knots))
    straight = (1 - share) * values[left] + share * values[left + 1]
    bent = lambda u: gap**2 * (u**3 - u) / 6
    return straight + bent(1 - share) * bends[left] + bent(share) * bends[left + 1]


def cubic_penalty(knots: np.ndarray) -> np.ndarray:
    """The integral of the squared second derivative as a quadratic form in the values at the knots."""
    jumps, hats = curvature(knots)
    return jumps.T @ np.linalg.solve(hats, jumps)


def gam(df: DataFrame, y: str, smooths: list[str], k: int = 10) -> DataFrame:
    """Additive model of cubic regression splines: coefficients from one Gram matrix, smoothing by generalised cross-validation.

    Knots are quantiles; every smooth is centred. Returns a smooth's fitted values at its knots with the
    model's effective degrees of freedom and score.
    """
    d = df.where(F.col(y).isNotNull())
    probs = [float(v) for v in np.linspace(0, 1, k)]
    knots = {}
    for s in smooths:
        q = np.unique(d.agg(F.percentile_approx(F.col(s).cast("double"), probs, 10_000)).first()[0])
        if len(q) < 4:
            raise ValueError(f"{s} has too few distinct values for a smooth")
        knots[s] = q
    sizes = [len(knots[s]) for s in smooths]
    width = 1 + sum(sizes)
    grids = [knots[s] for s in smooths]

    def fold(m):
        x = np.column_stack([np.ones(len(m)), *(cubic_basis(m[:, i], g) for i, g in enumerate(grids)), m[:, -1]])
        return x.T @ x

    g = block_sum(d, [*smooths, y], fold).reshape(width + 1, width + 1)
    n = g[0, 0]
    z = np.zeros((width, 1 + sum(q - 1 for q in sizes)))
    z[0, 0] = 1
    row, col, pens = 1, 1, []
    for q, kn in zip(sizes, grids):
        c = g[0, row : row + q][None, :]
        null = np.linalg.svd(c)[2][1:].T
        z[row : row + q, col : col + q - 1] = null
        pen = np.zeros((z.shape[1], z.shape[1]))
        s = null.T @ cubic_penalty(kn) @ null
        pen[col : col + q - 1, col : col + q - 1] = s / np.linalg.norm(s) * np.linalg.norm(null.T @ g[row : row + q, row : row + q] @ null)
        pens.append(pen)
        row, col = row + q, col + q - 1
    xx, xy, yy = z.T @ g[:width, :width] @ z, z.T @ g[:width, width], g[width, width]
    jitter = 1e-10 * np.trace(xx) / len(xx) * np.eye(len(xx))

    def score(lam):
        a = np.linalg.inv(xx + jitter + sum(l * p for l, p in zip(lam, pens)))
        b = a @ xy
        edf = np.trace(a @ xx)
        rss = yy - 2 * b @ xy + b @ xx @ b
        return n * rss / (n - edf) ** 2, b, edf, rss

    lam = np.ones(len(pens)) * 0.01
    for _ in range(4):
        for i in range(len(pens)):
            tries = [(score(np.where(np.arange(len(lam)) == i, v, lam))[0], v) for v in np.geomspace(1e-8, 1e6, 57)]
            lam[i] = min(tries)[1]
    gcv, b, edf, rss = score(lam)
    full = z @ b
    rows, at = [], 1
    for s, q, kn, lv in zip(smooths, sizes, grids, lam):
        rows += [(s, float(x), float(v), float(lv), float(edf), float(gcv), float(b[0]), float(rss / (n - edf))) for x, v in zip(kn, full[at : at + q])]
        at += q
    return frame(df.sparkSession, rows, "smooth string, knot double, value double, lambda double, edf double, gcv double, intercept double, scale double")


def glmm(df: DataFrame, y: str, terms: list, group: str, family: str = "binomial", rounds: int = 3) -> Fit:
    """Random-intercept binomial or Poisson model by Laplace approximation, coefficients at the joint mode.

    All values of a grid of standard deviations are fitted in the same passes: each group finds its own modes
    and returns a score, a Schur complement and its Laplace term for every value; the grid then narrows.
    Groups are gathered once, a row each with counts of its equal rows; a pass takes many groups at a time.
    """
    if family not in ("binomial", "poisson"):
        raise ValueError("family must be binomial or poisson")
    d = build(df, terms)
    p = len(d.columns)
    xs = [f"x{i}" for i in range(p)]
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), *(c.cast("double").alias(x) for c, x in zip(d.columns, xs)), F.col(y).cast("double").alias("y")).dropna()
    context = df.sparkSession.sparkContext
    counts = rows.groupBy("g", *xs, "y").agg(F.count("*").cast("double").alias("n")).repartition(4 * context.defaultParallelism, "g")
    groups = counts.groupBy("g").agg(F.flatten(F.collect_list(F.array(*xs, "y", "n"))).alias("v")).persist()
    lg = np.vectorize(math.lgamma)
    binomial = family == "binomial"

    def sums(betas: np.ndarray, taus: np.ndarray) -> np.ndarray:
        prior = 1 / taus**2

        def mean(eta):
            mu = 1 / (1 + np.exp(-eta)) if binomial else np.exp(eta)
            return mu, mu * (1 - mu) if binomial else mu

        def fold(m, starts, sizes):
            """Many groups at once: rows by values of the grid, summed over each group's rows."""
            x, t, n = m[:, :p], m[:, p, None], m[:, p + 1, None]
            own = np.repeat(np.arange(len(starts)), sizes)
            over = lambda v: np.add.reduceat(v, starts, axis=0)
            eta0, u = x @ betas.T, np.zeros((len(starts), len(taus)))
            going = np.ones(u.shape, bool)
            for _ in range(30):
                mu, w = mean(np.clip(eta0 + u[own], -30, 30))
                step = (over(n * (t - mu)) - u * prior) / (over(n * w) + prior)
                u += np.where(going, np.clip(step, -2.0, 2.0), 0.0)
                going &= np.abs(step) >= 1e-10
                if not going.any():
                    break
            eta = np.clip(eta0 + u[own], -30, 30)
            mu, w = mean(eta)
            ll = (n * (t * eta - np.logaddexp(0, eta) if binomial else t * eta - mu - lg(t + 1))).sum(0)
            w = n * w
            h = over(w) + prior
            laplace = ll - (u * u).sum(0) * prior / 2 - 0.5 * np.log(h * taus**2).sum(0)
            score = (n * (t - mu)).T @ x
            out = []
            for k in range(len(taus)):
                xw = over(x * w[:, k, None])
                schur = x.T @ (x * w[:, k, None]) - xw.T @ (xw / h[:, k, None])
                out += [laplace[k], *score[k], *schur.ravel()]
            return np.array(out)

        def run(batches):
            acc = None
            for b in batches:
                v = b.column(0)
                ends = v.offsets.to_numpy() - v.offsets[0].as_py()
                m = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 2)
                ends = ends // (p + 2)
                lo = 0
                while lo < len(ends) - 1:  # about 50,000 rows at a time, a group at least
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 50_000, "right")) - 1)
                    part = fold(m[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo], np.diff(ends[lo : hi + 1]))
                    acc = part if acc is None else acc + part
                    lo = hi
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["v"])

        return total(groups.select("v").mapInArrow(run, "v array<double>")).reshape(len(taus), -1)

    try:
        taus, beta0 = np.geomspace(0.05, 5, 9), np.zeros(p)
        for _ in range(rounds):
            betas = np.tile(beta0, (len(taus), 1))
            for _ in range(25):
                s = sums(betas, taus)
                moves = np.array([np.linalg.solve(v[1 + p :].reshape(p, p), v[1 : 1 + p]) for v in s])
                betas = betas + np.clip(moves, -3, 3)
                if np.abs(moves).max() < 1e-7:
                    break
            s = sums(betas, taus)
            best = int(np.argmax(s[:, 0]))
            beta0, lo, hi = betas[best], taus[max(best - 1, 0)], taus[min(best + 1, len(taus) - 1)]
            tau, value, info = taus[best], s[best, 0], s[best, 1 + p :].reshape(p, p)
            taus = np.geomspace(lo, hi, 9)
        n, k = (int(v) for v in counts.agg(F.sum("n"), F.countDistinct("g")).first())
    finally:
        groups.unpersist()
    cov = np.linalg.inv(info)
    return Fit(d.labels, beta0, np.sqrt(np.diag(cov)), cov, n, n - p, 1.0, {"tau": float(tau), "log_lik": float(value), "groups": k, "family": family}, use_t=False)
