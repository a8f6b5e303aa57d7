"""Linear and generalised linear models, ridge, negative binomial and simple regression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import dist
from lattica.functions.design import Design, build
from lattica.plans.blocks import block_sum, collapse, equal_rows, tsqr
from lattica.plans.finish import frame


@dataclass
class Fit:
    """A fitted model: coefficients by label and the numbers that describe the fit."""

    labels: list[str]
    coef: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    n: int
    df_residual: float
    dispersion: float
    info: dict = field(default_factory=dict)
    use_t: bool = True

    def conf_int(self, level: float = 0.95) -> np.ndarray:
        q = dist.t_ppf((1 + level) / 2, self.df_residual) if self.use_t else dist.norm_ppf((1 + level) / 2)
        return np.column_stack([self.coef - q * self.se, self.coef + q * self.se])

    def table(self, spark, level: float = 0.95) -> DataFrame:
        """One row a coefficient: estimate, standard error, statistic, p-value, interval."""
        ci, rows = self.conf_int(level), []
        for k, name in enumerate(self.labels):
            b, s = float(self.coef[k]), float(self.se[k])
            z = b / s if s and not math.isnan(s) else math.nan
            p = math.nan if math.isnan(z) else 2 * (dist.t_sf(abs(z), self.df_residual) if self.use_t else dist.norm_sf(abs(z)))
            rows.append((name, b, s, z, p, float(ci[k, 0]), float(ci[k, 1])))
        return frame(spark, rows, "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double")


def simple_ols(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Slope, intercept, R squared (plain and adjusted) and the slope's error, a group a row: one aggregation."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.where(a.isNotNull() & b.isNotNull()).groupBy(*(by or [])).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r_squared"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy")
    )
    adj = 1 - (1 - F.col("r_squared")) * (F.col("n") - 1) / (F.col("n") - 2)
    se = F.sqrt((1 - F.col("r_squared")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))
    return s.where("n > 2").select(*(by or []), "n", "slope", "intercept", "r_squared", adj.alias("adj_r_squared"), se.alias("slope_se"))


def _solve_r(r: np.ndarray, tol: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, unscaled covariance and kept columns from the R factor of [X | y]; aliased columns get NaN."""
    p = r.shape[1] - 1
    keep: list[int] = []
    for j in range(p):
        trial = [*keep, j]
        sub = np.linalg.qr(r[:, trial], mode="r")
        if abs(sub[-1, -1]) > tol * max(1e-300, np.linalg.norm(r[:, j])):
            keep.append(j)
    k = np.array(keep, int)
    q, rk = np.linalg.qr(r[:, k])
    beta, cov = np.full(p, np.nan), np.full((p, p), np.nan)
    beta[k] = np.linalg.solve(rk, q.T @ r[:, p])
    inv = np.linalg.inv(rk)
    cov[np.ix_(k, k)] = inv @ inv.T
    return beta, cov, k


def lm(df: DataFrame, y: str, terms: list, weights: str | None = None, offset: str | None = None, intercept: bool = True) -> Fit:
    """Least squares by a distributed QR of [X | y]; one pass, p x p on the driver."""
    d = build(df, terms, intercept)
    w = F.sqrt(F.col(weights).cast("double")) if weights else F.lit(1.0)
    target = F.col(y).cast("double") - (F.col(offset) if offset else F.lit(0.0))
    rows = df.where(F.col(weights) > 0) if weights else df
    r = tsqr(rows, [*(c * w for c in d.columns), target * w])
    sums = block_sum(rows, [*d.columns, target, w * w], lambda m: np.array([len(m), (m[:, -1] * m[:, -2]).sum(), m[:, -1].sum(), (m[:, -1] * m[:, -2] ** 2).sum()]))
    beta, unscaled, keep = _solve_r(r)
    n, rank = int(sums[0]), len(keep)
    rss = float(np.sum((r[:, -1] - r[:, keep] @ beta[keep]) ** 2))
    tss = float(sums[3] - (sums[1] ** 2 / sums[2] if intercept else 0))
    dfr = n - rank
    sigma2 = rss / dfr if dfr > 0 else math.nan
    r2 = 1 - rss / tss if tss > 0 else math.nan
    dfm = rank - int(intercept)
    f = (tss - rss) / dfm / sigma2 if dfm and sigma2 else math.nan
    info = {"rss": rss, "tss": tss, "sigma": math.sqrt(sigma2) if sigma2 == sigma2 else math.nan, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - int(intercept)) / dfr if dfr else math.nan, "f": f, "f_p_value": dist.f_sf(f, dfm, dfr) if dfm else math.nan, "rank": rank}
    info["log_lik"] = -n / 2 * (math.log(2 * math.pi * rss / n) + 1) if rss > 0 else math.inf
    info["aic"] = -2 * info["log_lik"] + 2 * (rank + 1)
    return Fit(d.labels, beta, np.sqrt(np.diag(unscaled) * sigma2), unscaled * sigma2, n, dfr, sigma2, info)


def ridge(df: DataFrame, y: str, terms: list, l2: float) -> Fit:
    """Ridge on columns standardised by their population deviations; the intercept is free, errors are not given."""
    d = build(df, terms, True)
    k = len(d.columns)
    g = block_sum(df, [*d.columns, F.col(y)], lambda m: m.T @ m).reshape(k + 1, k + 1)
    n = g[0, 0]
    mean = g[0] / n
    s = g / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(s))[1:k]
    corr = s[1:k, 1:k] / np.outer(sd, sd)
    beta = np.linalg.solve(n * corr + l2 * np.eye(k - 1), n * s[1:k, k] / sd) / sd
    coef = np.concatenate([[mean[k] - mean[1:k] @ beta], beta])
    nan = np.full(k, np.nan)
    return Fit(d.labels, coef, nan, np.full((k, k), np.nan), int(n), n - k, math.nan, {"l2": l2})


_sp = np.vectorize(math.erfc)
_lgamma = np.vectorize(math.lgamma)
_digamma, _trigamma = np.vectorize(dist.digamma), np.vectorize(dist.trigamma)


def _phi(x):
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


#: Link: (mu -> eta, eta -> mu, d mu / d eta).
LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: np.ones_like(e)),
    "log": (np.log, lambda e: np.maximum(np.exp(e), 1e-300), lambda e: np.maximum(np.exp(e), 1e-300)),
    "logit": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-np.clip(e, -30, 30))), lambda e: np.maximum(np.exp(-np.abs(e)) / (1 + np.exp(-np.abs(e))) ** 2, 2.220446e-16)),
    "probit": (np.vectorize(dist.norm_ppf), lambda e: np.clip(0.5 * _sp(-e / math.sqrt(2)), 2.2e-16, 1 - 2.2e-16), lambda e: np.maximum(_phi(e), 2.2e-16)),
    "cloglog": (lambda m: np.log(-np.log1p(-m)), lambda e: np.clip(-np.expm1(-np.exp(np.minimum(e, 700))), 2.2e-16, 1 - 2.2e-16), lambda e: np.maximum(np.exp(np.minimum(e, 700) - np.exp(np.minimum(e, 700))), 2.2e-16)),
    "cauchit": (lambda m: np.tan(math.pi * (m - 0.5)), lambda e: np.clip(0.5 + np.arctan(e) / math.pi, 2.2e-16, 1 - 2.2e-16), lambda e: 1 / (math.pi * (1 + e * e))),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e)),
    "sqrt": (np.sqrt, lambda e: e * e, lambda e: 2 * e),
    "1/mu^2": (lambda m: 1 / (m * m), lambda e: 1 / np.sqrt(e), lambda e: -0.5 * e**-1.5),
}


def _ylogy(y, m):
    return np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / m), 0.0)


#: Family: (default link, variance, unit deviance, starting mean, dispersion known).
FAMILIES = {
    "gaussian": ("identity", lambda m: np.ones_like(m), lambda y, m: (y - m) ** 2, lambda y, w: y, False),
    "binomial": ("logit", lambda m: m * (1 - m), lambda y, m: 2 * (_ylogy(y, m) + _ylogy(1 - y, 1 - m)), lambda y, w: (w * y + 0.5) / (w + 1), True),
    "poisson": ("log", lambda m: m, lambda y, m: 2 * (_ylogy(y, m) - (y - m)), lambda y, w: y + 0.1, True),
    "gamma": ("inverse", lambda m: m * m, lambda y, m: -2 * (np.log(np.where(y > 0, y / m, 1)) - (y - m) / m), lambda y, w: y, False),
    "inverse_gaussian": ("1/mu^2", lambda m: m**3, lambda y, m: (y - m) ** 2 / (y * m * m), lambda y, w: y, False),
}


def family_of(name: str, theta: float | None = None):
    if name == "negative_binomial":
        th = float(theta)
        return ("log", lambda m: m + m * m / th, lambda y, m: 2 * (_ylogy(y, m) - (y + th) * np.log((y + th) / (m + th))), lambda y, w: y + np.where(y == 0, 1 / 6, 0), True)
    quasi = name.startswith("quasi")
    base = FAMILIES[name.removeprefix("quasi").strip("_") if quasi else name]
    return (*base[:4], False) if quasi else base


def _lgamma(v: np.ndarray) -> np.ndarray:
    u, back = np.unique(v, return_inverse=True)
    return np.array([math.lgamma(x) for x in u])[back]


def _own_lik(family: str, y: np.ndarray, w: np.ndarray, theta: float | None) -> np.ndarray:
    """What each row adds to the log likelihood of its cell whatever the mean; see `_log_lik`."""
    if family == "gaussian":
        return np.log(w)
    if family == "binomial":
        if (w == 1).all() and ((y == 0) | (y == 1)).all():
            return np.zeros(len(y))
        return _lgamma(w + 1) - _lgamma(w * y + 1) - _lgamma(w - w * y + 1)
    if family == "poisson":
        return -w * _lgamma(y + 1)
    if family in ("gamma", "inverse_gaussian"):
        return w * np.log(y)
    if family == "negative_binomial":
        return w * (_lgamma(y + theta) - _lgamma(y + 1))
    return np.zeros(len(y))


def _log_lik(family: str, y: np.ndarray, mu: np.ndarray, w: np.ndarray, n: np.ndarray, own: np.ndarray, scale: float, theta: float | None) -> float:
    """Log likelihood of cells of n rows with mean response y, total weight w and the sum `own` of `_own_lik`; `scale` is the mean deviance. Quasi families have none."""
    if family == "gaussian":  # `scale` here is the deviance by the number of rows: weights divide the variance
        return float((-0.5 * (n * (math.log(2 * math.pi * scale) + 1) - own)).sum())
    if family == "binomial":
        return float((own + np.where(y > 0, w * y * np.log(np.where(y > 0, mu, 1.0)), 0.0) + np.where(y < 1, w * (1 - y) * np.log1p(-np.where(y < 1, mu, 0.0)), 0.0)).sum())
    if family == "poisson":
        return float((w * (y * np.log(mu) - mu) + own).sum())
    if family == "gamma":
        return float(((1 / scale - 1) * own - w * (y / (mu * scale) + np.log(mu * scale) / scale + math.lgamma(1 / scale))).sum())
    if family == "inverse_gaussian":
        return float((-0.5 * (w * (math.log(2 * math.pi * scale) + 1) + 3 * own)).sum())
    if family == "negative_binomial":
        return float((own + w * (-math.lgamma(theta) + theta * np.log(theta / (theta + mu)) + np.where(y > 0, y * np.log(mu / (theta + mu)), 0.0))).sum())
    return math.nan


def _cells(k: int, family: str, theta: float | None):
    """Fold of rows (x of k columns, y, weight, offset, count) into cells of equal x and offset.

    A cell holds x, the mean response, weight, offset, rows, and sums of the squares and unit deviances of its
    responses about their mean and of `_own_lik`. The deviance of the rows about any mean is that of the
    cell's mean response plus its own, since unit deviances are Bregman divergences; squares likewise.
    """
    deviance = family_of(family, theta)[2]

    def fold(m: np.ndarray) -> np.ndarray:
        if m.shape[1] == k + 4:
            m = m[m[:, k + 1] > 0]
            y, w, c = m[:, k], m[:, k + 1], m[:, k + 3]
            with np.errstate(all="ignore"):
                own = c * _own_lik(family, y, w, theta)
            m = np.column_stack([m[:, : k + 1], w * c, m[:, k + 2], c, np.zeros(len(m)), np.zeros(len(m)), own])
        y, w = m[:, k], m[:, k + 1]
        if not len(m) or (family.removeprefix("quasi").strip("_") in ("gamma", "inverse_gaussian") and not (y > 0).all()):
            return m  # responses outside the family: left for the fit to refuse
        code, first = equal_rows(np.column_stack([m[:, :k], m[:, k + 2]]))
        add = lambda v: np.bincount(code, v, len(first))
        weight = add(w)
        mean = add(w * y) / weight
        with np.errstate(all="ignore"):
            gap = add(m[:, k + 4] + w * (y - mean[code]) ** 2)
            dev = add(m[:, k + 5] + w * deviance(y, mean[code]))
        return np.column_stack([m[first, :k], mean, weight, m[first, k + 2], add(m[:, k + 3]), gap, dev, add(m[:, k + 6])])

    return fold


def glm(df: DataFrame, y: str, terms: list, family: str = "binomial", link: str | None = None, weights: str | None = None, offset: str | None = None, theta: float | None = None, l2: float = 0.0, tol: float = 1e-8, max_iter: int = 25, count: str | None = None) -> Fit:
    """Iteratively reweighted least squares; each step is one pass that sums X'WX, X'Wz and the deviance.

    One pass over the rows folds those of equal covariates into cells (see `_cells`), which are persisted for the steps.
    `count`: how many equal rows each row stands for. Raises if the deviance doesn't settle in `max_iter` steps.
    """
    default, variance, deviance, start, known = family_of(family, theta)
    eta_of, mu_of, slope = LINKS[link or default]
    d = build(df, terms, True)
    k = len(d.columns)
    one = F.lit(1.0)
    cols = [*d.columns, F.col(y), F.col(weights) if weights else one, F.col(offset) if offset else F.lit(0.0), F.col(count) if count else one]
    names = [f"c{i}" for i in range(k + 7)]
    rows = collapse(df, cols, _cells(k, family, theta), names).persist()

    def step(beta):
        def fold(m):
            x, t, w, o, n, gap, dev = m[:, :k], *m[:, k : k + 6].T
            if beta is None:
                mu = start(t, w)
                eta = eta_of(mu)
            else:
                eta = x @ beta + o
                mu = mu_of(eta)
            g = slope(eta)
            z, ww = eta - o + (t - mu) / g, w * g * g / variance(mu)
            xw = x * ww[:, None]
            pearson = float(((w * (t - mu) ** 2 + gap) / variance(mu)).sum())
            return np.concatenate([(xw.T @ x).ravel(), xw.T @ z, [float((w * deviance(t, mu) + dev).sum()), pearson, n.sum(), (w * t).sum(), w.sum()]])

        s = block_sum(rows, names, fold)
        return s[: k * k].reshape(k, k), s[k * k : k * k + k], s[k * k + k :]

    try:
        pen = np.diag([0.0, *[l2] * (k - 1)])
        xwx, xwz, s = step(None)
        beta, last = np.linalg.lstsq(xwx + pen, xwz, rcond=None)[0], math.inf
        for it in range(1, max_iter + 1):
            xwx, xwz, s = step(beta)
            if abs(s[0] - last) / (abs(s[0]) + 0.1) < tol:
                break
            last = s[0]
            beta = np.linalg.lstsq(xwx + pen, xwz, rcond=None)[0]
        else:
            raise ArithmeticError(f"the deviance did not settle in {max_iter} steps")
        mean = s[3] / s[4]
        scale = float(s[0] / (s[2] if family == "gaussian" else s[4]))

        def close(m):
            t, w, n, dev, own = m[:, k], m[:, k + 1], m[:, k + 3], m[:, k + 5], m[:, k + 6]
            mu = mu_of(m[:, :k] @ beta + m[:, k + 2])
            return np.array([(w * deviance(t, np.full(len(m), mean)) + dev).sum(), _log_lik(family, t, mu, w, n, own, scale, theta), dev.sum()])

        null, ll, inner = block_sum(rows, names, close)
        if offset:
            # With an offset the null model has no common mean, so it's fitted.
            null = inner + glm(rows, f"c{k}", [], family, link, f"c{k + 1}", f"c{k + 2}", theta).info["deviance"] if k > 1 else s[0]
    finally:
        rows.unpersist()
    n = int(s[2])
    size = np.sqrt(np.maximum(np.diag(xwx), 1e-300))
    rank = int(np.linalg.matrix_rank(xwx / np.outer(size, size), tol=1e-10, hermitian=True))
    dfr = n - rank
    disp = 1.0 if known else float(s[1] / dfr)
    cov = np.linalg.pinv(xwx + pen) * disp
    info = {"deviance": float(s[0]), "null_deviance": float(null), "pearson": float(s[1]), "iterations": it, "family": family, "link": link or default}
    free = rank + (family in ("gaussian", "gamma", "inverse_gaussian", "negative_binomial"))
    info |= {"rank": rank, "log_lik": float(ll), "aic": float(2 * free - 2 * ll), "bic": float(math.log(n) * free - 2 * ll)}
    return Fit(d.labels, beta, np.sqrt(np.diag(cov)) if not l2 else np.full(k, np.nan), cov, n, dfr, disp, info, use_t=not known)


def negative_binomial(df: DataFrame, y: str, terms: list, max_outer: int = 25, tol: float = 1e-6) -> Fit:
    """Alternates the regression at fixed theta with theta's likelihood equation, solved by bisection on passes over a grid."""
    fit = glm(df, y, terms, "poisson")
    theta = None
    for _ in range(max_outer):
        d, b = build(df, terms, True), fit.coef
        k = len(b)
        lo, hi = 1e-3, 1e6
        for _ in range(4):  # each pass evaluates the score on 41 points
            grid = np.geomspace(lo, hi, 41)

            def score(m, grid=grid, b=b, k=k):
                mu, t = np.exp(m[:, :k] @ b), m[:, k]
                u, back = np.unique(t, return_inverse=True)
                return np.array([(_digamma(u + th) - dist.digamma(th))[back].sum() + (np.log(th) - np.log(th + mu) + 1 - (t + th) / (mu + th)).sum() for th in grid])

            s = block_sum(df, [*d.columns, F.col(y)], score)
            at = np.flatnonzero((s[:-1] > 0) & (s[1:] <= 0))
            if not len(at):
                lo = hi = grid[-1] if s[-1] > 0 else grid[0]
                break
            lo, hi = grid[at[0]], grid[at[0] + 1]
        new = math.sqrt(lo * hi)
        fit = glm(df, y, terms, "negative_binomial", theta=new)
        if theta is not None and abs(new - theta) < tol * new:
            break
        theta = new
    fit.info["theta"] = new
    return fit


def drop1(df: DataFrame, y: str, terms: list, family: str | None = None) -> DataFrame:
    """Single-term deletions: degrees of freedom, deviance or residual sum of squares, and the test's p-value."""
    spark, rows = df.sparkSession, []
    fit = lambda t: lm(df, y, t) if family is None else glm(df, y, t, family)
    full = fit(terms)
    loss = lambda f: f.info["rss"] if family is None else f.info["deviance"]
    for t in terms:
        less = fit([u for u in terms if u != t])
        d, change = less.df_residual - full.df_residual, loss(less) - loss(full)
        if family is None or not FAMILIES.get(family, (0, 0, 0, 0, True))[4]:
            stat = change / d / full.dispersion
            p = dist.f_sf(stat, d, full.df_residual)
        else:
            stat, p = change, dist.chi2_sf(change, d)
        rows.append((":".join(getattr(x, "name", x) for x in (t if isinstance(t, tuple) else (t,))), float(d), float(change), float(stat), float(p)))
    return frame(spark, rows, "term string, df double, change double, statistic double, p_value double")


def diagnostics(df: DataFrame, y: str, terms: list, fit: Fit, keep: list[str] | None = None) -> DataFrame:
    """Fitted value, residual, leverage, internally studentised residual and Cook's distance of every row of a linear fit.

    Column expressions over the design with the p x p unscaled covariance as constants: no shuffle.
    """
    d = build(df, terms)
    ok = [i for i in range(len(d.columns)) if not math.isnan(fit.coef[i])]
    unscaled = fit.cov / fit.dispersion
    fitted = sum((d.columns[i] * float(fit.coef[i]) for i in ok), F.lit(0.0))
    hat = sum((d.columns[i] * d.columns[j] * float(unscaled[i, j]) for i in ok for j in ok), F.lit(0.0))
    rows = df.withColumns({"fitted": fitted, "leverage": hat})
    rows = rows.withColumn("residual", F.col(y).cast("double") - F.col("fitted"))
    rows = rows.withColumn("studentised", F.col("residual") / F.sqrt(fit.dispersion * (1 - F.col("leverage"))))
    cook = F.col("studentised") ** 2 * F.col("leverage") / ((1 - F.col("leverage")) * len(ok))
    return rows.select(*(keep or []), "fitted", "residual", "leverage", "studentised", cook.alias("cooks_distance"))


def glm_residuals(df: DataFrame, y: str, terms: list, fit: Fit, weights: str | None = None, offset: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Fitted mean, linear predictor, and the response, working, Pearson and deviance residuals of every complete row of a `glm`; no shuffle."""
    _, variance, deviance, _, _ = family_of(fit.info["family"], fit.info.get("theta"))
    mu_of, slope = LINKS[fit.info["link"]][1:]
    d, beta = build(df, terms, True), fit.coef
    k, keep = len(d.columns), keep or []
    cols = [*d.columns, F.col(y), F.col(weights) if weights else F.lit(1.0), F.col(offset) if offset else F.lit(0.0)]
    names = [f"_c{i}" for i in range(k + 3)]
    rows = df.select(*keep, *(c.cast("double").alias(n) for c, n in zip(cols, names))).dropna(subset=names)
    out = ["fitted", "linear_predictor", "response", "working", "pearson", "deviance"]

    def run(batches):
        for b in batches:
            m = b[names].to_numpy(float)
            t, w, eta = m[:, k], m[:, k + 1], m[:, :k] @ beta + m[:, k + 2]
            mu = mu_of(eta)
            unit = np.maximum(w * deviance(t, mu), 0.0)
            got = [mu, eta, t - mu, (t - mu) / slope(eta), (t - mu) * np.sqrt(w / variance(mu)), np.sign(t - mu) * np.sqrt(unit)]
            yield b[keep].assign(**dict(zip(out, got)))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) if keep else ""
    return rows.mapInPandas(run, ", ".join([*([kept] if kept else []), *(f"{n} double" for n in out)]))


def deviance_table(df: DataFrame, y: str, terms: list, family: str = "binomial") -> DataFrame:
    """Sequential analysis of deviance: a row a term added, tested by chi-squared or, with free dispersion, by F."""
    fits = [glm(df, y, terms[:k], family) for k in range(len(terms) + 1)]
    known, last, rows = family_of(family, 1.0)[4], fits[-1], []
    for k in range(1, len(fits)):
        d, change = fits[k - 1].df_residual - fits[k].df_residual, fits[k - 1].info["deviance"] - fits[k].info["deviance"]
        stat = change if known else change / d / last.dispersion
        p = dist.chi2_sf(max(change, 0.0), d) if known else dist.f_sf(stat, d, last.df_residual)
        t = terms[k - 1]
        rows.append((":".join(getattr(x, "name", x) for x in (t if isinstance(t, tuple) else (t,))), float(d), change, float(fits[k].df_residual), fits[k].info["deviance"], stat, p))
    return frame(df.sparkSession, rows, "term string, df double, deviance double, resid_df double, resid_dev double, statistic double, p_value double")


def profile_conf_int(df: DataFrame, y: str, terms: list, term: str, family: str = "binomial", conf_level: float = 0.95, tol: float = 1e-5) -> tuple[float, float]:
    """Profile-likelihood interval of a numeric term's coefficient: refits with the term as an offset, by secant steps on the root of the deviance."""
    fit = glm(df, y, terms, family)
    k = fit.labels.index(term)
    est, se, dev = float(fit.coef[k]), float(fit.se[k]), fit.info["deviance"]
    rest = [t for t in terms if t != term]

    def root(b: float) -> float:
        """Square root of the scaled deviance the coefficient costs: close to linear in it."""
        rows = df.withColumn("_offset", F.col(term).cast("double") * b)
        return math.sqrt(max(0.0, glm(rows, y, rest, family, offset="_offset").info["deviance"] - dev) / fit.dispersion)

    z, ends = math.sqrt(dist.chi2_ppf(conf_level, 1)), []
    for side in (-1, 1):
        near, at_near, far = est, 0.0, est + side * z * se
        at_far = root(far)
        for _ in range(20):
            if abs(at_far - z) <= tol:
                break
            move = (z - at_far) * (far - near) / (at_far - at_near) if at_far != at_near else side * se
            near, at_near, far = far, at_far, far + move
            at_far = root(far)
        ends.append(far)
    return ends[0], ends[1]


def batched_ols(df: DataFrame, ys: list[str], terms: list) -> DataFrame:
    """Many responses on one design, from one pass: a row a response and coefficient."""
    d = build(df, terms)
    p, q = len(d.columns), len(ys)
    g = block_sum(df, [*d.columns, *ys], lambda m: m.T @ m).reshape(p + q, p + q)
    b = np.linalg.solve(g[:p, :p], g[:p, p:])
    rss = np.diag(g[p:, p:] - b.T @ g[:p, p:])
    inv, dof = np.diag(np.linalg.inv(g[:p, :p])), g[0, 0] - p
    rows = [(y, label, b[i, j], math.sqrt(inv[i] * rss[j] / dof)) for j, y in enumerate(ys) for i, label in enumerate(d.labels)]
    return frame(df.sparkSession, rows, "response string, term string, estimate double, std_error double")
