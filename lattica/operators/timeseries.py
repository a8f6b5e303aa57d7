"""Time series: differences, autocorrelations, unit roots, decomposition, smoothing, ARIMA; a series a group.

A series is a key and an ordered value. Lag statistics are windows and self-joins over dense positions;
recursive models run a series a task, so the scale is across series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dist


def positions(df: DataFrame, order: str, value: str, key: str | None = None) -> DataFrame:
    """(key, t, y): values by their place from 1 in each series."""
    k = F.col(key) if key else F.lit("all")
    return df.select(k.alias("key"), F.row_number().over(Window.partitionBy(k).orderBy(order)).alias("t"), F.col(value).cast("double").alias("y"))


def diff(series: DataFrame, lag: int = 1, differences: int = 1) -> DataFrame:
    """Lagged differences, repeated; the first values of a series go."""
    for _ in range(differences):
        w = Window.partitionBy("key").orderBy("t")
        series = series.withColumn("y", F.col("y") - F.lag("y", lag).over(w)).where("y is not null")
    return series


def acf(series: DataFrame, max_lag: int = 10, kind: str = "correlation") -> DataFrame:
    """Autocorrelation (or covariance) up to `max_lag`: one window pass, one aggregation."""
    w = Window.partitionBy("key").orderBy("t")
    mean = F.avg("y").over(Window.partitionBy("key"))
    c = series.withColumn("c", F.col("y") - mean)
    c = c.withColumns({f"l{k}": F.lag("c", k).over(w) for k in range(max_lag + 1)})
    sums = c.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("c") * F.col(f"l{k}")) for k in range(max_lag + 1))).alias("s"))
    scale = F.element_at("s", 1) if kind == "correlation" else F.col("n")
    return sums.select("key", F.posexplode(F.transform("s", lambda v: v / scale)).alias("lag", "acf")).where("acf is not null")


def levinson(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partial autocorrelations and the last predictor's coefficients from autocorrelations (lag 0 first)."""
    phi, v, out = np.zeros(0), r[0], []
    for k in range(1, len(r)):
        a = (r[k] - phi @ r[1:k][::-1]) / v
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(a)
    return np.array(out), phi


def pacf(series: DataFrame, max_lag: int = 10) -> DataFrame:
    """Partial autocorrelations by the Levinson-Durbin recursion on the collapsed autocorrelations."""
    def run(key, pdf):
        a, _ = levinson(pdf.sort_values("lag")["acf"].to_numpy())
        return pd.DataFrame({"key": key[0], "lag": np.arange(1, len(a) + 1), "pacf": a})

    kind = acf(series, max_lag).schema["key"].dataType.simpleString()
    return acf(series, max_lag).groupBy("key").applyInPandas(run, f"key {kind}, lag int, pacf double")


def per_series(series: DataFrame, run, schema: str) -> DataFrame:
    """Apply `run(values) -> frame` to each ordered series."""
    kind = series.schema["key"].dataType.simpleString()

    def one(key, pdf):
        out = run(pdf.sort_values("t")["y"].to_numpy(float))
        out.insert(0, "key", key[0])
        return out

    return series.groupBy("key").applyInPandas(one, f"key {kind}, {schema}")


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    s2 = e @ e / max(1, len(y) - x.shape[1])
    return b, np.sqrt(np.diag(np.linalg.pinv(x.T @ x) * s2)), e


def kpss(series: DataFrame, trend: bool = False) -> DataFrame:
    """KPSS statistic for level or trend stationarity with Bartlett-weighted variance; p between 0.01 and 0.1."""
    def run(y):
        n = len(y)
        x = np.column_stack([np.ones(n), np.arange(1, n + 1)]) if trend else np.ones((n, 1))
        e = _ols(x, y)[2]
        lags = int(4 * (n / 100) ** 0.25)
        s2 = e @ e / n + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
        stat = float((np.cumsum(e) ** 2).sum() / (n * n * s2))
        # The published critical values at 10, 5, 2.5 and 1 %.
        crit = [0.119, 0.146, 0.176, 0.216] if trend else [0.347, 0.463, 0.574, 0.739]
        return pd.DataFrame({"statistic": [stat], "lags": [lags], "p_value": [float(np.interp(stat, crit, [0.1, 0.05, 0.025, 0.01]))]})

    return per_series(series, run, "statistic double, lags int, p_value double")


#: MacKinnon's published surfaces for one series. The p-value is the normal distribution at a polynomial in
#: the statistic (ascending): a lower one up to `turn`, an upper one beyond, 0 below `least`, 1 above `most`. Critical values are
#: polynomials in 1 / n (ascending).
ADF_SURFACES = {
    "nc": {
        "least": -19.04, "turn": -1.04, "most": math.inf, "lower": (0.6344, 1.2378, 0.032496), "upper": (0.4797, 0.93557, -0.06999, 0.033066),
        "1%": (-2.56574, -2.2358, -3.627, 0.0), "5%": (-1.94100, -0.2686, -3.365, 31.223), "10%": (-1.61682, 0.2656, -2.714, 25.364),
    },
    "c": {
        "least": -18.83, "turn": -1.61, "most": 2.74, "lower": (2.1659, 1.4412, 0.038269), "upper": (1.7339, 0.93202, -0.12745, -0.010368),
        "1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0),
    },
    "ct": {
        "least": -16.18, "turn": -2.89, "most": 0.70, "lower": (3.2512, 1.6047, 0.049588), "upper": (2.5261, 0.61654, -0.37956, -0.060285),
        "1%": (-3.95877, -9.0531, -28.428, -134.155), "5%": (-3.41049, -4.3904, -9.036, -45.374), "10%": (-3.12705, -2.5856, -3.925, -22.380),
    },
}


def adf_p_value(statistic: float, regression: str) -> float:
    """Asymptotic p-value of a Dickey-Fuller t statistic."""
    s = ADF_SURFACES[regression]
    if not s["least"] <= statistic <= s["most"]:
        return math.nan if math.isnan(statistic) else float(statistic > s["most"])
    return float(dist.norm_cdf(np.polynomial.polynomial.polyval(statistic, s["lower" if statistic <= s["turn"] else "upper"])))


def adf_critical(regression: str, n: int) -> list[float]:
    """Critical values at 1, 5 and 10 % of a test on `n` differences."""
    return [float(np.polynomial.polynomial.polyval(1 / n, ADF_SURFACES[regression][level])) for level in ("1%", "5%", "10%")]


def adf(series: DataFrame, lags: int | None = None, regression: str = "ct") -> DataFrame:
    """Augmented Dickey-Fuller t statistic: without constant (nc), with constant (c), or with trend (ct); p-value and critical values."""
    fixed = {"nc": 0, "c": 1, "ct": 2}[regression]

    def run(y):
        n = len(y)
        k = int((n - 1) ** (1 / 3)) if lags is None else lags
        z = np.diff(y)
        m = len(z)
        x = np.column_stack([*[np.ones(m - k), np.arange(k + 1, m + 1)][:fixed], y[k : n - 1], *(z[k - j : m - j] for j in range(1, k + 1))])
        b, se, _ = _ols(x, z[k:])
        stat = float(b[fixed] / se[fixed])
        crit = adf_critical(regression, m - k)
        return pd.DataFrame([(stat, k, adf_p_value(stat, regression), *crit)], columns=["statistic", "lags", "p_value", "crit_1", "crit_5", "crit_10"])

    return per_series(series, run, "statistic double, lags int, p_value double, crit_1 double, crit_5 double, crit_10 double")


def decompose(series: DataFrame, period: int, kind: str = "additive") -> DataFrame:
    """Classical decomposition: centred moving average, mean seasonal figure, remainder."""
    half, even = period // 2, period % 2 == 0
    w = Window.partitionBy("key").orderBy("t")
    wide = w.rowsBetween(-half, half)
    edge = F.lag("y", half).over(w) + F.lead("y", half).over(w)
    total = F.sum("y").over(wide)
    full = F.count("y").over(wide) == 2 * half + 1
    trend = F.when(full, (total - edge / 2) / period if even else total / period)
    d = series.withColumn("trend", trend)
    rest = F.col("y") - F.col("trend") if kind == "additive" else F.col("y") / F.col("trend")
    phase = d.withColumns({"phase": F.pmod(F.col("t") - 1, F.lit(period)), "rest": rest})
    figure = phase.groupBy("key", "phase").agg(F.avg("rest").alias("f"))
    mean = F.avg("f").over(Window.partitionBy("key"))
    figure = figure.withColumn("seasonal", F.col("f") - mean if kind == "additive" else F.col("f") / mean).drop("f")
    out = phase.join(figure, ["key", "phase"])
    rem = F.col("rest") - F.col("seasonal") if kind == "additive" else F.col("rest") / F.col("seasonal")
    return out.select("key", "t", "y", "trend", "seasonal", rem.alias("remainder"))


def nelder_mead(f, x0: np.ndarray, steps: int = 800, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Downhill simplex."""
    n = len(x0)
    pts = [np.array(x0, float)] + [np.array(x0, float) + np.eye(n)[i] * (0.1 if x0[i] == 0 else 0.1 * abs(x0[i]) + 0.05) for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(steps):
        at = np.argsort(val)
        pts, val = [pts[i] for i in at], [val[i] for i in at]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol):
            break
        c = np.mean(pts[:-1], axis=0)
        r = c + (c - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = c + 2 * (c - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < val[-1] else pts[-1]) - c)
            fk = f(k)
            if fk < min(fr, val[-1]):
                pts[-1], val[-1] = k, fk
            else:
                pts = [pts[0] + 0.5 * (p - pts[0]) for p in pts]
                val = [f(p) for p in pts]
    i = int(np.argmin(val))
    return pts[i], float(val[i])


def ets_recursion(y: np.ndarray, alpha: float, beta: float | None, gamma: float | None, phi: float, level: float, slope: float, season: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Additive-error exponential smoothing: errors and final states."""
    e, s = np.empty(len(y)), list(season)
    for t, v in enumerate(y):
        base = level + phi * slope
        f = base + (s[t % len(s)] if s else 0.0)
        e[t] = v - f
        level = base + alpha * e[t]
        slope = phi * slope + (beta or 0.0) * e[t]
        if s:
            s[t % len(s)] += (gamma or 0.0) * e[t]
    return e, level, slope, np.array(s)


def ets(series: DataFrame, trend: bool = False, period: int = 0, damped: bool = False, horizon: int = 5) -> DataFrame:
    """Additive exponential smoothing (level, trend, season) by likelihood; parameters, fit and forecasts."""
    def run(y):
        m = period
        season0 = np.array([np.mean(y[i::m]) - y.mean() for i in range(m)]) if m else np.zeros(0)
        start = [y[: max(4, m or 4)].mean() if not trend else y[0]] + ([(y[min(len(y) - 1, 9)] - y[0]) / min(len(y) - 1, 9)] if trend else [])

        def unpack(p):
            q = 1 / (1 + np.exp(-p[: 1 + trend + bool(m) + damped]))
            a = float(q[0])
            b = float(q[1]) * a if trend else None
            g = float(q[1 + trend]) * (1 - a) if m else None
            ph = 0.8 + 0.18 * float(q[-1]) if damped else 1.0
            s = p[1 + trend + bool(m) + damped :]
            return a, b, g, ph, s[0], s[1] if trend else 0.0

        loss = lambda p: float(len(y) * math.log((ets_recursion(y, *unpack(p), season0)[0] ** 2).sum() + 1e-300))
        best, value = nelder_mead(loss, np.array([0.0] * (1 + trend + bool(m) + damped) + start))
        a, b, g, ph, l0, b0 = unpack(best)
        e, lv, sl, se = ets_recursion(y, a, b, g, ph, l0, b0, season0)
        damp = np.cumsum(ph ** np.arange(1, horizon + 1))
        fc = lv + damp * sl + (np.array([se[(len(y) + h) % m] for h in range(horizon)]) if m else 0.0)
        return pd.DataFrame({"alpha": a, "beta": b, "gamma": g, "phi": ph, "sse": float(e @ e), "aic": value + 2 * (len(best) + 1), "h": np.arange(1, horizon + 1), "forecast": fc}).astype({"beta": float, "gamma": float})

    return per_series(series, run, "alpha double, beta double, gamma double, phi double, sse double, aic double, h int, forecast double")


def css_residuals(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals of an ARMA model of a centred series."""
    p, q = len(ar), len(ma)
    e = np.zeros(len(y))
    z = y.copy()
    for i in range(p):
        z[i + 1 :] -= ar[i] * y[: -(i + 1)]
    for t in range(p, len(y)):
        e[t] = z[t] - sum(ma[j] * e[t - 1 - j] for j in range(min(q, t)))
    return e[p:]


def _stationary(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from unconstrained values (partial autocorrelations by tanh)."""
    phi = np.zeros(0)
    for a in np.tanh(raw):
        phi = np.append(phi - a * phi[::-1], a)
    return phi


def fit_arima(y: np.ndarray, p: int, d: int, q: int) -> dict:
    """ARIMA by conditional sum of squares; a mean when d is 0."""
    w = np.diff(y, d) if d else y
    mean = w.mean() if not d else 0.0

    def loss(v):
        e = css_residuals(w - (v[-1] if not d else 0.0), _stationary(v[:p]), -_stationary(v[p : p + q]))
        return float(e @ e / len(e))

    v, s2 = nelder_mead(loss, np.array([0.1] * (p + q) + ([mean] if not d else [])))
    n, k = len(w) - p, p + q + (not d) + 1
    ll = -n / 2 * (math.log(2 * math.pi * s2) + 1)
    return {"ar": _stationary(v[:p]), "ma": -_stationary(v[p : p + q]), "mean": float(v[-1]) if not d else 0.0, "sigma2": s2, "log_lik": ll, "aic": -2 * ll + 2 * k, "w": w}


def forecast_arima(y: np.ndarray, fit: dict, d: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors of the next values."""
    ar, ma, mean = fit["ar"], fit["ma"], fit["mean"]
    w = list(fit["w"] - mean)
    e = [0.0] * len(ar) + list(css_residuals(np.array(w), ar, ma))
    for _ in range(horizon):
        w.append(sum(a * w[-1 - i] for i, a in enumerate(ar)) + sum(m * e[-1 - j] for j, m in enumerate(ma)))
        e.append(0.0)
    out = np.array(w[-horizon:]) + mean
    for k in range(d, 0, -1):
        out = np.cumsum(np.concatenate([[np.diff(y, k - 1)[-1]], out]))[1:]
    full = np.array([1.0])
    for _ in range(d):
        full = np.convolve(full, [1.0, -1.0])
    full = np.convolve(full, np.concatenate([[1.0], -ar]))
    psi = [1.0]
    for j in range(1, horizon):
        psi.append((ma[j - 1] if j <= len(ma) else 0.0) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1)))
    return out, np.sqrt(fit["sigma2"] * np.cumsum(np.square(psi)))


def arima(series: DataFrame, order: tuple[int, int, int] = (1, 0, 0), horizon: int = 5) -> DataFrame:
    """ARIMA of every series: coefficients, variance, information criterion, forecasts with errors."""
    p, d, q = order

    def run(y):
        fit = fit_arima(y, p, d, q)
        mean, se = forecast_arima(y, fit, d, horizon)
        return pd.DataFrame({"ar": [fit["ar"].tolist()] * horizon, "ma": [fit["ma"].tolist()] * horizon, "mean": fit["mean"], "sigma2": fit["sigma2"], "aic": fit["aic"], "h": np.arange(1, horizon + 1), "forecast": mean, "std_error": se})

    return per_series(series, run, "ar array<double>, ma array<double>, mean double, sigma2 double, aic double, h int, forecast double, std_error double")


def auto_arima(series: DataFrame, max_p: int = 3, max_q: int = 3, d: int = 0) -> DataFrame:
    """The orders with the least information criterion, a series a row."""
    def run(y):
        best = min(((fit_arima(y, p, d, q)["aic"], p, q) for p in range(max_p + 1) for q in range(max_q + 1) if p + q), default=(math.nan, 0, 0))
        return pd.DataFrame({"p": [best[1]], "d": [d], "q": [best[2]], "aic": [best[0]]})

    return per_series(series, run, "p int, d int, q int, aic double")


def ndiffs(series: DataFrame, max_d: int = 2) -> DataFrame:
    """Differences needed until the level test no longer rejects at 5 %."""
    out = None
    for d in range(max_d + 1):
        t = kpss(diff(series, 1, d) if d else series).select("key", F.lit(d).alias("d"), (F.col("statistic") < 0.463).alias("ok"))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("d"))), F.lit(max_d)).alias("ndiffs"))


def _loess(x: np.ndarray, y: np.ndarray, span: int, at: np.ndarray, degree: int = 1, weight: np.ndarray | None = None) -> np.ndarray:
    """Local regression at given places, tricube weights over the `span` nearest points."""
    n, out = len(x), np.empty(len(at))
    q = min(span, n)
    for i, p in enumerate(at):
        lo = min(max(0, int(np.searchsorted(x, p)) - q // 2 - 1), n - q)
        while lo + q < n and abs(x[lo + q] - p) < abs(p - x[lo]):
            lo += 1
        while lo > 0 and abs(x[lo - 1] - p) < abs(x[lo + q - 1] - p):
            lo -= 1
        d = np.abs(x[lo : lo + q] - p)
        h = max(d.max() * (1 if span <= n else span / n), 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        if weight is not None:
            w = w * weight[lo : lo + q]
        xs, ys, total = x[lo : lo + q] - p, y[lo : lo + q], w.sum()
        if total <= 0:
            out[i] = ys.mean()
            continue
        mx, my = (w @ xs) / total, (w @ ys) / total
        sxx = w @ (xs - mx) ** 2
        slope = (w @ ((xs - mx) * (ys - my))) / sxx if degree and sxx > 1e-12 * total else 0.0
        out[i] = my - slope * mx
    return out


def stl_fit(y: np.ndarray, period: int, s_window: int = 7, robust: bool = False, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and remainder by local regression."""
    n = len(y)
    odd = lambda v: int(v) + (int(v) % 2 == 0)
    t_window, l_window = odd(math.ceil(1.5 * period / (1 - 1.5 / s_window))), odd(period)
    x, trend, weight = np.arange(n, dtype=float), np.zeros(n), np.ones(n)
    for _ in range(6 if robust else 1):
        for _ in range(inner):
            detr, c = y - trend, np.empty(n + 2 * period)
            for ph in range(period):
                at = np.arange(ph, n, period)
                k = np.arange(len(at), dtype=float)
                c[ph::period][: len(at) + 2] = _loess(k, detr[at], s_window, np.arange(-1, len(at) + 1, dtype=float), 1, weight[at])
            ma = lambda v, m: np.convolve(v, np.ones(m) / m, "valid")
            low = _loess(x, ma(ma(ma(c, period), period), 3), l_window, x)
            seasonal = c[period : period + n] - low
            trend = _loess(x, y - seasonal, t_window, x, 1, weight)
        if robust:
            r = np.abs(y - trend - seasonal)
            h = 6 * np.median(r)
            weight = np.clip(1 - (r / h) ** 2, 0, 1) ** 2 if h else np.ones(n)
    return seasonal, trend, y - seasonal - trend


def stl(series: DataFrame, period: int, s_window: int = 7, robust: bool = False) -> DataFrame:
    """Seasonal-trend decomposition of every series."""
    def run(y):
        s, t, r = stl_fit(y, period, s_window, robust)
        return pd.DataFrame({"t": np.arange(1, len(y) + 1), "seasonal": s, "trend": t, "remainder": r})

    return per_series(series, run, "t int, seasonal double, trend double, remainder double")


def kalman_log_lik(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, float]:
    """Exact Gaussian likelihood of a zero-mean ARMA series: (concentrated log-likelihood, variance)."""
    r = max(len(ar), len(ma) + 1)
    phi = np.concatenate([ar, np.zeros(r - len(ar))])
    big = np.zeros((r, r))
    big[:, 0] = phi
    big[:-1, 1:] = np.eye(r - 1)
    g = np.concatenate([[1.0], ma, np.zeros(r - 1 - len(ma))])
    q = np.outer(g, g)
    p = np.linalg.solve(np.eye(r * r) - np.kron(big, big), q.ravel()).reshape(r, r)
    a, ssq, logs = np.zeros(r), 0.0, 0.0
    for v in w:
        f = p[0, 0]
        e = v - a[0]
        ssq, logs = ssq + e * e / f, logs + math.log(f)
        gain = p[:, 0] / f
        a = big @ (a + gain * e)
        p = big @ (p - np.outer(gain, p[0])) @ big.T + q
    n = len(w)
    s2 = ssq / n
    return -0.5 * (n * math.log(2 * math.pi * s2) + n + logs), s2


def whittle(series: DataFrame, p: int, q: int) -> DataFrame:
    """ARMA by frequency-domain likelihood on the periodogram: a row a series."""
    def run(y):
        z = y - y.mean()
        n = len(z)
        k = np.arange(1, (n - 1) // 2 + 1)
        i = np.abs(np.fft.fft(z)[k]) ** 2 / n
        e = np.exp(-2j * np.pi * k / n)

        def shape(v):
            ar, ma = _stationary(v[:p]), -_stationary(v[p:])
            num = np.abs(1 + sum(m * e ** (j + 1) for j, m in enumerate(ma))) ** 2
            den = np.abs(1 - sum(a * e ** (j + 1) for j, a in enumerate(ar))) ** 2
            return np.broadcast_to(num / den, i.shape), ar, ma

        def loss(v):
            g = shape(v)[0]
            return float(len(i) * math.log((i / g).mean()) + np.log(g).sum())

        best, _ = nelder_mead(loss, np.full(p + q, 0.1))
        g, ar, ma = shape(best)
        return pd.DataFrame({"ar": [ar.tolist()], "ma": [ma.tolist()], "sigma2": [float((i / g).mean())], "mean": [float(y.mean())]})

    return per_series(series, run, "ar array<double>, ma array<double>, sigma2 double, mean double")


def arima_ml(series: DataFrame, order: tuple[int, int, int] = (1, 0, 0)) -> DataFrame:
    """ARIMA by exact likelihood, started from the conditional fit."""
    p, d, q = order

    def run(y):
        w = np.diff(y, d) if d else y
        start = fit_arima(y, p, d, q)
        to_raw = lambda c: np.arctanh(np.clip(levinson_inverse(c), -0.99, 0.99))
        x0 = np.concatenate([to_raw(start["ar"]), to_raw(-start["ma"]), [start["mean"]] if not d else []])
        loss = lambda v: -kalman_log_lik(w - (v[-1] if not d else 0.0), _stationary(v[:p]), -_stationary(v[p : p + q]))[0]
        v, value = nelder_mead(loss, x0, 400)
        s2 = kalman_log_lik(w - (v[-1] if not d else 0.0), _stationary(v[:p]), -_stationary(v[p : p + q]))[1]
        return pd.DataFrame({"ar": [_stationary(v[:p]).tolist()], "ma": [(-_stationary(v[p : p + q])).tolist()], "mean": [float(v[-1]) if not d else 0.0], "sigma2": [s2], "log_lik": [-value], "aic": [2 * value + 2 * (len(v) + 1)]})

    return per_series(series, run, "ar array<double>, ma array<double>, mean double, sigma2 double, log_lik double, aic double")


def levinson_inverse(phi: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of autoregressive coefficients."""
    out, a = [], np.array(phi, float)
    while len(a):
        k = a[-1]
        out.append(k)
        a = (a[:-1] + k * a[:-1][::-1]) / (1 - k * k) if len(a) > 1 and abs(k) < 1 else a[:-1]
    return np.array(out[::-1])
