"""Missing data: patterns, multivariate normal estimation, Little's test, multiple imputation and pooling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import dist
from lattica.operators.descriptive import number
from lattica.plans.blocks import block_sum
from lattica.plans.finish import frame


def patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(pattern, n): each combination of observed (1) and missing (0) columns with its rows."""
    bits = F.concat(*(F.when(number(c).isNotNull(), "1").otherwise("0") for c in cols))
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"))


def pattern_moments(df: DataFrame, cols: list[str]) -> list[tuple[np.ndarray, float, np.ndarray, np.ndarray]]:
    """For every pattern its observed columns, rows, sums and cross-products: all that estimation reads."""
    k = len(cols)
    vals = [number(c) for c in cols]
    bits = F.concat(*(F.when(v.isNotNull(), "1").otherwise("0") for v in vals))
    z = [F.coalesce(v, F.lit(0.0)).alias(f"z{i}") for i, v in enumerate(vals)]
    d = df.select(bits.alias("pattern"), *z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = d.groupBy("pattern").agg(F.count("*"), *(F.sum(f"z{i}") for i in range(k)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs)).collect()
    out = []
    for r in sorted(rows):
        m = np.zeros((k, k))
        for v, (i, j) in zip(r[2 + k :], pairs):
            m[i, j] = m[j, i] = v
        o = np.flatnonzero([b == "1" for b in r[0]])
        if len(o):
            out.append((o, float(r[1]), np.array(r[2 : 2 + k], float), m))
    return out


def _log_lik(stats, mu: np.ndarray, sigma: np.ndarray) -> float:
    ll = 0.0
    for o, n, s, m in stats:
        so = sigma[np.ix_(o, o)]
        dev = m[np.ix_(o, o)] - np.outer(s[o], mu[o]) - np.outer(mu[o], s[o]) + n * np.outer(mu[o], mu[o])
        ll -= 0.5 * (n * (len(o) * math.log(2 * math.pi) + np.linalg.slogdet(so)[1]) + np.trace(np.linalg.solve(so, dev)))
    return ll


def mvn_em(stats, k: int, max_iter: int = 5000, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Maximum likelihood mean and covariance by EM over pattern moments; no pass over rows."""
    n = sum(s[1] for s in stats)
    seen = np.array([sum(s[1] for s in stats if j in s[0]) for j in range(k)])
    mu = sum(s[2] for s in stats) / seen
    sigma = np.diag(np.maximum(sum(np.diag(s[3]) for s in stats) / seen - mu**2, 1e-8))
    for it in range(1, max_iter + 1):
        last = np.concatenate([mu, sigma.ravel()])
        t1, t2 = np.zeros(k), np.zeros((k, k))
        for o, c, s, m in stats:
            u = np.setdiff1d(np.arange(k), o)
            b = np.zeros((k, len(o)))
            b[o] = np.eye(len(o))
            b[u] = np.linalg.solve(sigma[np.ix_(o, o)], sigma[np.ix_(o, u)]).T
            a = mu - b @ mu[o]
            t1 += c * a + b @ s[o]
            t2 += c * np.outer(a, a) + np.outer(a, b @ s[o]) + np.outer(b @ s[o], a) + b @ m[np.ix_(o, o)] @ b.T
            t2[np.ix_(u, u)] += c * (sigma[np.ix_(u, u)] - b[u] @ sigma[np.ix_(o, u)])
        mu = t1 / n
        sigma = t2 / n - np.outer(mu, mu)
        now = np.concatenate([mu, sigma.ravel()])
        if np.abs(now - last).max() < tol * (1 + np.abs(now).max()):
            break
    return mu, sigma, _log_lik(stats, mu, sigma), it


def mvn_mle(df: DataFrame, cols: list[str]) -> DataFrame:
    """Estimated means and covariances with the log-likelihood: one row a pair of variables."""
    mu, s, ll, it = mvn_em(pattern_moments(df, cols), len(cols))
    rows = [(a, b, float(mu[i]), float(s[i, j]), float(ll), it) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    return frame(df.sparkSession, rows, "a string, b string, mean_a double, cov double, log_lik double, iterations int")


def little_mcar(df: DataFrame, cols: list[str]) -> DataFrame:
    """Little's test that values are missing completely at random."""
    stats, k = pattern_moments(df, cols), len(cols)
    mu, sigma, _, _ = mvn_em(stats, k)
    n = sum(s[1] for s in stats)
    sigma = sigma * n / (n - 1)
    stat = sum(c * (s[o] / c - mu[o]) @ np.linalg.solve(sigma[np.ix_(o, o)], s[o] / c - mu[o]) for o, c, s, _ in stats)
    d = float(sum(len(s[0]) for s in stats) - k)
    return frame(df.sparkSession, [(float(stat), d, dist.chi2_sf(float(stat), d) if d else math.nan, len(stats))], "statistic double, df double, p_value double, n_patterns int")


def mice(df: DataFrame, cols: list[str], m: int = 5, max_iter: int = 5, seed: int = 1, key: str | None = None) -> DataFrame:
    """Multiple imputation by chained normal regressions: (imputation, the table's columns).

    All chains run at once as copies of the rows with missing values; a variable's step is one pass for
    the Gram matrices of all chains over those, to which that of the complete rows, summed once, is added; then a
    draw of coefficients and variance on the driver, and a column expression. Noise is a hash of row, chain, step
    and variable, so that lost tasks redraw the same.
    """
    spark = df.sparkSession
    rng = np.random.default_rng(seed)
    seen = df.agg(*(F.sum(number(c).isNull().cast("long")) for c in cols), *(F.avg(number(c)) for c in cols)).first()
    miss = [c for i, c in enumerate(cols) if seen[i]]
    means = {c: seen[len(cols) + i] for i, c in enumerate(cols)}
    row = F.col(key).cast("string") if key else F.monotonically_increasing_id().cast("string")
    base = df.withColumns({"_row": row, **{c: number(c) for c in cols}, **{f"_m_{c}": number(c).isNull() for c in miss}})
    from lattica.plans.stages import settle

    chains = F.explode(F.sequence(F.lit(1), F.lit(m)))
    holes = F.lit(False)
    for c in miss:
        holes = holes | F.col(f"_m_{c}")
    whole = base.where(~holes)
    data = base.where(holes).withColumns({c: F.coalesce(c, F.lit(means[c])) for c in miss})
    # A small file is one task's; the copies are dealt to all.
    tasks = 2 * spark.sparkContext.defaultParallelism
    data = settle(data.repartition(tasks, "_row").withColumn("imputation", chains))
    parts = block_sum(whole, [F.lit(1.0), *cols], lambda z: z.T @ z)
    fixed = parts.reshape(len(cols) + 1, -1) if len(parts) else np.zeros((len(cols) + 1, len(cols) + 1))

    def uniform(*salt) -> F.Column:
        return (F.shiftrightunsigned(F.xxhash64("_row", "imputation", *(F.lit(s) for s in salt)), 11).cast("double") + 0.5) / float(1 << 53)

    for it in range(max_iter):
        for c in miss:
            others = [o for o in cols if o != c]
            k = len(others) + 2
            x = [F.lit(1.0), *others, c]
            at = [0, *(1 + cols.index(o) for o in others), 1 + cols.index(c)]

            def fold(mat, k=k):
                out = np.zeros((m, k, k))
                for i in range(m):
                    z = mat[mat[:, 0] == i + 1][:, 1:]
                    out[i] = z.T @ z
                return out

            g = block_sum(data.where(f"not `_m_{c}`"), ["imputation", *x], fold)
            g = (g.reshape(m, k, k) if len(g) else np.zeros((m, k, k))) + fixed[np.ix_(at, at)]
            pred = None
            for i in range(m):
                a = g[i][:-1, :-1] + 1e-5 * np.diag(np.diag(g[i][:-1, :-1]))
                inv = np.linalg.inv(a)
                b = inv @ g[i][:-1, -1]
                n = g[i][0, 0]
                rss = max(g[i][-1, -1] - b @ g[i][:-1, -1], 1e-12)
                s = math.sqrt(rss / rng.chisquare(max(1, n - len(b))))
                b = b + s * np.linalg.cholesky((inv + inv.T) / 2) @ rng.standard_normal(len(b))
                line = F.lit(float(b[0])) + sum((F.col(o) * float(w) for o, w in zip(others, b[1:])), F.lit(0.0))
                noise = F.sqrt(-2 * F.log(uniform(seed, it, c, "a"))) * F.cos(2 * math.pi * uniform(seed, it, c, "b")) * s
                pred = F.when(F.col("imputation") == i + 1, line + noise) if pred is None else pred.when(F.col("imputation") == i + 1, line + noise)
            data = data.withColumn(c, F.when(F.col(f"_m_{c}"), pred).otherwise(F.col(c)))
        data = settle(data)
    return data.unionByName(whole.withColumn("imputation", chains)).drop("_row", *(f"_m_{c}" for c in miss))


def pool(estimates: DataFrame, by: list[str], estimate: str = "estimate", std_error: str = "std_error", df_complete: float = math.inf) -> DataFrame:
    """Rubin's rules: pooled estimate, error, degrees of freedom, interval and missing-information share a term."""
    from lattica.plans.finish import finish

    s = estimates.groupBy(*by).agg(F.count("*").alias("m"), F.avg(estimate).alias("q"), F.avg(F.col(std_error) ** 2).alias("u"), F.coalesce(F.var_samp(estimate), F.lit(0.0)).alias("b"))

    def row(r: dict) -> dict:
        m, b, u = r["m"], r["b"], r["u"]
        t = u + (1 + 1 / m) * b
        lam = (1 + 1 / m) * b / t if t else 0.0
        old = (m - 1) / lam**2 if lam else math.inf
        if math.isfinite(df_complete):
            obs = (df_complete + 1) / (df_complete + 3) * df_complete * (1 - lam)
            d = old * obs / (old + obs) if math.isfinite(old) else obs
        else:
            d = old
        se = math.sqrt(t)
        q = dist.t_ppf(0.975, d) if math.isfinite(d) else dist.norm_ppf(0.975)
        stat = r["q"] / se if se else math.nan
        p = 2 * dist.t_sf(abs(stat), d) if se else math.nan
        riv = (1 + 1 / m) * b / u if u else math.nan
        return dict(estimate=r["q"], std_error=se, statistic=stat, df=d, p_value=p, conf_low=r["q"] - q * se, conf_high=r["q"] + q * se, fmi=(riv + 2 / (d + 3)) / (riv + 1) if math.isfinite(d) else 0.0)

    return finish(s, by, row, "estimate double, std_error double, statistic double, df double, p_value double, conf_low double, conf_high double, fmi double")


def punch_holes(df: DataFrame, cols: list[str], prop: float, seed: int = 1) -> DataFrame:
    """Values of `cols` set missing completely at random."""
    return df.withColumns({c: F.when(F.rand(seed + i) >= prop, F.col(c)) for i, c in enumerate(cols)})


def is_monotone(df: DataFrame, cols: list[str]) -> bool:
    """Whether the columns, ordered by missing values, are each observed only where the one before is."""
    pats = [r.pattern for r in patterns(df, cols).collect()]
    order = sorted(range(len(cols)), key=lambda i: sum(p[i] == "0" for p in pats))
    return all("01" not in "".join(p[i] for i in order) for p in pats)


def _kth_nearest(pred: np.ndarray, donors: np.ndarray, rng: np.random.Generator, k: int) -> np.ndarray:
    """For each prediction one of the k donors (sorted) nearest to it, at random."""
    at = np.searchsorted(donors, pred)
    lo = np.clip(at - k, 0, max(0, len(donors) - 2 * k))
    near = lo[:, None] + np.arange(min(2 * k, len(donors)))
    gap = np.abs(donors[near] - pred[:, None])
    best = np.argsort(gap, axis=1, kind="stable")[:, :k]
    return near[np.arange(len(pred)), best[np.arange(len(pred)), rng.integers(0, best.shape[1], len(pred))]]


def mice_chains(df: DataFrame, cols: list[str], methods: dict[str, str] | None = None, m: int = 5, max_iter: int = 5, seed: int = 1, donors: int = 5, key: str | None = None, max_rows: int = 2_000_000) -> DataFrame:
    """Multiple imputation with predictive mean matching, norm, logreg and polyreg, a chain a task.

    For tables that fit a task (`max_rows`); `mice` has no such bound. Chain i draws from its own stream,
    so results don't depend on tasks. Categorical columns hold integer codes. Returns (imputation, row, cols).
    """
    spark, methods = df.sparkSession, methods or {}
    if (n := df.count()) > max_rows:
        raise ValueError(f"{n} rows: chains hold the table in a task, up to {max_rows}")
    pdf = df.select(*([F.col(key).alias("row")] if key else []), *(number(c).alias(c) for c in cols)).toPandas()
    if key:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        ids = pdf["row"].to_numpy()
    else:
        ids = np.arange(len(pdf))
    data = pdf[cols].to_numpy(float)
    shared = spark.sparkContext.broadcast((data, ids))

    def draw_linear(x, t, rng):
        a = x.T @ x
        inv = np.linalg.inv(a + 1e-5 * np.mean(np.diag(a)) * np.eye(len(a)))
        b = inv @ x.T @ t
        r = t - x @ b
        s = math.sqrt(r @ r / rng.chisquare(max(1, len(t) - len(b))))
        return b, b + s * np.linalg.cholesky((inv + inv.T) / 2) @ rng.standard_normal(len(b)), s

    def draw_softmax(x, t, rng, k):
        b = np.zeros((k - 1) * x.shape[1])
        for _ in range(25):
            e = np.column_stack([np.zeros(len(x)), x @ b.reshape(k - 1, -1).T])
            pr = np.exp(e - e.max(1, keepdims=True))
            pr /= pr.sum(1, keepdims=True)
            g = ((np.eye(k)[t] - pr)[:, 1:].T @ x).ravel() - 0.01 * b
            h = 0.01 * np.eye(len(b))
            q = x.shape[1]
            for i in range(k - 1):
                for j in range(k - 1):
                    w = pr[:, i + 1] * ((i == j) - pr[:, j + 1])
                    h[i * q : (i + 1) * q, j * q : (j + 1) * q] += x.T @ (x * w[:, None])
            step = np.linalg.solve(h, g)
            b = b + step
            if np.abs(step).max() < 1e-6:
                break
        return (b + np.linalg.cholesky(np.linalg.inv(h)) @ rng.standard_normal(len(b))).reshape(k - 1, -1)

    def chain(i: int) -> pd.DataFrame:
        data, ids = shared.value
        rng, z, hole = np.random.default_rng([seed, i]), data.copy(), np.isnan(data)
        for j in range(len(cols)):
            z[hole[:, j], j] = rng.choice(data[~hole[:, j], j], hole[:, j].sum())
        for _ in range(max_iter):
            for j, c in enumerate(cols):
                h = hole[:, j]
                if not h.any():
                    continue
                x = np.column_stack([np.ones(len(z)), *(z[:, o] for o in range(len(cols)) if o != j)])
                mid, sd = x.mean(0), x.std(0)
                mid[0], sd[sd == 0] = 0, 1
                x, t, how = (x - mid) / sd, z[~h, j], methods.get(c, "pmm")
                if how in ("logreg", "polyreg"):
                    codes, t = np.unique(t, return_inverse=True)
                    b = draw_softmax(x[~h], t, rng, len(codes))
                    e = np.column_stack([np.zeros(h.sum()), x[h] @ b.T])
                    pr = np.exp(e - e.max(1, keepdims=True))
                    cum = np.cumsum(pr / pr.sum(1, keepdims=True), axis=1)
                    z[h, j] = codes[np.minimum((rng.random(h.sum())[:, None] > cum).sum(1), len(codes) - 1)]
                    continue
                b, drawn, s = draw_linear(x[~h], t, rng)
                if how == "norm":
                    z[h, j] = x[h] @ drawn + s * rng.standard_normal(h.sum())
                else:
                    seen = x[~h] @ b
                    order = np.argsort(seen, kind="stable")
                    z[h, j] = t[order][_kth_nearest(x[h] @ drawn, seen[order], rng, donors)]
        return pd.DataFrame(z, columns=cols).assign(imputation=i + 1, row=ids)[["imputation", "row", *cols]]

    def run(batches):
        for b in batches:
            for i in b["id"]:
                yield chain(int(i))

    kind = df.schema[key].dataType.simpleString() if key else "long"
    return spark.range(0, m, 1, m).mapInPandas(run, f"imputation int, row {kind}, " + ", ".join(f"{c} double" for c in cols))
