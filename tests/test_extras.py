"""Post-hoc tests against a control, sphericity, unit-root p-values, predictions, scores, likelihoods and residuals of fitted models."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lattica.functions import dist
from lattica.operators import anova, categorical, multivariate, regression
from lattica.operators import timeseries as ts


def test_dunnett_against_published_points():
    for k, df, point in [(1, 10, 2.23), (2, 10, 2.57), (3, 10, 2.76), (2, 20, 2.38), (3, 20, 2.54), (4, 20, 2.65), (3, 1e6, 2.35)]:
        assert abs(dist.dunnett_ppf(0.95, (0.5,) * k, float(df)) - point) < 0.006
    rng = np.random.default_rng(0)
    share = (0.3, 0.5, 0.7)
    t = (np.sqrt(share) * rng.normal(size=(400_000, 1)) + np.sqrt(1 - np.array(share)) * rng.normal(size=(400_000, 3))) / np.sqrt(rng.chisquare(7, (400_000, 1)) / 7)
    assert abs((np.abs(t).max(1) <= 2.1).mean() - dist.dunnett_cdf(2.1, share, 7.0)) < 0.003


def test_posthoc_against_control(spark):
    rng = np.random.default_rng(1)
    data = {g: rng.normal(m, 1, n) for g, m, n in (("a", 0, 12), ("b", 0.5, 9), ("c", 1.5, 15))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, y double")
    got = {r.group2: r for r in anova.anova_posthoc(df, "y", "g", "dunnett", control="a").collect()}
    assert set(got) == {"b", "c"} and got["b"].p_value > 2 * dist.t_sf(abs(got["b"].statistic), 33) - 1e-12
    a, c = data["a"], data["c"]
    pooled = math.sqrt((11 * a.var(ddof=1) + 14 * c.var(ddof=1)) / 25)
    assert abs(got["c"].cohens_d - (c.mean() - a.mean()) / pooled) < 1e-12
    p = got["c"].p_value
    edge = dist.dunnett_ppf(1 - p, (9 / 21, 15 / 27), 33.0)
    assert abs(edge - abs(got["c"].statistic)) < 1e-4
    for bad in (("scheffe", None), ("dunnett", "z")):
        with pytest.raises(ValueError):
            anova.anova_posthoc(df, "y", "g", bad[0], control=bad[1])


def test_sphericity(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=(30, 4)) @ np.diag([1, 1, 2, 3]) + rng.normal(size=(30, 1))
    df = spark.createDataFrame([(i, f"t{j}", float(y[i, j])) for i in range(30) for j in range(4)], "s int, w string, y double")
    helmert = np.array([[1, 1, 1], [-1, 1, 1], [0, -2, 1], [0, 0, -3]]) / np.sqrt([2, 6, 12])
    s = np.cov(y @ helmert, rowvar=False)
    got = anova.mauchly_test(df, "y", "s", "w").first()
    assert abs(got.w - np.linalg.det(s) / (np.trace(s) / 3) ** 3) < 1e-9 and got.df == 5 and 0 < got.p_value < 0.01
    assert anova.mauchly_test(df.where("w < 't2'"), "y", "s", "w").first().w == pytest.approx(1.0)


def test_unit_root_surfaces(spark):
    for kind in ("nc", "c", "ct"):
        one, five, ten = ts.adf_critical(kind, 10**9)
        assert abs(ts.adf_p_value(one, kind) - 0.01) < 0.001 and abs(ts.adf_p_value(five, kind) - 0.05) < 0.001 and abs(ts.adf_p_value(ten, kind) - 0.1) < 0.002
        assert ts.adf_p_value(-30.0, kind) == 0 and ts.adf_critical(kind, 25)[0] < one
    assert ts.adf_p_value(3.0, "c") == 1 and math.isnan(ts.adf_p_value(math.nan, "c"))
    walk = np.cumsum(np.random.default_rng(3).normal(size=200))
    s = ts.positions(spark.createDataFrame([(i, float(v)) for i, v in enumerate(walk)], "i int, v double"), "i", "v")
    r = ts.adf(s, regression="c").first()
    assert r.p_value == ts.adf_p_value(r.statistic, "c") > 0.05 and r.crit_1 < r.crit_5 < r.crit_10


@pytest.mark.parametrize("link", ["logit", "probit"])
def test_ordinal_prediction(spark, link):
    fit = regression.Fit(["x", "0|1", "1|2"], np.array([0.7, -0.5, 1.0]), np.ones(3), np.eye(3), 9, 6.0, 1.0)
    cdf = dist.norm_cdf if link == "probit" else lambda v: 1 / (1 + math.exp(-v))
    df = spark.createDataFrame([(-1.0,), (0.5,), (3.0,), (None,)], "x double")
    rows = categorical.predict_ordinal(df, ["x"], fit, link, ["x"]).collect()
    for r in rows[:3]:
        want = np.diff([0, cdf(-0.5 - 0.7 * r.x), cdf(1.0 - 0.7 * r.x), 1])
        assert np.allclose([r.p_0, r.p_1, r.p_2], want) and r.predicted == want.argmax()
    assert rows[3].p_1 is None


def test_factor_scores(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 1)) * [0.9, 0.8, 0.7, 0.6] + rng.normal(size=(300, 4)) * 0.5
    names = list("abcd")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    fa = multivariate.factor_analysis(df, names, 1)
    load = {r.variable: r for r in fa.collect()}
    lam, psi = np.array([[load[n].loading] for n in names]), np.array([load[n].uniqueness for n in names])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = {"regression": z @ np.linalg.solve(np.corrcoef(x.T), lam), "bartlett": z @ (lam / psi[:, None]) / (lam.T @ (lam / psi[:, None]))}
    for method, w in want.items():
        got = np.array([r[0] for r in multivariate.factor_scores(df, names, fa, method).collect()])
        assert np.allclose(np.sort(got), np.sort(w[:, 0]), atol=1e-8)


def test_likelihoods_and_residuals(spark):
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=200), rng.uniform(1, 5, 200)
    y = rng.poisson(e * np.exp(0.3 + 0.4 * x))
    df = spark.createDataFrame([(float(a), float(b), math.log(c)) for a, b, c in zip(x, y, e)], "x double, y double, o double")
    fit = regression.glm(df, "y", ["x"], "poisson", offset="o")
    mu = e * np.exp(fit.coef[0] + fit.coef[1] * x)
    ll = sum(b * math.log(m) - m - math.lgamma(b + 1) for b, m in zip(y, mu))
    assert abs(fit.info["log_lik"] - ll) < 1e-8 * abs(ll) and abs(fit.info["aic"] - (4 - 2 * ll)) < 1e-6 and abs(fit.info["bic"] - (2 * math.log(200) - 2 * ll)) < 1e-6
    base = e * y.sum() / e.sum()
    null = 2 * sum((b * math.log(b / m) if b else 0.0) - (b - m) for b, m in zip(y, base))
    assert abs(fit.info["null_deviance"] - null) < 1e-6 * null
    r = regression.glm_residuals(df, "y", ["x"], fit, offset="o", keep=["x"]).toPandas()
    assert abs((r["deviance"] ** 2).sum() - fit.info["deviance"]) < 1e-8 * fit.info["deviance"] and abs((r["pearson"] ** 2).sum() - fit.info["pearson"]) < 1e-8 * fit.info["pearson"]
    assert np.allclose(r["working"], r["response"] / r["fitted"]) and np.allclose(r["fitted"], np.exp(r["linear_predictor"]))
    twice = df.withColumn("x2", df.x * 2)
    assert regression.glm(twice, "y", ["x", "x2"], "poisson", offset="o").df_residual == 198
    b = (rng.random(200) < 1 / (1 + np.exp(-x))).astype(float)
    df = spark.createDataFrame([(float(p), float(q), float(v)) for p, q, v in zip(x, b, e)], "x double, b double, v double")
    fit = regression.glm(df, "b", ["x"])
    assert abs(fit.info["log_lik"] + fit.info["deviance"] / 2) < 1e-8
    fit, ols = regression.glm(df, "v", ["x"], "gaussian"), np.polyfit(x, e, 1)
    rss = ((e - np.polyval(ols, x)) ** 2).sum()
    assert abs(fit.info["log_lik"] + 100 * (math.log(2 * math.pi * rss / 200) + 1)) < 1e-7


def test_gamma_likelihood_matches_published_aic(spark):
    # Clotting times by plasma concentration, a published example of a gamma regression with AIC 37.99.
    u, lot = [5, 10, 15, 20, 30, 40, 60, 80, 100], [118, 58, 42, 35, 27, 25, 21, 19, 18]
    df = spark.createDataFrame([(math.log(a), float(b)) for a, b in zip(u, lot)], "lu double, y double")
    assert abs(regression.glm(df, "y", ["lu"], "gamma").info["aic"] - 37.99) < 0.005


def test_permutations_in_blocks(spark, monkeypatch):
    from lattica.operators import montecarlo

    monkeypatch.setattr(montecarlo, "ROWS_PER_BLOCK", 10)
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 9, 40) + 1.0, rng.integers(0, 9, 25) + 2.0
    df = spark.createDataFrame([("x", float(v)) for v in a] + [("y", float(v)) for v in b], "g string, v double")
    d = df.select(df.v)
    sums = montecarlo._relabelled_sums(d, 65, 40, 4000, 3).toPandas()["s"].to_numpy()
    pool = np.concatenate([a, b])
    mean, sd = 40 * pool.mean(), math.sqrt(40 * 25 / 65 * pool.var(ddof=1))
    assert len(sums) == 4000 and abs(sums.mean() - mean) < 4 * sd / 4000**0.5 and abs(sums.std() / sd - 1) < 0.05
    got = montecarlo.permutation_test(df, "v", "g", ("x", "y"), 1999).first()
    plain = montecarlo.permutation_test(df, "v", "g", ("x", "y"), 1999, statistic=lambda p, q: p.mean() - q.mean()).first()
    assert abs(got.statistic - (a.mean() - b.mean())) < 1e-12 and abs(got.p_value - plain.p_value) < 0.04
    assert got == montecarlo.permutation_test(df.repartition(5), "v", "g", ("x", "y"), 1999).first()
    for bad in ({"groups": ("x", "z")}, {"groups": ("x", "y"), "alternative": "both"}):
        with pytest.raises(ValueError):
            montecarlo.permutation_test(df, "v", "g", **bad)
