"""Operators against published results of classical data sets, and against plain numpy."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest

from lattica.functions import dist
from lattica.functions.design import C
from lattica.operators import anova, categorical, descriptive, hypothesis, missing, mixed, montecarlo, multivariate, regression, survival
from lattica.operators import timeseries as ts

CTL = [4.17, 5.58, 5.18, 6.11, 4.50, 4.61, 5.17, 4.53, 5.33, 5.14]
TRT1 = [4.81, 4.17, 4.41, 3.59, 5.87, 3.83, 6.03, 4.89, 4.32, 4.69]
TRT2 = [6.31, 5.12, 5.54, 5.50, 5.37, 5.29, 4.92, 6.15, 5.80, 5.26]


def close(a, b, tol=1e-4):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol * 1e-2)


@pytest.fixture(scope="module")
def plants(spark):
    rows = [(g, w) for g, ws in (("ctl", CTL), ("trt1", TRT1), ("trt2", TRT2)) for w in ws]
    return spark.createDataFrame(rows, "grp string, weight double").repartition(3)


@pytest.fixture(scope="module")
def lives(spark):
    a = [(9, 1), (13, 1), (13, 0), (18, 1), (23, 1), (28, 0), (31, 1), (34, 1), (45, 0), (48, 1), (161, 0)]
    b = [(5, 1), (5, 1), (8, 1), (8, 1), (12, 1), (16, 0), (23, 1), (27, 1), (30, 1), (33, 1), (43, 1), (45, 1)]
    return spark.createDataFrame([(t, e, "Maintained") for t, e in a] + [(t, e, "Nonmaintained") for t, e in b], "time int, status int, x string")


def test_distributions():
    assert close(dist.t_ppf(0.975, 10), 2.228138851964939, 1e-10) and close(dist.norm_ppf(0.975), 1.959963984540054, 1e-12)
    assert close(dist.chi2_sf(3.841458820694124, 1), 0.05, 1e-10) and close(dist.f_sf(4.102821015, 2, 10), 0.05, 1e-7)
    assert close(dist.tukey_ppf(0.95, 3, 20), 3.577935, 1e-5) and close(dist.tukey_sf(3.577935, 3, 20), 0.05, 1e-4)
    assert dist.signrank_cdf(10, 8) == 0.15625 and close(dist.ranksum_cdf(5, 4, 5), 18 / 126, 1e-12)


def test_quantile_types_match_numpy(spark):
    v = np.round(np.random.default_rng(1).normal(size=53), 1)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "x double").repartition(5)
    names = ["inverted_cdf", "averaged_inverted_cdf", "closest_observation", "interpolated_inverted_cdf", "hazen", "weibull", "linear", "median_unbiased", "normal_unbiased"]
    probs = (0.0, 0.1, 0.33, 0.5, 0.9, 1.0)
    for kind, name in enumerate(names, 1):
        got = {r.prob: r.value for r in descriptive.quantile(df, "x", probs, kind).collect()}
        for p in probs:
            assert close(got[p], np.quantile(v, p, method=name), 1e-9), (kind, p)


def test_describe_groups_nulls_and_policies(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", float("nan")), ("b", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in descriptive.describe(df, ["x"], ["g"]).collect()}
    assert got["a"].n == 3 and close(got["a"].mean, 7 / 3) and got["b"].n == 1 and got["b"]["var"] is None
    spoiled = {r.g: r for r in descriptive.describe(df, ["x"], ["g"], "everything").collect()}
    assert math.isnan(spoiled["a"].mean) and math.isnan(spoiled["b"].mean)
    assert descriptive.describe(df.where("false"), ["x"], ["g"]).count() == 0
    with pytest.raises(ValueError):
        descriptive.describe(df, ["x"], na_action="some")


def test_correlations(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 9, 80).astype(float), rng.integers(0, 9, 80).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    pick = lambda m: descriptive.cor(df, ["x", "y"], method=m).where("a <> b").first()["cor"]
    assert close(pick("pearson"), np.corrcoef(x, y)[0, 1], 1e-9)
    assert close(pick("spearman"), np.corrcoef(rank(x), rank(y))[0, 1], 1e-9)
    s = [(np.sign(a - c), np.sign(b - d)) for (a, b), (c, d) in combinations(zip(x, y), 2)]
    tau = sum(p * q for p, q in s) / math.sqrt(sum(p * p for p, _ in s) * sum(q * q for _, q in s))
    assert close(pick("kendall"), tau, 1e-9)


def test_t_tests(spark):
    g1, g2 = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0], [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
    long = spark.createDataFrame([("1", v) for v in g1] + [("2", v) for v in g2], "g string, x double")
    r = hypothesis.t_test(long, "x", group="g", groups=("1", "2")).first()
    assert close(r.statistic, -1.860813, 1e-6) and close(r.df, 17.77647, 1e-6) and close(r.p_value, 0.07939414, 1e-6) and close(r.conf_low, -3.3654832, 1e-6)
    wide = spark.createDataFrame(list(zip(g1, g2)), "a double, b double")
    r = hypothesis.t_test(wide, "a", "b", paired=True).first()
    assert close(r.statistic, -4.062128, 1e-6) and close(r.p_value, 0.00283289, 1e-6)
    assert hypothesis.t_test(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").first().statistic is None


def test_tables(spark):
    tea = spark.createDataFrame([("m", "m")] * 3 + [("m", "t")] + [("t", "m")] + [("t", "t")] * 3, "a string, b string")
    r = hypothesis.fisher_test(tea, "a", "b").first()
    assert close(r.p_value, 0.4857143, 1e-6) and close(r.estimate, 6.408309, 1e-5) and close(r.conf_low, 0.2117329, 1e-4)
    t = r.conf_high  # an odds ratio at which three hits or fewer have a chance of 2.5 %
    assert close((1 + 16 * t + 36 * t**2 + 16 * t**3) / (1 + 16 * t + 36 * t**2 + 16 * t**3 + t**4), 0.025, 1e-6)
    smokers = [(str(i), k < x) for i, (x, n) in enumerate([(83, 86), (90, 93), (129, 136), (70, 82)]) for k in range(n)]
    r = hypothesis.prop_test(spark.createDataFrame(smokers, "g string, s boolean"), "s", "g").first()
    assert close(r.statistic, 12.60041, 1e-6) and close(r.p_value, 0.005585477, 1e-5)


def test_rank_tests(spark):
    x = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
    y = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
    r = hypothesis.wilcox_signed_rank(spark.createDataFrame(list(zip(x, y)), "x double, y double"), "x", "y", "greater").first()
    assert r.statistic == 40 and close(r.p_value, 0.01953125, 1e-9)
    a, b = [0.80, 0.83, 1.89, 1.04, 1.45, 1.38, 1.91, 1.64, 0.73, 1.46], [1.15, 0.88, 0.90, 0.74, 1.21]
    r = hypothesis.wilcox_rank_sum(spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double"), "v", "g", ("a", "b"), "greater").first()
    assert r.statistic == 35 and close(r.p_value, 0.1272061, 1e-6)


def test_p_adjust(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.05, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    adj = lambda m: [None if r.p_adjusted is None else round(r.p_adjusted, 9) for r in hypothesis.p_adjust(df, "p", m).orderBy("i").collect()]
    assert adj("holm")[:5] == [0.05, 0.08, 0.09, 0.09, 0.09] and adj("BH")[:5] == [0.05] * 5 and adj("hochberg")[:5] == [0.05] * 5
    assert adj("bonferroni") == [0.05, 0.1, 0.15, 0.2, 0.25, None] and adj("BY")[0] == round(0.05 * sum(1 / k for k in range(1, 6)), 9)
    rng = np.random.default_rng(3)
    v = rng.uniform(0, 0.2, 8)
    got, n = hypothesis.hommel(v), len(v)
    for i in range(n):  # closed testing with Simes' test
        worst = 0.0
        for k in range(n):
            for rest in combinations([j for j in range(n) if j != i], k):
                s = np.sort(v[[i, *rest]])
                worst = max(worst, (s * len(s) / np.arange(1, len(s) + 1)).min())
        assert close(got[i], worst, 1e-9)


def test_anova_family(plants, spark):
    r = anova.anova_oneway(plants, "weight", "grp").where("term = 'grp'").first()
    assert close(r.f, 4.846088, 1e-6) and close(r.p_value, 0.01590996, 1e-6)
    post = {(r.group1, r.group2): r for r in anova.anova_posthoc(plants, "weight", "grp").collect()}
    assert close(post["ctl", "trt1"].p_value, 0.3908711, 1e-4) and close(post["trt1", "trt2"].p_value, 0.0120064, 1e-3) and close(post["ctl", "trt2"].conf_high, 1.1852161, 1e-4)
    assert close(anova.levene_test(plants, "weight", "grp").first().f, 1.119186, 1e-5)
    for kind in (1, 2, 3):
        f = anova.anova(plants, "weight", ["grp"], ss_type=kind).where("term = 'grp'").first()
        assert close(f.f, 4.846088, 1e-6)


def test_linear_models(plants, spark):
    fit = regression.lm(plants.where("grp <> 'trt2'"), "weight", [C("grp")])
    assert close(fit.coef[0], 5.032, 1e-9) and close(fit.coef[1], -0.371, 1e-9) and close(fit.se[1], 0.3114349, 1e-6) and close(fit.info["r_squared"], 0.07307759, 1e-6)
    rows = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(20)], "a double, b double, y double")
    aliased = regression.lm(rows, "y", ["a", "b"])
    assert math.isnan(aliased.coef[2]) and not math.isnan(aliased.coef[1])
    x = np.array([[1.0, r.a] for r in rows.collect()])
    y = np.array([r.y for r in rows.collect()])
    r = regression.simple_ols(rows, "a", "y").first()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert close(r.slope, b[1], 1e-9) and close(r.intercept, b[0], 1e-9)
    sd = x[:, 1].std()
    z = (x[:, 1] - x[:, 1].mean()) / sd
    assert close(regression.ridge(rows, "y", ["a"], 5.0).coef[1], (z @ (y - y.mean())) / (z @ z + 5) / sd, 1e-9)


def test_generalised_models(spark):
    counts = [18, 17, 15, 20, 10, 20, 25, 13, 12]
    df = spark.createDataFrame([(float(c), str(i % 3 + 1), str(i // 3 + 1)) for i, c in enumerate(counts)], "counts double, outcome string, treatment string")
    fit = regression.glm(df, "counts", [C("outcome"), C("treatment")], "poisson")
    assert close(fit.coef[0], 3.044522, 1e-6) and close(fit.coef[1], -0.4542553, 1e-6) and close(fit.coef[2], -0.2929871, 1e-6) and close(fit.info["deviance"], 5.129141, 1e-6) and close(fit.se[0], 0.1708987, 1e-5)
    u, t = [5, 10, 15, 20, 30, 40, 60, 80, 100], [118, 58, 42, 35, 27, 25, 21, 19, 18]
    clot = spark.createDataFrame([(math.log(a), float(b)) for a, b in zip(u, t)], "lu double, y double")
    fit = regression.glm(clot, "y", ["lu"], "gamma")
    assert close(fit.coef[0], -0.01655438, 1e-5) and close(fit.coef[1], 0.01534311, 1e-5) and close(fit.dispersion, 0.002446059, 1e-4)
    with pytest.raises(ArithmeticError):
        regression.glm(clot, "y", ["lu"], "gamma", "log", max_iter=1)


def test_survival(lives, spark):
    km = {(r.x, r.time): r for r in survival.kaplan_meier(lives, "time", "status", ["x"]).collect()}
    assert close(km["Maintained", 9.0].survival, 0.9090909, 1e-6) and close(km["Maintained", 9.0].std_error, 0.08667842, 1e-5) and close(km["Maintained", 23.0].survival, 0.6136364, 1e-6)
    assert km["Nonmaintained", 45.0].survival == 0
    r = survival.log_rank(lives, "time", "status", "x").where("grp = 'Maintained'").first()
    assert close(r.expected, 10.68925, 1e-5) and close(r.statistic, 3.396389, 1e-5) and close(r.p_value, 0.06533932, 1e-4)
    fit = survival.coxph(lives, "time", "status", [C("x")])
    assert close(fit.coef[0], 0.9155326, 1e-5) and close(fit.se[0], 0.5119290, 1e-4)


def test_categorical(spark):
    rows = [("a",)] * 20 + [("b",)] * 30 + [("c",)] * 50
    fit = categorical.multinomial(spark.createDataFrame(rows, "y string"), "y", [])
    assert close(fit.coef[0], math.log(0.4), 1e-6) and close(fit.coef[1], math.log(0.6), 1e-6)
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000)
    y = np.digitize(1.0 * x + rng.logistic(size=4000), [-1.0, 0.5])
    fit = categorical.ordinal(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int"), "y", ["x"])
    assert abs(fit.coef[0] - 1) < 4 * fit.se[0] and abs(fit.coef[1] + 1) < 4 * fit.se[1] and abs(fit.coef[2] - 0.5) < 4 * fit.se[2]
    with pytest.raises(ValueError):
        categorical.ordinal(spark.createDataFrame([(0.0, 0), (1.0, 2)], "x double, y int"), "y", ["x"])


def test_mixed_model_against_dense_likelihood(spark):
    rng = np.random.default_rng(5)
    g, x = np.repeat(np.arange(12), 6), rng.normal(size=72)
    y = 1 + 0.5 * x + rng.normal(0, 1.5, 12)[g] + rng.normal(size=72)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g int, x double, y double").repartition(3)
    fit = mixed.lmm(df, "y", ["x"], "g")
    design, z = np.column_stack([np.ones(72), x]), (g[:, None] == np.arange(12)) * 1.0

    def deviance(r):
        v = np.eye(72) + r * z @ z.T
        vi = np.linalg.inv(v)
        b = np.linalg.solve(design.T @ vi @ design, design.T @ vi @ y)
        e = y - design @ b
        return 70 * math.log(e @ vi @ e / 70) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(design.T @ vi @ design)[1], b

    grid = np.geomspace(0.01, 50, 4000)
    best = min(grid, key=lambda r: deviance(r)[0])
    assert close(fit.info["tau2"] / fit.info["sigma2"], best, 1e-2) and np.allclose(fit.coef, deviance(best)[1], atol=1e-3)
    assert abs(sum(r.intercept for r in mixed.blups(df, "y", ["x"], "g", fit).collect())) < 1e-6


def test_additive_model(spark):
    x = np.linspace(0, 1, 400)
    y = np.sin(2 * np.pi * x) + np.random.default_rng(6).normal(0, 0.1, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = mixed.gam(df, "y", ["x"], 10).collect()
    assert max(abs(r.value + r.intercept - math.sin(2 * math.pi * r.knot)) for r in got) < 0.12


def test_time_series(spark):
    rng = np.random.default_rng(7)
    y = np.zeros(600)
    e = rng.normal(size=600)
    for t in range(1, 600):
        y[t] = 0.6 * y[t - 1] + e[t]
    s = spark.createDataFrame([("k", t + 1, float(v)) for t, v in enumerate(y)], "key string, t int, y double")
    c = y - y.mean()
    got = {r.lag: r.acf for r in ts.acf(s, 3).collect()}
    assert all(close(got[k], (c[k:] @ c[: len(c) - k]) / (c @ c), 1e-9) for k in range(4))
    part = {r.lag: r.pacf for r in ts.pacf(s, 3).collect()}
    assert close(part[1], got[1], 1e-9) and abs(part[2]) < 0.15
    ar = ts.arima(s, (1, 0, 0), 3).first()
    assert abs(ar.ar[0] - 0.6) < 0.1 and abs(ar.sigma2 - 1) < 0.2
    assert ts.kpss(s).first().p_value > 0.04 and ts.adf(s).first().statistic < -5
    line = spark.createDataFrame([("k", t, float(3 * t + (t % 4))) for t in range(1, 41)], "key string, t int, y double")
    d = ts.decompose(line, 4).where("trend is not null").collect()
    assert max(abs(r.remainder) for r in d) < 1e-9
    f = ts.ets(line, trend=True, horizon=4).orderBy("h").collect()
    assert abs(f[0].forecast - 124) < 3


def test_multivariate(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=(500, 1))
    x = f @ np.array([[0.9, 0.8, 0.7, 0.6]]) + rng.normal(size=(500, 4)) * [0.4, 0.6, 0.7, 0.8]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = {r.component: r.sdev for r in multivariate.pca(df, ["a", "b", "c", "d"]).collect()}
    assert all(close(got[i + 1] ** 2, w[i], 1e-8) for i in range(4))
    scores = np.array([r.pc1 for r in multivariate.pca_scores(df, ["a", "b", "c", "d"], 1).collect()])
    assert close(scores.var(ddof=1), w[0], 1e-8)
    load = multivariate.factor_analysis(df, ["a", "b", "c", "d"], 1).collect()
    assert load[0].loading > 0.8 and load[0].p_value > 0.001 and load[0].loading ** 2 + load[0].uniqueness == pytest.approx(1, abs=1e-3)


def test_missing_data(spark):
    rng = np.random.default_rng(9)
    x = rng.multivariate_normal([1, 2], [[1, 0.8], [0.8, 2]], 400)
    hole = rng.random(400) < 0.3
    df = spark.createDataFrame([(i, float(a), None if h else float(b)) for i, ((a, b), h) in enumerate(zip(x, hole))], "i int, a double, b double")
    whole = {(r.a, r.b): r.cov for r in missing.mvn_mle(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double"), ["a", "b"]).collect()}
    assert close(whole["a", "b"], np.cov(x.T, ddof=0)[0, 1], 1e-8)
    # For monotone missing data the estimate has a closed form.
    a, b = x[:, 0], x[~hole]
    slope = np.cov(b.T, ddof=0)[0, 1] / b[:, 0].var()
    want = b[:, 1].mean() + slope * (a.mean() - b[:, 0].mean())
    got = {(r.a, r.b): r for r in missing.mvn_mle(df, ["a", "b"]).collect()}
    assert close(got["b", "b"].mean_a, want, 1e-6)
    assert missing.little_mcar(df, ["a", "b"]).first().p_value > 0.001
    m = missing.mice(df, ["a", "b"], m=3, max_iter=2, key="i")
    assert m.where("b is null").count() == 0 and m.count() == 1200
    again = missing.mice(df.repartition(7), ["a", "b"], m=3, max_iter=2, key="i")
    assert close(m.agg({"b": "avg"}).first()[0], again.agg({"b": "avg"}).first()[0], 1e-6)


def test_resampling(spark):
    v = np.random.default_rng(10).normal(size=200)
    df = spark.createDataFrame([(i, float(a), "x" if i < 100 else "y") for i, a in enumerate(v)], "i int, v double, g string")
    reps = montecarlo.boot_means(df, "v", "i", 300).toPandas()["stat"]
    assert abs(reps.mean() - v.mean()) < 0.02 and abs(reps.std() - v.std() / math.sqrt(200)) < 0.02
    assert reps.sort_values().tolist() == pytest.approx(montecarlo.boot_means(df.repartition(5), "v", "i", 300).toPandas()["stat"].sort_values().tolist())
    seen, r = montecarlo.boot(df, ["v"], lambda a: float(np.mean(a)), 300)
    for kind in ("normal", "basic", "percentile", "bca"):
        lo, hi = montecarlo.boot_ci(seen, r, kind)
        assert lo < seen < hi
    p = montecarlo.permutation_test(df, "v", "g", ("x", "y"), 300).first()
    assert 0 < p.p_value <= 1 and p.p_value == montecarlo.permutation_test(df.repartition(3), "v", "g", ("x", "y"), 300).first().p_value


def test_generalised_mixed_model_query_over_all_users(spark, tmp_path):
    import pandas as pd

    from lattica.plans.queries import QUERIES

    rng, users, each = np.random.default_rng(4), 31, 12
    g = np.repeat(np.arange(users), each)
    hours = rng.integers(0, 24, len(g))
    y = rng.random(len(g)) < 1 / (1 + np.exp(-(0.6 - 1.2 * hours / 24 + rng.normal(0, 1.1, users)[g])))
    pdf = pd.DataFrame({"user_id": g, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"), "value": np.where(y, 60.0, 40.0)})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "events.parquet"))
    x, z = np.column_stack([np.ones(len(g)), hours / 24]), np.eye(users)[g]

    def joint(tau):  # Laplace likelihood, joint mode and coefficients' errors with all effects in one dense system
        both, pen, b = np.hstack([x, z]), np.diag([0.0, 0.0] + [1 / tau**2] * users), np.zeros(2 + users)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-both @ b))
            h = both.T @ (both * (mu * (1 - mu))[:, None]) + pen
            b = b + np.linalg.solve(h, both.T @ (y - mu) - pen @ b)
        value = (y * (both @ b) - np.logaddexp(0, both @ b)).sum() - b[2:] @ b[2:] / (2 * tau**2) - 0.5 * np.linalg.slogdet(h[2:, 2:] * tau**2)[1]
        return value, b[:2], np.sqrt(np.diag(np.linalg.inv(h))[:2])

    best = max(np.geomspace(0.05, 5, 600), key=lambda t: joint(t)[0])
    got = QUERIES["generalised_mixed_model"](spark, str(tmp_path)).toPandas()
    assert abs(np.log(got["tau"][0] / best)) < 0.04  # the last grid's spacing
    _, coef, err = joint(best)
    assert np.allclose(got["estimate"], coef, atol=0.01) and np.allclose(got["std_error"], err, atol=0.01)


def test_p_adjust_queries_over_all_parts(spark, tmp_path):
    from lattica.plans.queries import QUERIES

    spark.range(1, 701).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    k = np.arange(1, 701)
    p = (k * 7919 % 9973 + 1) / 100000.0
    n, order = len(p), np.argsort(p, kind="stable")
    r = np.arange(1, n + 1)
    down, up = (lambda v: np.maximum.accumulate(v)), (lambda v: np.minimum.accumulate(v[::-1])[::-1])
    v = p[order]
    want = {"holm": down(v * (n - r + 1)), "hochberg": up(v * (n - r + 1)), "BH": up(v * n / r), "BY": up(v * n / r * (1 / r).sum()), "bonferroni": v * n}
    got = QUERIES["p_adjust_methods"](spark, str(tmp_path)).toPandas()
    assert len(got) == 5 * n
    for m, w in want.items():
        assert np.allclose(got[got.method == m].sort_values("k")["p_adjusted"].to_numpy()[order], np.minimum(1, w), atol=1e-8), m
    adjusted = QUERIES["p_adjust_hommel"](spark, str(tmp_path)).toPandas().sort_values("k")
    assert len(adjusted) == n and np.allclose(adjusted["p_adjusted"], hypothesis.hommel(p))


def test_hommel_is_closed_testing():
    from itertools import combinations

    from lattica.operators.hypothesis import hommel

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7):
        p = np.round(rng.random(n) ** 2, 2)
        simes = lambda s: (len(s) * np.sort(p[list(s)]) / np.arange(1, len(s) + 1)).min()
        want = [max(simes(s) for k in range(1, n + 1) for s in combinations(range(n), k) if i in s) for i in range(n)]
        assert np.allclose(hommel(p), np.minimum(want, 1))
    assert np.isnan(hommel(np.array([np.nan, 0.01]))).tolist() == [True, False]


def test_bootstrap_methods(spark):
    from lattica.operators.montecarlo import boot

    df = spark.createDataFrame([(float(i), "a" if i < 10 else "b") for i in range(30)], "v double, g string")
    mean = lambda m: float(m[:, 0].mean())
    with pytest.raises(ValueError):
        boot(df, ["v"], mean, 10, method="nonsense")
    with pytest.raises(ValueError):
        boot(df, ["v"], mean, 10, method="parametric")
    _, same = boot(df, ["v"], mean, 20, method="parametric", ran_gen=lambda data, rng: data * 0 + 7)
    assert {r.stat for r in same.collect()} == {7.0}
    share = lambda m: float((m[:, 0] < 10).mean())
    assert {round(r.stat, 9) for r in boot(df, ["v"], share, 30, strata="g")[1].collect()} == {round(1 / 3, 9)}
    assert len({r.stat for r in boot(df, ["v"], share, 30)[1].collect()}) > 3


def test_hazards_test_with_survival_transform(spark):
    from lattica.operators.survival import coxph, cox_zph

    rng = np.random.default_rng(2)
    rows = [(float(t), int(e), float(x)) for t, e, x in zip(rng.permutation(60) + 1, rng.random(60) < 0.7, rng.normal(size=60))]
    df = spark.createDataFrame(rows, "t double, e int, x double")
    fit = coxph(df, "t", "e", ["x"])
    got = cox_zph(df, "t", "e", ["x"], fit).collect()[0].statistic
    rows.sort()
    t, e, x = (np.array(c, float) for c in zip(*rows))
    w, curve, g, u, i = np.exp(x * fit.coef[0]), 1.0, [], [], []
    for k in range(60):
        if e[k]:
            m = (w[k:] * x[k:]).sum() / w[k:].sum()
            g.append(1 - curve)
            u.append(x[k] - m)
            i.append((w[k:] * x[k:] ** 2).sum() / w[k:].sum() - m * m)
            curve *= 1 - 1 / (60 - k)
    g, u, i = np.array(g) - np.mean(g), np.array(u), np.array(i)
    want = (g @ u) ** 2 / ((g * g * i).sum() - (g * i).sum() ** 2 / i.sum())
    assert abs(got - want) < 1e-6 * want


def test_kendall_missing_values(spark):
    from lattica.operators.descriptive import cor

    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 4.0, 6.0), (4.0, 3.0, 7.0)], "a double, b double, c double")
    tau = lambda na: {(r.a, r.b): (r.cor, r.n) for r in cor(df, ["a", "b", "c"], na_action=na, method="kendall").collect()}
    assert tau("complete")["a", "b"][1] == 3 and tau("pairwise")["a", "b"] == (1 / 3, 4) and tau("pairwise")["a", "c"] == (1.0, 3)
