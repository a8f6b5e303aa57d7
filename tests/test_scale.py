"""Work that grows no faster than the input: families of p-values, and fits over repeated covariates."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd

from lattica.operators import hypothesis


def test_p_adjust_in_ranges_of_families(spark):
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame({"i": np.arange(n), "g": rng.choice(["a", "b", ""], n, p=[0.6, 0.38, 0.02]), "p": np.round(rng.random(n) ** 3, 4)})
    pdf.loc[rng.random(n) < 0.05, "p"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("i", "nullif(g, '') AS g", "p")
    methods = {m: m for m in ("holm", "hochberg", "BH", "BY", "bonferroni", "hommel", "none")}
    got = hypothesis.p_adjust_many(df, "p", methods, ["g"]).toPandas().sort_values("i").reset_index(drop=True)
    assert len(got) == n
    for g in ("a", "b", ""):
        rows = got[(pdf["g"] == g) & pdf["p"].notna()]
        p = rows["p"].to_numpy()
        k, order = len(p), np.argsort(p, kind="stable")
        v, r = p[order], np.arange(1, len(p) + 1)
        up = lambda x: np.minimum.accumulate(x[::-1])[::-1]
        want = {"holm": np.maximum.accumulate(v * (k - r + 1)), "hochberg": up(v * (k - r + 1)), "BH": up(v * k / r), "BY": up(v * k / r * (1 / r).sum()), "bonferroni": v * k}
        for m, w in want.items():
            assert np.allclose(rows[m].to_numpy()[order], np.minimum(1, w), rtol=1e-12), (g, m)
        assert np.allclose(rows["hommel"], hypothesis.hommel(p), rtol=1e-12) and np.array_equal(rows["none"], p)
    assert got[pdf["p"].isna()][list(methods)].isna().all().all()


def test_p_adjust_keeps_the_place_of_a_column_adjusted_in_place(spark):
    df = spark.createDataFrame([(1, 0.01, "x"), (2, 0.04, "y")], "i int, p double, s string")
    got = hypothesis.p_adjust(df, "p", "bonferroni", out="p")
    assert got.columns == ["i", "p", "s"] and [r.p for r in got.orderBy("i").collect()] == [0.02, 0.08]


def test_by_adjustment_is_not_quadratic(spark):
    """The harmonic sum used to be formed anew in every row: 9e10 steps here."""
    began = time.perf_counter()
    top = hypothesis.p_adjust(spark.range(1, 300_001).selectExpr("id", "id / 3e8 AS p"), "p", "BY").agg({"p_adjusted": "max"}).first()[0]
    assert abs(top - 0.001 * (1 / np.arange(1, 300_001)).sum()) < 1e-12 and time.perf_counter() - began < 60


def test_hommel_of_a_large_family():
    """Quadratic closed testing took minutes here; checked by its own definition at some tests."""
    n = 200_000
    p = np.sort(np.random.default_rng(5).random(n) ** 4)
    began = time.perf_counter()
    got = hypothesis.hommel(p)
    assert time.perf_counter() - began < 20
    sizes = np.unique(np.geomspace(1, n, 300).astype(int))
    simes = np.array([(m * p[n - m :] / np.arange(1, m + 1)).min() for m in sizes])
    for k in (0, 10, 1000, n // 2, n - 1):
        assert got[k] >= min(1, np.minimum(sizes * p[k], simes).max()) - 1e-12
        assert p[k] <= got[k] <= min(1, n * p[k])
    assert (np.diff(got) >= -1e-12).all()


def _repeated_rows(rng, n=4000):
    x = rng.integers(0, 6, n) / 5
    pdf = pd.DataFrame({"x": x, "o": rng.integers(0, 2, n) * 0.1, "w": rng.integers(0, 3, n).astype(float)})
    mu = np.exp(0.4 + 0.8 * x)
    return pdf.assign(count=rng.poisson(mu).astype(float), price=rng.gamma(3, mu / 3), flag=(rng.random(n) < 0.2 + 0.5 * x).astype(float), share=np.round(rng.random(n), 2))


def test_cells_keep_deviance_likelihood_and_steps(spark, monkeypatch):
    """Folding rows of equal covariates gives the fit over single rows."""
    from lattica.operators import regression

    df = spark.createDataFrame(_repeated_rows(np.random.default_rng(7))).repartition(3).cache()
    models = [("price", "inverse_gaussian", "log", None, None), ("price", "gamma", "log", "w", "o"), ("count", "negative_binomial", None, None, None), ("share", "binomial", None, "w", None)]
    fit = lambda y, family, link, w, o: regression.glm(df, y, ["x"], family, link, w, o, 2.5 if family == "negative_binomial" else None, tol=1e-13)
    folded = [fit(*m) for m in models]
    monkeypatch.setattr(regression, "equal_rows", lambda keys: (np.arange(len(keys)), np.arange(len(keys))))
    for got, m in zip(folded, models):
        want = fit(*m)
        assert np.allclose(got.coef, want.coef, rtol=1e-6, atol=1e-8) and np.allclose(got.se, want.se, rtol=1e-6), m
        assert got.n == want.n and np.isclose(got.dispersion, want.dispersion)
        for c in ("deviance", "null_deviance", "pearson", "log_lik", "aic"):
            assert np.isclose(got.info[c], want.info[c], rtol=1e-8, equal_nan=True), (m, c)


def test_steps_read_cells_not_rows(spark, monkeypatch):
    """A fit used to send every row to Python in each step."""
    from lattica.operators import regression

    df = spark.createDataFrame(_repeated_rows(np.random.default_rng(8))).repartition(3).cache()
    seen, whole = [], regression.block_sum
    monkeypatch.setattr(regression, "block_sum", lambda rows, *a: (seen.append(rows.count()), whole(rows, *a))[1])
    regression.glm(df, "flag", ["x"], "binomial", "probit")
    assert seen and max(seen) <= 3 * 6


def test_mixed_model_gathers_groups_once(spark, monkeypatch):
    """Each pass used to shuffle all rows and call Python for every group."""
    from pyspark.sql import GroupedData

    from lattica.operators import mixed

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    df = spark.range(400).selectExpr("id % 20 AS g", "id % 4 / 4.0 AS x", "double(id % 7 < 3 + id % 20 % 2) AS y")
    fit = mixed.glmm(df, "y", ["x"], "g", rounds=1)
    assert fit.n == 400 and fit.info["groups"] == 20


def test_discrete_time_counts_equal_lives(spark):
    """Every person-period used to be a row of the fit; the rows that it now reads number the distinct lives' periods."""
    from lattica.operators import regression, survival

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"t": rng.integers(0, 5, 800), "e": rng.integers(0, 2, 800).astype(float), "x": rng.integers(0, 3, 800) / 2})
    pdf.loc[::50, "e"] = np.nan
    df = spark.createDataFrame(pdf).selectExpr("t", "CASE WHEN NOT isnan(e) THEN int(e) END AS e", "x").cache()
    seen, glm = [], survival.glm
    survival.glm = lambda rows, *a, **k: (seen.append(rows.count()), glm(rows, *a, **k))[1]
    try:
        got = survival.discrete_time(df, "t", "e", ["x"])
    finally:
        survival.glm = glm
    want = regression.glm(survival.person_period(df, "t", "e"), "y", ["period", "x"], "binomial", "cloglog")
    assert got.labels == want.labels and got.n == want.n and max(seen) <= 2 * 3 * 3 * 10
    assert np.allclose(got.coef, want.coef, atol=1e-7) and np.allclose(got.se, want.se, rtol=1e-6)


def test_mice_copies_only_incomplete_rows(spark, monkeypatch):
    from lattica.operators import missing
    from lattica.plans import stages

    df = spark.range(300).selectExpr("id", "double(id % 17) AS a", "CASE WHEN id % 10 > 0 THEN id % 17 * 2.0 + id % 3 END AS b")
    seen, settle = [], stages.settle
    monkeypatch.setattr(stages, "settle", lambda d: (seen.append(d.count()), settle(d))[1])
    got = missing.mice(df, ["a", "b"], m=3, max_iter=1, key="id")
    assert max(seen) == 3 * 30 and got.count() == 900 and got.where("b is null").count() == 0
    assert got.where("id % 10 > 0").selectExpr("sum(b - id % 17 * 2 - id % 3)").first()[0] == 0
