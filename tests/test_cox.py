"""Cox regression against plain loops over risk sets: ties, entry, weights, strata, robust variance, ranges of time."""

from __future__ import annotations

import numpy as np
import pytest

from lattica.operators import cox, survival


def _plain(rows, beta, efron):
    """Log likelihood, score, information and each row's score residual, by the definitions."""
    st, s, t, e, w = (np.array([r[i] for r in rows]) for i in range(5))
    x = np.array([[r[5], r[6]] for r in rows], float)
    s, t, e, w = s.astype(float), t.astype(float), e.astype(int), w.astype(float)
    risk = np.exp(x @ beta)
    ll, score, info, res = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((len(rows), 2))
    for g, u in sorted({(a, b) for a, b, d in zip(st, t, e) if d}):
        at = (st == g) & (s < u) & (t >= u)
        dead = at & (t == u) & (e == 1)
        n, means = dead.sum(), []
        ll += (w * np.log(risk))[dead].sum()
        for m in range(n):
            f = m / n if efron else 0.0
            share = np.where(dead, 1 - f, 1.0) * at
            v = w * risk * share
            mean = v @ x / v.sum()
            bar = w[dead].mean()
            ll -= bar * np.log(v.sum())
            info += bar * ((x * v[:, None]).T @ x / v.sum() - np.outer(mean, mean))
            res -= (risk * share * bar / v.sum())[:, None] * (x - mean) * at[:, None]
            means.append(mean)
        score += (w[dead, None] * (x[dead] - np.mean(means, 0))).sum(0)
        res[dead] += x[dead] - np.mean(means, 0)
    return ll, score, info, res * w[:, None]


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(5)
    out = []
    for i in range(120):
        enter = int(rng.integers(0, 6))
        out.append((str(rng.integers(0, 3)), float(enter), float(enter + rng.integers(1, 12)), int(rng.random() < 0.7), float(rng.integers(1, 4)), float(rng.normal()), float(rng.random() < 0.5), int(i % 25)))
    return out


@pytest.mark.parametrize(("ties", "times"), [("efron", 4), ("breslow", 200_000)])
def test_cox_matches_plain_loops(spark, people, ties, times, monkeypatch):
    monkeypatch.setattr(cox, "TIMES_PER_RANGE", times)
    monkeypatch.setattr(cox, "DEATHS_PER_BLOCK", 7)
    df = spark.createDataFrame(people, "g string, enter double, t double, e int, w double, x double, z double, c int")
    fit = survival.coxph(df, "t", "e", ["x", "z"], strata="g", ties=ties, start="enter", weights="w", cluster="c")
    ll, score, info, res = _plain(people, fit.coef, ties == "efron")
    assert np.abs(score).max() < 1e-5 and abs(fit.info["log_lik"] - ll) < 1e-8 * abs(ll) and fit.info["converged"] and not fit.info["infinite"]
    naive = np.linalg.inv(info)
    assert np.allclose(fit.info["naive_cov"], naive, rtol=1e-6)
    by = np.zeros((25, 2))
    np.add.at(by, [r[7] for r in people], res)
    assert np.allclose(fit.cov, naive @ by.T @ by @ naive, rtol=1e-5) and fit.info["clusters"] == 25
    if ties == "breslow":
        return
    alone = survival.coxph(df, "t", "e", ["x", "z"], ties=ties, robust=True)
    flat = [("", 0.0, *r[2:4], 1.0, *r[5:]) for r in people]
    _, score, info, res = _plain(flat, alone.coef, ties == "efron")
    assert np.abs(score).max() < 1e-5 and np.allclose(alone.cov, np.linalg.inv(info) @ res.T @ res @ np.linalg.inv(info), rtol=1e-5)


def test_cox_refuses_and_flags(spark):
    df = spark.createDataFrame([(0.0, float(i), 1, float(i <= 5), 1.0) for i in range(1, 11)], "s double, t double, e int, x double, w double")
    assert survival.coxph(df, "t", "e", ["x"]).info["infinite"] == ["x"]
    for bad in ({"start": "t"}, {"weights": "s"}, {"ties": "exact"}):
        with pytest.raises(ValueError):
            survival.coxph(df, "t", "e", ["x"], **bad)
    with pytest.raises(ValueError):
        survival.coxph(df.where("e = 0"), "t", "e", ["x"])
