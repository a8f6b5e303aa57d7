"""Survival analysis: Kaplan-Meier, log-rank, Cox regression, discrete-time hazard."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dist
from lattica.functions.design import build
from lattica.operators.cox import coxph
from lattica.operators.regression import Fit, glm
from lattica.plans.blocks import collapse, equal_rows
from lattica.plans.finish import frame


def time_counts(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """(by, time, n_event, n_censor, n_risk): the collapsed table that all estimators read.

    Rows at risk are a reverse running sum over distinct times; the table has one row a time, however
    many subjects there are.
    """
    by = by or []
    e = F.col(event).cast("int")
    d = df.where(F.col(time).isNotNull() & e.isNotNull()).groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.sum(e).alias("n_event"), F.sum(1 - e).alias("n_censor"))
    later = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("n_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(later))


def kaplan_meier(df: DataFrame, time: str, event: str, by: list[str] | None = None, conf_level: float = 0.95, conf_type: str = "log") -> DataFrame:
    """Survival curve at every time with Greenwood error and interval (log, log-log or plain)."""
    by = by or []
    t = time_counts(df, time, event, by)
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    dead = F.max((F.col("n_event") == F.col("n_risk")).cast("int")).over(upto)
    log_s = F.sum(F.when(F.col("n_event") < F.col("n_risk"), F.log1p(-F.col("n_event") / F.col("n_risk"))).otherwise(0.0)).over(upto)
    t = t.withColumns({"survival": F.when(dead == 1, 0.0).otherwise(F.exp(log_s)), "_g": F.sum(F.when(F.col("n_event") < F.col("n_risk"), F.col("n_event") / (F.col("n_risk") * (F.col("n_risk") - F.col("n_event")))).otherwise(0.0)).over(upto)})
    z, s, se = dist.norm_ppf((1 + conf_level) / 2), F.col("survival"), F.sqrt("_g")
    if conf_type == "log":
        lo, hi = s * F.exp(-z * se), F.least(F.lit(1.0), s * F.exp(z * se))
    elif conf_type == "log-log":
        w = z * se / F.log(s)
        lo, hi = F.pow(s, F.exp(-w)), F.pow(s, F.exp(w))
    else:
        lo, hi = F.greatest(F.lit(0.0), s - z * s * se), F.least(F.lit(1.0), s + z * s * se)
    return t.select(*by, "time", "n_risk", "n_event", "n_censor", "survival", (s * se).alias("std_error"), F.when(s > 0, lo).alias("conf_low"), F.when(s > 0, hi).alias("conf_high"))


def log_rank(df: DataFrame, time: str, event: str, group: str, rho: float = 0.0) -> DataFrame:
    """G-rho test of equal survival: observed and expected events a group, statistic and p-value.

    Works on the collapsed table of times and groups; the covariance is summed in one aggregation.
    """
    g = time_counts(df, time, event, [group])
    pooled = time_counts(df.where(F.col(group).isNotNull()), time, event).select("time", F.col("n_event").alias("d"), F.col("n_risk").alias("r"))
    before = Window.partitionBy(F.lit(0)).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    s = F.exp(F.coalesce(F.sum(F.when(F.col("d") < F.col("r"), F.log1p(-F.col("d") / F.col("r"))).otherwise(-745.0)).over(before), F.lit(0.0)))
    pooled = pooled.withColumn("w", F.pow(s, F.lit(rho)) if rho else F.lit(1.0)).where("d > 0")
    names = [r[0] for r in g.select(F.col(group).cast("string")).distinct().orderBy(F.col(group).cast("string")).collect()]
    k = len(names)
    name = F.col(group).cast("string")
    # At-risk counts of a group at an event time: its rows at or after that time, by a forward fill from the next of its times.
    wide = pooled.join(g.groupBy("time").agg(*(F.sum(F.when(name == v, F.col("n_event") + F.col("n_censor")).otherwise(0)).alias(f"x{i}") for i, v in enumerate(names)), *(F.sum(F.when(name == v, F.col("n_event")).otherwise(0)).alias(f"d{i}") for i, v in enumerate(names))), "time", "full")
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumns({f"r{i}": F.sum(f"x{i}").over(later) for i in range(k)}).where("d > 0")
    v = F.when(F.col("r") > 1, F.col("w") ** 2 * F.col("d") * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    sums = [F.sum(F.col("w") * F.col(f"d{i}")) for i in range(k)] + [F.sum(F.col("w") * F.col("d") * F.col(f"r{i}") / F.col("r")) for i in range(k)]
    sums += [F.sum(v * (F.col(f"r{i}") / F.col("r")) * (F.lit(float(i == j)) - F.col(f"r{j}") / F.col("r"))) for i in range(k) for j in range(k)]
    got = np.array([float(x or 0) for x in wide.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()])
    obs, exp, cov = got[:k], got[k : 2 * k], got[2 * k :].reshape(k, k)
    u = (obs - exp)[: k - 1]
    stat = float(u @ np.linalg.pinv(cov[: k - 1, : k - 1]) @ u)
    p = dist.chi2_sf(stat, k - 1)
    rows = [(names[i], float(obs[i]), float(exp[i]), stat, float(k - 1), p) for i in range(k)]
    return frame(df.sparkSession, rows, "grp string, observed double, expected double, statistic double, df double, p_value double")


def person_period(df: DataFrame, time: str, event: str) -> DataFrame:
    """One row a subject and period lived through; the event falls into the last. Periods are 1, 2, ..."""
    t = F.col(time).cast("int")
    return df.where(t >= 1).withColumn("period", F.explode(F.sequence(F.lit(1), t))).withColumn("y", ((F.col("period") == t) & (F.col(event).cast("int") == 1)).cast("int"))


def discrete_time(df: DataFrame, time: str, event: str, terms: list, link: str = "cloglog") -> Fit:
    """Discrete-time hazard regression on person-periods.

    Subjects of equal time, event and covariates are counted in each task before their periods are listed.
    """
    if any("period" == getattr(t, "name", t) for term in terms for t in (term if isinstance(term, tuple) else (term,))):
        return glm(person_period(df, time, event), "y", ["period", *terms], "binomial", link)
    lives = df.where(F.col(time).cast("int") >= 1)
    d = build(lives, terms, intercept=False)
    k = len(d.columns)

    def count(m):
        m = np.column_stack([m, np.ones(len(m))]) if m.shape[1] == k + 2 else m
        code, first = equal_rows(m[:, :-1])
        return np.column_stack([m[first, :-1], np.bincount(code, m[:, -1])])

    # An unknown event leaves the periods before the last, in which nothing happened.
    died = F.coalesce((F.col(event).cast("int") == 1).cast("int"), F.lit(-1))
    rows = collapse(lives, [F.col(time).cast("int"), died, *d.columns], count, ["t", "e", *(f"x{i}" for i in range(k)), "n"])
    t = F.col("t").cast("int")
    rows = rows.withColumn("period", F.explode(F.sequence(F.lit(1), t))).withColumn("y", F.when(F.col("period") < t, 0.0).when(F.col("e") >= 0, F.col("e")))
    fit = glm(rows, "y", ["period", *(f"x{i}" for i in range(k))], "binomial", link, count="n")
    fit.labels = ["(Intercept)", "period", *d.labels]
    return fit


def median_survival(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Smallest time with survival at or below one half, averaged with the next drop where it is exactly one half."""
    s = F.round("survival", 12)
    below = F.min(F.when(s <= 0.5, F.col("time")))
    after = F.min(F.when(s < 0.5, F.col("time")))
    exact = F.max(F.when(s == 0.5, 1))
    return curve.groupBy(*(by or [])).agg(F.when(exact == 1, (below + F.coalesce(after, below)) / 2).otherwise(below).alias("median"))


def kaplan_meier_entry(df: DataFrame, start: str, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """Survival with delayed entry: at risk at t are those who entered before t and leave at t or later.

    Entries and exits are summed by time, so the running sums see one row a distinct time.
    """
    by = by or []
    e = F.col(event).cast("int")
    d = df.where(F.col(time).isNotNull() & F.col(start).isNotNull() & e.isNotNull())
    out = d.groupBy(*by, F.col(time).cast("double").alias("time")).agg(F.sum(e).alias("n_event"), F.count("*").alias("n_exit"), F.lit(0).cast("long").alias("n_enter"))
    into = d.groupBy(*by, F.col(start).cast("double").alias("time")).agg(F.lit(0).cast("long").alias("n_event"), F.lit(0).cast("long").alias("n_exit"), F.count("*").alias("n_enter"))
    t = out.unionByName(into).groupBy(*by, "time").agg(F.sum("n_event").alias("n_event"), F.sum("n_exit").alias("n_exit"), F.sum("n_enter").alias("n_enter"))
    past = Window.partitionBy(*(by or [F.lit(0)])).orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("n_risk", F.coalesce(F.sum("n_enter").over(past), F.lit(0)) - F.coalesce(F.sum("n_exit").over(past), F.lit(0))).where("n_exit > 0")
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    log_s = F.sum(F.when(F.col("n_event") < F.col("n_risk"), F.log1p(-F.col("n_event") / F.col("n_risk"))).otherwise(-745.0 * (F.col("n_event") > 0).cast("int"))).over(upto)
    return t.select(*by, "time", "n_risk", "n_event", F.when(log_s < -700, 0.0).otherwise(F.exp(log_s)).alias("survival"))


def concordance(df: DataFrame, time: str, event: str, score: str) -> DataFrame:
    """Harrell's C of a risk score: pairs whose order of times is known, concordant if the earlier death has the higher score.

    A Fenwick tree over score ranks, in one task over (time, event, score) counts: n log n.
    """
    d = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(score).cast("double").alias("s")).dropna()
    d = d.groupBy("t", "e", "s").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.unique(pdf["s"])
        tree = np.zeros(len(s) + 1, np.int64)

        def add(i, v):
            while i <= len(s):
                tree[i] += v
                i += i & -i

        def upto(i):
            total = 0
            while i > 0:
                total += tree[i]
                i -= i & -i
            return total

        con = dis = tied = 0
        pdf = pdf.assign(r=np.searchsorted(s, pdf["s"]) + 1)
        for _, rows in sorted(pdf.groupby("t"), key=lambda x: -x[0]):
            for r, n in rows.loc[rows["e"] == 0, ["r", "n"]].itertuples(index=False):
                add(r, n)  # censored at a death's time lives longer
            for r, n in rows.loc[rows["e"] == 1, ["r", "n"]].itertuples(index=False):
                low, same, all_ = upto(r - 1), upto(r) - upto(r - 1), upto(len(s))
                con, tied, dis = con + n * low, tied + n * same, dis + n * (all_ - low - same)
            for r, n in rows.loc[rows["e"] == 1, ["r", "n"]].itertuples(index=False):
                add(r, n)
        total = con + dis + tied
        return pd.DataFrame({"concordant": [con], "discordant": [dis], "tied": [tied], "c": [(con + tied / 2) / total if total else math.nan]})

    return d.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "concordant long, discordant long, tied long, c double")


def cox_zph(df: DataFrame, time: str, event: str, terms: list, fit: Fit, transform: str = "km") -> DataFrame:
    """Test of proportional hazards by correlation-scaled Schoenfeld residuals with (transformed) time, a term a row and GLOBAL.

    transform: km (one less the Kaplan-Meier curve before each death), identity, rank or log.
    Risk-set means come from collapsed sums by time, as in the fit; the driver sees one row an event time.
    """
    d = build(df, terms, intercept=False)
    k = len(d.columns)
    eta = sum((c * float(b) for c, b in zip(d.columns, fit.coef)), F.lit(0.0))
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"), F.exp(eta).alias("w"), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(d.columns))).dropna()
    tri = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum("w"), *(F.sum(F.col("w") * F.col(f"x{i}")) for i in range(k)), *(F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in tri), F.sum("e"), *(F.sum(F.col("e") * F.col(f"x{i}")) for i in range(k))]
    t = rows.groupBy("t").agg(F.count("*").alias("rows"), *(c.alias(f"a{i}") for i, c in enumerate(sums))).orderBy(F.desc("t")).toPandas()
    a = t.drop(columns=["t", "rows"]).to_numpy(float)
    q = 1 + k + len(tri)
    risk, dead = np.cumsum(a[:, :q], axis=0), a[:, q] > 0
    times, n, x = t["t"].to_numpy()[dead], a[dead, q], a[dead, q + 1 :]
    mean = risk[dead, 1 : 1 + k] / risk[dead, :1]
    v = np.zeros((len(n), k, k))
    for c, (i, j) in enumerate(tri):
        v[:, i, j] = v[:, j, i] = risk[dead, 1 + k + c] / risk[dead, 0] - mean[:, i] * mean[:, j]
    if transform == "log":
        g = np.log(times)
    elif transform == "rank":
        g = np.argsort(np.argsort(times)) + 1.0
    elif transform == "km":
        at_risk = np.cumsum(t["rows"].to_numpy(float))[dead]  # times run downwards
        upto = np.cumprod((1 - n / at_risk)[::-1])
        g = 1 - np.concatenate([[1.0], upto[:-1]])[::-1]  # the curve just before each time
    elif transform == "identity":
        g = times
    else:
        raise ValueError(f"no time transform {transform!r}")
    g = g - (g * n).sum() / n.sum()
    res = x - mean * n[:, None]
    u = (g[:, None] * res).sum(0)
    i11, i12, i22 = (n[:, None, None] * v).sum(0), ((g * n)[:, None, None] * v).sum(0), ((g * g * n)[:, None, None] * v).sum(0)
    full = i22 - i12 @ np.linalg.inv(i11) @ i12
    rows_out = [(name, float(u[i] ** 2 / full[i, i]), 1.0, dist.chi2_sf(float(u[i] ** 2 / full[i, i]), 1)) for i, name in enumerate(d.labels)]
    stat = float(u @ np.linalg.solve(full, u))
    return frame(df.sparkSession, [*rows_out, ("GLOBAL", stat, float(k), dist.chi2_sf(stat, k))], "term string, statistic double, df double, p_value double")
