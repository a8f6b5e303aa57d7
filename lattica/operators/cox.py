"""Cox regression on ranges of time: strata, delayed entry, case weights, ties, robust variance.

A Newton step sums the risk-set moments of each distinct time in Spark. Times are dealt into ranges once;
a range starts from the totals of the later ranges of its stratum, so no task sees all times. Within a tie
only six numbers a death are formed, in blocks, whatever the number of covariates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions import dist
from lattica.functions.design import build
from lattica.operators.regression import Fit

#: Distinct times (of a stratum) a range holds about.
TIMES_PER_RANGE = 200_000
#: Deaths of ties that are spread out at once.
DEATHS_PER_BLOCK = 1_000_000
#: Rows of the table of hazards that are broadcast at most.
BROADCAST_TIMES = 100_000


def _ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with `part`, the range of (stratum, time) they fall into by the ranges' lower ends, and the number of ranges."""
    times = rows.select("st", "t").distinct()
    parts = max(1, -(-times.count() // TIMES_PER_RANGE))
    if parts == 1:
        return rows.withColumn("part", F.lit(0)), 1
    low = times.repartitionByRange(parts, "st", "t").groupBy(F.spark_partition_id()).agg(F.min(F.struct("st", "t")).alias("low")).select("low.*").collect()  # one row a range
    ends = F.array(*(F.struct(F.lit(r["st"]).alias("st"), F.lit(r["t"]).alias("t")) for r in low))
    return rows.withColumn("part", F.size(F.filter(ends, lambda end: end <= F.struct("st", "t"))) - 1), len(low)


def _with_shift(sums: DataFrame, cols: list[str], later: bool) -> DataFrame:
    """`sums` with `s_<col>`: the totals of its stratum's later (or earlier) ranges; the window sees one row a range."""
    over = Window.partitionBy("st").orderBy(F.desc("part") if later else F.col("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = sums.groupBy("st", "part").agg(*(F.sum(c).alias(c) for c in cols))
    return sums.join(totals.select("st", "part", *(F.coalesce(F.sum(c).over(over), F.lit(0.0)).alias(f"s_{c}") for c in cols)), ["st", "part"])


def _running(values: np.ndarray, strata: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Running sums down the rows within each run of equal strata, starting from the run's shift."""
    out = np.empty_like(values)
    edges = [0, *(np.flatnonzero(strata[1:] != strata[:-1]) + 1), len(strata)]
    for lo, hi in zip(edges, edges[1:]):
        out[lo:hi] = np.cumsum(values[lo:hi], axis=0) + shift[lo]
    return out


def _tie_sums(s0: np.ndarray, d0: np.ndarray, n: np.ndarray, efron: bool) -> np.ndarray:
    """Per time, over its deaths m = 0 .. n - 1 with f = m / n (Efron; 0 for Breslow) and v = s0 - f d0: the sums of log v, 1/v, f/v, 1/v2, f/v2, f2/v2."""
    out, ends = np.zeros((len(n), 6)), np.cumsum(n)
    for lo in range(0, int(ends[-1]) if len(n) else 0, DEATHS_PER_BLOCK):
        death = np.arange(lo, min(lo + DEATHS_PER_BLOCK, int(ends[-1])))
        at = np.searchsorted(ends, death, "right")
        f = (death - (ends[at] - n[at])) / n[at] if efron else np.zeros(len(death))
        v = s0[at] - f * d0[at]
        for c, x in enumerate((np.log(v), 1 / v, f / v, 1 / v**2, f / v**2, f * f / v**2)):
            out[:, c] += np.bincount(at, x, len(n))
    return out


class _Partial:
    """The partial likelihood of some rows: its value, score and information at given coefficients, and hazards by time."""

    def __init__(self, rows: DataFrame, k: int, efron: bool, entry: bool):
        self.rows, self.k, self.efron, self.entry = rows, k, efron, entry
        self.means = np.zeros(k)
        self.tri = [(i, j) for i in range(k) for j in range(i, k)]
        self.q = 1 + k + len(self.tri)
        self.n_sums = 2 * self.q + 3 + k

    def __getstate__(self) -> dict:
        """What tasks need: everything but the tables."""
        return {name: v for name, v in vars(self).items() if name not in ("rows", "spread")}

    def prepare(self) -> None:
        """Centre covariates, deal times into ranges and keep the rows; a row enters the sums once, or twice with an entry time."""
        self.means = np.array([float(v or 0.0) for v in self.rows.agg(*(F.avg(f"x{i}") for i in range(self.k))).first()])
        spread = self.rows.withColumn("sign", F.lit(1.0))
        if self.entry:
            leave = F.struct(F.col("t").alias("t"), F.lit(1.0).alias("sign"), F.col("e").alias("e"))
            enter = F.struct(F.col("start").alias("t"), F.lit(-1.0).alias("sign"), F.lit(0.0).alias("e"))
            spread = self.rows.withColumn("s", F.explode(F.array(leave, enter))).select("st", "wt", *(f"x{i}" for i in range(self.k)), "s.*")
        spread, self.n_parts = _ranges(spread.drop("start", "cluster"))
        self.spread = spread.persist()

    def close(self) -> None:
        self.spread.unpersist()

    def eta(self, beta: np.ndarray):
        return sum((F.lit(float(b)) * (F.col(f"x{i}") - float(self.means[i])) for i, b in enumerate(beta)), F.lit(0.0))

    def by_time(self, beta: np.ndarray) -> DataFrame:
        """(st, part, t, a0 ..): moments of rows at risk until t, then deaths, their weight, their part of the likelihood and score, their moments."""
        z = [F.col(f"x{i}") - float(self.means[i]) for i in range(self.k)]
        w, e = F.col("w"), F.col("e")
        weigh = [w, *(w * v for v in z), *(w * z[i] * z[j] for i, j in self.tri)]
        sums = [F.col("sign") * c for c in weigh] + [e, e * F.col("wt"), e * F.col("wt") * F.col("eta"), *(e * F.col("wt") * v for v in z)] + [e * c for c in weigh]
        rows = self.spread.withColumn("eta", self.eta(beta)).withColumn("w", F.col("wt") * F.exp("eta"))
        t = rows.groupBy("st", "part", "t").agg(*(F.sum(c).alias(f"a{i}") for i, c in enumerate(sums)))
        return _with_shift(t, [f"a{i}" for i in range(self.q)], later=True) if self.n_parts > 1 else t

    def _deaths(self, pdf: pd.DataFrame):
        """Rows of a range by stratum and falling time; of those with deaths the sums at risk, own sums, mean weight and tie sums."""
        q, pdf = self.q, pdf.sort_values(["st", "t"], ascending=[True, False])
        a = pdf[[f"a{i}" for i in range(self.n_sums)]].to_numpy(float)
        shift = pdf[[f"s_a{i}" for i in range(q)]].to_numpy(float) if self.n_parts > 1 else np.zeros((len(a), q))
        dead = a[:, q] > 0
        risk = _running(a[:, :q], pdf["st"].to_numpy(), shift)[dead]
        own, n = a[dead, q + 3 + self.k :], np.rint(a[dead, q]).astype(np.int64)
        return pdf, dead, a[dead], risk, own, a[dead, q + 1] / n, _tie_sums(risk[:, 0], own[:, 0], n, self.efron)

    def _matrices(self, v: np.ndarray) -> np.ndarray:
        m = np.zeros((len(v), self.k, self.k))
        for c, (i, j) in enumerate(self.tri):
            m[:, i, j] = m[:, j, i] = v[:, 1 + self.k + c]
        return m

    def __call__(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        k, q = self.k, self.q

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            _, _, a, risk, own, weight, tie = self._deaths(pdf)
            log, r, fr, rr, frr, ffrr = tie.T
            s1, d1 = risk[:, 1 : 1 + k], own[:, 1 : 1 + k]
            ll = a[:, q + 2].sum() - weight @ log
            score = a[:, q + 3 : q + 3 + k].sum(0) - weight @ (s1 * r[:, None] - d1 * fr[:, None])
            cross = (s1 * (weight * frr)[:, None]).T @ d1
            info = np.einsum("t,tij->ij", weight * r, self._matrices(risk)) - np.einsum("t,tij->ij", weight * fr, self._matrices(own))
            info -= (s1 * (weight * rr)[:, None]).T @ s1 - cross - cross.T + (d1 * (weight * ffrr)[:, None]).T @ d1
            return pd.DataFrame({"v": [[ll, *score, *info.ravel()]]})

        got = self.by_time(beta).groupBy("part").applyInPandas(part, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(1 + k + k * k)
        out[got["i"].to_numpy()] = got["x"].to_numpy()
        return out[0], out[1 : 1 + k], out[1 + k :].reshape(k, k)

    def hazards(self, beta: np.ndarray) -> DataFrame:
        """(st, t, c, own): running sums of the hazard and of hazard times mean up to t, and t's own sums.

        `own` holds t's hazard and its product with the mean, both again as those who die at t meet them, and
        the deaths' average mean.
        """
        k = self.k

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, dead, a, risk, own, weight, tie = self._deaths(pdf)
            _, r, fr, rr, frr, ffrr = tie.T
            s1, d1 = risk[:, 1 : 1 + k], own[:, 1 : 1 + k]
            full = [weight * r, *(weight[:, None] * (s1 * rr[:, None] - d1 * frr[:, None])).T]
            dying = [weight * (r - fr), *(weight[:, None] * (s1 * (rr - frr)[:, None] - d1 * (frr - ffrr)[:, None])).T]
            v = np.zeros((len(pdf), 2 + 3 * k))
            v[dead] = np.column_stack([*full, *dying, (s1 * r[:, None] - d1 * fr[:, None]) / a[:, self.q][:, None]])
            v, at = v[::-1], pdf[["st", "part", "t"]].iloc[::-1].reset_index(drop=True)
            c = _running(v[:, : 1 + k], at["st"].to_numpy(), np.zeros((len(v), 1 + k)))
            return at.assign(c=c.tolist(), own=v.tolist())

        h = self.by_time(beta).groupBy("part").applyInPandas(part, "st string, part int, t double, c array<double>, own array<double>")
        flat = h.select("st", "part", "t", *(F.col("c")[i].alias(f"c{i}") for i in range(1 + k)), *(F.col("own")[i].alias(f"o{i}") for i in range(2 + 3 * k)))
        if self.n_parts == 1:
            return flat.drop("part")
        totals = flat.groupBy("st", "part").agg(*(F.sum(f"o{i}").alias(f"p{i}") for i in range(1 + k)))
        over = Window.partitionBy("st").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        shift = totals.select("st", "part", *(F.coalesce(F.sum(f"p{i}").over(over), F.lit(0.0)).alias(f"p{i}") for i in range(1 + k)))
        return flat.join(shift, ["st", "part"]).withColumns({f"c{i}": F.col(f"c{i}") + F.col(f"p{i}") for i in range(1 + k)}).drop("part", *(f"p{i}" for i in range(1 + k)))


def _robust(rows: DataFrame, partial: _Partial, beta: np.ndarray, cov: np.ndarray, clustered: bool) -> tuple[np.ndarray, int]:
    """The sandwich variance from weighted score residuals summed by cluster, and the number of clusters."""
    k = partial.k
    h = partial.hazards(beta).persist()
    try:
        small = h.count() <= BROADCAST_TIMES
        side = F.broadcast if small else (lambda d: d)
        met = rows.withColumn("risk", F.exp(partial.eta(beta))).join(side(h), ["st", "t"])
        if partial.entry:
            gone = h.select("st", F.col("t").alias("start"), *(F.col(f"c{i}").alias(f"g{i}") for i in range(1 + k)))
            met = met.join(side(gone), ["st", "start"])
        before = lambda i: F.col(f"g{i}") if partial.entry else F.lit(0.0)
        e = F.col("e")
        # Hazard met from entry to exit; those who die at t meet their share of its ties.
        lived = [F.col(f"c{i}") - before(i) + e * (F.col(f"o{1 + k + i}") - F.col(f"o{i}")) for i in range(1 + k)]
        z = [F.col(f"x{i}") - float(partial.means[i]) for i in range(k)]
        residual = [F.col("wt") * (e * (z[i] - F.col(f"o{2 + 2 * k + i}")) - F.col("risk") * (z[i] * lived[0] - lived[1 + i])) for i in range(k)]
        u = met.select("cluster", *(r.alias(f"u{i}") for i, r in enumerate(residual)))
        if clustered:
            u = u.groupBy("cluster").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(k)))
        got = u.agg(F.count("*"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i, j in partial.tri)).first()
    finally:
        h.unpersist()
    meat = np.zeros((k, k))
    for v, (i, j) in zip(got[1:], partial.tri):
        meat[i, j] = meat[j, i] = v
    return cov @ meat @ cov, got[0]


def coxph(
    df: DataFrame, time: str, event: str, terms: list, strata: str | None = None, ties: str = "efron", tol: float = 1e-9, max_iter: int = 20,
    start: str | None = None, weights: str | None = None, cluster: str | None = None, robust: bool | None = None,
) -> Fit:
    """Cox regression by Newton steps on the partial likelihood; rows of subjects never leave the executors.

    `start`: at risk from after that time until `time` (start before time). `weights`: positive case weights.
    `cluster` (or `robust`): the sandwich variance of score residuals summed by cluster (or row); the model's
    own is kept as `naive_cov`. `infinite` lists coefficients that the likelihood still drives outwards.
    Rows with a missing value are left out.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError("ties are efron or breslow")
    d = build(df, terms, intercept=False)
    k = len(d.columns)
    robust = bool(cluster) if robust is None else robust
    num = lambda c: F.col(c).cast("double")
    picked = [
        (F.col(strata).cast("string") if strata else F.lit("")).alias("st"), num(time).alias("t"), num(event).alias("e"), (num(weights) if weights else F.lit(1.0)).alias("wt"),
        *(c.cast("double").alias(f"x{i}") for i, c in enumerate(d.columns)),
    ]
    picked += [num(start).alias("start")] if start else []
    picked += [(F.col(cluster) if cluster else F.lit(0)).alias("cluster")] if robust else []
    rows = df.select(*picked).dropna().persist()
    partial = _Partial(rows, k, ties == "efron", bool(start))
    try:
        n, events, bad, light = (int(v or 0) for v in rows.agg(F.count("*"), F.sum("e"), F.count_if(F.col("start") >= F.col("t")) if start else F.lit(0), F.count_if(F.col("wt") <= 0)).first())
        if bad or light:
            raise ValueError("weights must be positive" if light else "every start must lie before its time")
        if not events:
            raise ValueError("no events")
        partial.prepare()
        beta, (ll, score, info) = np.zeros(k), partial(np.zeros(k))
        first, first_score, first_info, converged = ll, score, info, False
        for it in range(1, max_iter + 1):
            move = np.linalg.lstsq(info, score, rcond=None)[0]
            new = partial(beta + move)
            while not new[0] >= ll - 1e-10 * abs(ll) and np.abs(move).max() >= 1e-12:
                move = move / 2
                new = partial(beta + move)
            beta, converged = beta + move, abs(new[0] - ll) <= tol * abs(new[0])
            ll, score, info = new
            if converged:
                break
        cov = np.linalg.pinv(info)
        left = np.abs(cov @ score)
        infinite = [name for name, s, b in zip(d.labels, left, beta) if not np.isfinite(s) or s > max(tol, tol**0.5 * abs(b))]
        lr, rank = 2 * (ll - first), k
        more = {"log_lik": ll, "log_lik_null": first, "lr": lr, "lr_p_value": dist.chi2_sf(max(lr, 0.0), rank), "score_test": float(first_score @ np.linalg.lstsq(first_info, first_score, rcond=None)[0])}
        more |= {"wald": float(beta @ info @ beta), "events": events, "iterations": it, "converged": bool(converged), "infinite": infinite}
        if robust:
            more["naive_cov"] = cov
            cov, more["clusters"] = _robust(rows, partial, beta, cov, bool(cluster))
    finally:
        if hasattr(partial, "spread"):
            partial.close()
        rows.unpersist()
    return Fit(d.labels, beta, np.sqrt(np.diag(cov)), cov, n, n - k, 1.0, more, use_t=False)
