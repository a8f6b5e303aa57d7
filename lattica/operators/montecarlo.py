"""Bootstrap and permutation inference."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import dist
from lattica.operators.descriptive import number
from lattica.plans.finish import frame


def poisson_weight(row: Column, rep: Column, seed: int, top: int = 12) -> Column:
    """A Poisson(1) count from a hash of row and replicate: the same wherever and whenever a task runs."""
    u = F.shiftrightunsigned(F.xxhash64(row, rep, F.lit(seed)), 11).cast("double") / float(1 << 53)
    total, out = 0.0, None
    for k in range(top + 1):
        total += math.exp(-1) / math.factorial(k)
        out = F.when(u < total, F.lit(k)) if out is None else out.when(u < total, F.lit(k))
    return out.otherwise(F.lit(top + 1))


def boot_means(df: DataFrame, x: str, key: str, n_resamples: int = 200, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """Replicated means of any number of rows: each row counts Poisson(1) times a replicate, summed on the map side."""
    by = by or []
    v = number(x)
    d = df.where(v.isNotNull()).select(*by, v.alias("v"), F.col(key).alias("row"), F.explode(F.sequence(F.lit(1), F.lit(n_resamples))).alias("rep"))
    w = poisson_weight(F.col("row"), F.col("rep"), seed)
    return d.withColumn("w", w).groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("stat"))


def _replicates(spark, n: int, seed: int, one: Callable[[np.random.Generator], float]) -> DataFrame:
    """`one(rng)` for replicates 0 to n - 1; a replicate's stream depends on seed and number only."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["id"], "stat": [float(one(np.random.default_rng([seed, int(i)]))) for i in pdf["id"]]})

    return spark.range(0, n, 1, max(1, min(64, n // 50))).mapInPandas(run, "rep long, stat double")


BOOT_METHODS = ("ordinary", "balanced", "parametric")


def boot(
    df: DataFrame, cols: list[str], statistic: Callable[[np.ndarray], float], n_resamples: int = 999, seed: int = 1, method: str = "ordinary",
    max_rows: int = 1_000_000, strata: str | None = None, ran_gen: Callable[[np.ndarray, np.random.Generator], np.ndarray] | None = None,
) -> tuple[float, DataFrame]:
    """Any statistic of a sample of bounded size: (observed value, replicates). Replicates run across tasks.

    `ordinary` resamples rows, within each value of `strata` if that is given; `balanced` uses every row equally
    often over all replicates; `parametric` computes the statistic of what `ran_gen(data, generator)` draws.
    Raises above `max_rows` (use `boot_means` there) and for other methods.
    """
    if method not in BOOT_METHODS:
        raise ValueError(f"method must be one of {BOOT_METHODS}")
    if (method == "parametric") != (ran_gen is not None):
        raise ValueError("the parametric bootstrap, and only it, takes ran_gen")
    if strata and method != "ordinary":
        raise ValueError("only the ordinary bootstrap takes strata")
    spark = df.sparkSession
    picked = df.select(*(number(c).alias(f"v{i}") for i, c in enumerate(cols)), *([F.col(strata).alias("stratum")] if strata else []))
    n = picked.count()
    if n > max_rows:
        raise ValueError(f"{n} rows: this bootstrap ships the sample to each task, up to {max_rows}")
    pdf = picked.dropna().toPandas()
    data = pdf[[f"v{i}" for i in range(len(cols))]].to_numpy(float)
    groups = [np.asarray(g) for g in pdf.groupby("stratum").indices.values()] if strata else [np.arange(len(data))]
    shared = spark.sparkContext.broadcast(data)
    if method == "balanced":
        pool = np.random.default_rng(seed).permutation(np.tile(np.arange(len(data)), n_resamples)).reshape(n_resamples, -1) if len(data) * n_resamples <= 5_000_000 else None
        if pool is None:
            raise ValueError("a balanced pool of more than five million draws")

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"rep": pdf["id"], "stat": [float(statistic(shared.value[pool[int(i)]])) for i in pdf["id"]]})

        return float(statistic(data)), spark.range(0, n_resamples, 1, 8).mapInPandas(run, "rep long, stat double")

    def one(rng: np.random.Generator) -> float:
        if ran_gen is not None:
            return statistic(ran_gen(shared.value, rng))
        return statistic(shared.value[np.concatenate([g[rng.integers(0, len(g), len(g))] for g in groups])])

    return float(statistic(data)), _replicates(spark, n_resamples, seed, one)


def jackknife(df: DataFrame, x: str, statistic: Callable[[np.ndarray], float]) -> np.ndarray:
    """Influence values of a statistic by leaving out each row of a sample of bounded size."""
    v = df.select(number(x).alias("v")).dropna().toPandas()["v"].to_numpy()
    if len(v) > 20_000:
        raise ValueError("the jackknife takes up to 20000 rows")
    t = np.array([statistic(np.delete(v, i)[:, None]) for i in range(len(v))])
    return (len(v) - 1) * (t.mean() - t)


def boot_ci(observed: float, replicates: DataFrame, kind: str = "percentile", conf_level: float = 0.95, influence: np.ndarray | None = None) -> tuple[float, float]:
    """Normal, basic, percentile or BCa interval of replicates (`influence`: empirical influence or jackknife values, for BCa)."""
    t = np.sort(replicates.select("stat").toPandas()["stat"].to_numpy())
    a = (1 - conf_level) / 2

    def q(p: float) -> float:  # interpolation on the normal scale between order statistics
        k = (len(t) + 1) * p
        i = min(max(int(math.floor(k)), 1), len(t) - 1)
        if k == i or k <= 1 or k >= len(t):
            return float(t[min(max(int(round(k)), 1), len(t)) - 1])
        z0, z1, z = (dist.norm_ppf(v) for v in (i / (len(t) + 1), (i + 1) / (len(t) + 1), p))
        return float(t[i - 1] + (z - z0) / (z1 - z0) * (t[i] - t[i - 1]))

    if kind == "normal":
        half = dist.norm_ppf(1 - a) * t.std(ddof=1)
        mid = 2 * observed - t.mean()
        return mid - half, mid + half
    if kind == "basic":
        return 2 * observed - q(1 - a), 2 * observed - q(a)
    if kind == "percentile":
        return q(a), q(1 - a)
    if kind != "bca":
        raise ValueError(f"no interval {kind!r}")
    z0 = dist.norm_ppf(float((t < observed).mean()))
    acc = float((influence**3).sum() / (6 * (influence**2).sum() ** 1.5)) if influence is not None and (influence**2).sum() else 0.0
    adj = lambda p: dist.norm_cdf(z0 + (z0 + dist.norm_ppf(p)) / (1 - acc * (z0 + dist.norm_ppf(p))))
    return q(adj(a)), q(adj(1 - a))


#: Rows that a block of values holds about, and the rows that the generator's draws without replacement allow.
ROWS_PER_BLOCK, MOST_ROWS = 100_000, 1_000_000_000


def _relabelled_sums(d: DataFrame, n: int, n1: int, n_resamples: int, seed: int) -> DataFrame:
    """(rep, s): the sum of `v` over `n1` of the `n` rows drawn without replacement, for each replicate.

    Values are dealt into blocks by their hash, so blocks and draws don't depend on partitions. A replicate
    first draws how many of its rows each block gives, then each block draws them among its values' counts:
    together one uniform draw. A value of any frequency is one row, and no task sees all values.
    """
    blocks = max(1, n // ROWS_PER_BLOCK)
    counts = d.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), "v").agg(F.count("*").alias("n"))
    sizes = np.zeros(blocks, np.int64)
    for r in counts.groupBy("block").agg(F.sum("n").alias("n")).collect():  # one row a block
        sizes[r["block"]] = r["n"]

    def run(key, pdf):
        pdf = pdf.sort_values("v")
        v, c, b = pdf["v"].to_numpy(), pdf["n"].to_numpy(np.int64), int(key[0])
        sums = np.empty(n_resamples)
        for rep in range(n_resamples):
            share = np.random.default_rng([seed, rep]).multivariate_hypergeometric(sizes, n1)[b]
            sums[rep] = np.random.default_rng([seed, rep, b + 1]).multivariate_hypergeometric(c, share) @ v
        return pd.DataFrame({"rep": np.arange(n_resamples), "s": sums})

    return counts.groupBy("block").applyInPandas(run, "rep long, s double").groupBy("rep").agg(F.sum("s").alias("s"))


def permutation_test(df: DataFrame, x: str, group: str, groups: tuple, n_resamples: int = 999, alternative: str = "two-sided", seed: int = 1, statistic: Callable[[np.ndarray, np.ndarray], float] | None = None, max_rows: int = 5_000_000) -> DataFrame:
    """Difference of means (or any two-sample statistic) against random relabelling; (count + 1) / (R + 1), twice the smaller tail for two sides.

    The difference of means stays distributed, below a billion rows. Another statistic needs the sample in
    each task and raises above `max_rows`. Both groups need a row.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"no alternative {alternative!r}")
    spark = df.sparkSession
    d = df.where(F.col(group).isin(*groups)).select(number(x).alias("v"), (F.col(group) == groups[0]).alias("k")).dropna()
    n, n1, total, first = d.agg(F.count("*"), F.count_if("k"), F.sum("v"), F.sum(F.when(F.col("k"), F.col("v")))).first()
    if not 0 < n1 < n:
        raise ValueError("both groups need a row")
    most = max_rows if statistic else MOST_ROWS - 1
    if n > most:
        raise ValueError(f"{n} rows: this permutation test takes up to {most}")
    if statistic is None:
        mean = total / n  # sums are taken about it, so that they keep their digits
        centred = d.select((F.col("v") - F.lit(mean)).alias("v"))
        seen = (first - n1 * mean) * (1 / n1 + 1 / (n - n1))
        replicates = _relabelled_sums(centred, n, n1, n_resamples, seed).select((F.col("s") * (1 / n1 + 1 / (n - n1))).alias("stat"))
    else:
        pdf = d.orderBy("k", "v").toPandas()
        values = pdf["v"].to_numpy()
        shared = spark.sparkContext.broadcast(np.concatenate([values[pdf["k"]], values[~pdf["k"]]]))
        seen = float(statistic(shared.value[:n1], shared.value[n1:]))

        def one(rng):
            v = rng.permutation(shared.value)
            return statistic(v[:n1], v[n1:])

        replicates = _replicates(spark, n_resamples, seed, one)
    slack = 1e-12 * max(1.0, abs(seen))
    hits = replicates.agg(F.count_if(F.col("stat") >= seen - slack), F.count_if(F.col("stat") <= seen + slack)).first()
    up, down = ((h + 1) / (n_resamples + 1) for h in hits)
    p = {"greater": up, "less": down}.get(alternative, min(1.0, 2 * min(up, down)))
    return frame(spark, [(float(seen), p, n_resamples)], "statistic double, p_value double, n_resamples int")
