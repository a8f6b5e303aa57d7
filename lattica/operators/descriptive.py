"""Descriptive statistics: moments, quantiles of all nine types, covariances and correlations."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.stages import cumulative_counts, with_ranks

NAN = float("nan")
FIVE = (0.0, 0.25, 0.5, 0.75, 1.0)


def number(c: str | Column) -> Column:
    """A column as double with NaN as null: the engine's form of a missing value."""
    c = F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.when(~F.isnan(c), c)


def complete(df: DataFrame, cols: list[str], na_action: str = "complete") -> DataFrame:
    """Rows by the missing-value policy: `complete` drops rows with any missing value, others keep all."""
    if na_action not in ("everything", "complete", "pairwise"):
        raise ValueError(f"na_action must be everything, complete or pairwise, not {na_action!r}")
    df = df.withColumns({c: number(c) for c in cols})
    return df.dropna(subset=cols) if na_action == "complete" else df


def _spoiled(value: Column, c: str, na_action: str) -> Column:
    """Under `everything` a missing value spoils the column's statistic."""
    return F.when(F.count(c) < F.count("*"), F.lit(NAN)).otherwise(value) if na_action == "everything" else value


def skewness_g1(c: str) -> Column:
    """Bias-adjusted skewness; null below three values or without spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_g2(c: str) -> Column:
    """Bias-adjusted excess kurtosis; null below four values or without spread."""
    n = F.count(c)
    return F.when((n > 3) & (F.var_pop(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def describe(df: DataFrame, cols: list[str], by: list[str] | None = None, na_action: str = "pairwise") -> DataFrame:
    """One row a column (and group): n, mean, var, sd, skewness, kurtosis, min, q1, median, q3, max.

    One aggregation; quantiles are exact (type 7).
    """
    df = complete(df, cols, na_action)

    def stats(c: str) -> Column:
        q = F.percentile(c, F.array(*(F.lit(p) for p in FIVE)))
        s = lambda v: _spoiled(v, c, na_action)
        return F.struct(
            F.lit(c).alias("variable"), F.count(c).alias("n"), s(F.avg(c)).alias("mean"), s(F.var_samp(c)).alias("var"), s(F.stddev_samp(c)).alias("sd"),
            s(skewness_g1(c)).alias("skewness"), s(kurtosis_g2(c)).alias("kurtosis"),
            *(s(q[i]).alias(name) for i, name in enumerate(("min", "q1", "median", "q3", "max"))),
        )

    grouped = df.groupBy(*(by or [])).agg(F.array(*(stats(c) for c in cols)).alias("s"))
    return grouped.select(*(by or []), F.explode("s").alias("s")).select(*(by or []), "s.*")


def summary(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Minimum, first quartile, median, mean, third quartile, maximum."""
    return describe(df, cols, by).select(*(by or []), "variable", "min", "q1", "median", "mean", "q3", "max")


def quantile_position(n: Column, p: float, kind: int) -> tuple[Column, Column]:
    """(j, weight of the value after the j-th) of a quantile type, positions from 1, with rounding slack."""
    fuzz = 4 * np.finfo(float).eps
    if kind in (1, 2, 3):
        nppm = n * p - (0.5 if kind == 3 else 0.0)
        j = F.floor(nppm + fuzz)
        at = F.abs(nppm - j) < fuzz * F.greatest(F.lit(1.0), nppm)
        if kind == 1:
            g = F.when(at, 0.0).otherwise(1.0)
        elif kind == 2:
            g = F.when(at, 0.5).otherwise(1.0)
        else:
            g = F.when(at & (j % 2 == 0), 0.0).otherwise(1.0)
        return j, g
    a, b = {4: (0, 1), 5: (0.5, 0.5), 6: (0, 0), 7: (1, 1), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}[kind]
    nppm = F.lit(a) + p * (n + 1 - a - b)
    j = F.floor(nppm + fuzz)
    h = nppm - j
    return j, F.when(F.abs(h) < fuzz, 0.0).otherwise(h)


def quantile(df: DataFrame, col: str, probs: tuple[float, ...] = FIVE, quantile_type: int | tuple[int, ...] = 7, by: list[str] | None = None) -> DataFrame:
    """(by, prob, value) for one of the nine sample quantile types, exact at any size; (by, kind, prob, value) for several.

    Order statistics are looked up in the cumulative counts of distinct values, which stay distributed.
    """
    kinds = (quantile_type,) if isinstance(quantile_type, int) else tuple(quantile_type)
    if any(not 1 <= kind <= 9 for kind in kinds) or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("quantile types are 1 to 9 and probabilities 0 to 1")
    by = by or []
    df = df.withColumn(col, number(col))
    counts = cumulative_counts(df, col, by)
    n = df.groupBy(*by).agg(F.count(col).alias("n"))
    spots = []
    for kind, p in ((kind, p) for kind in kinds for p in probs):
        j, g = quantile_position(F.col("n"), p, kind)
        lo = F.least(F.greatest(j, F.lit(1)), F.col("n"))
        spots.append(F.struct(F.lit(kind).alias("kind"), F.lit(float(p)).alias("prob"), lo.cast("long").alias("lo"), F.least(F.greatest(j + 1, F.lit(1)), F.col("n")).cast("long").alias("hi"), g.cast("double").alias("g")))
    wanted = n.where("n > 0").select(*by, F.explode(F.array(*spots)).alias("s")).select(*by, "s.*")
    ends = wanted.select(*by, "kind", "prob", "g", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("k")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("k")))).alias("e"))
    ends = ends.select(*by, "kind", "prob", "g", "e.*")
    match = (F.col("k") > F.col("before")) & (F.col("k") <= F.col("before") + F.col("count"))
    small = F.broadcast(ends.select(*(F.col(b).alias(f"_{b}") for b in by), "kind", "prob", "g", "end", "k"))  # two rows a type, probability and group
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_{b}"))
    hit = counts.join(small, match)
    pick = lambda e: F.max(F.when(F.col("end") == e, F.col("value")))
    return hit.groupBy(*by, "kind", "prob").agg(pick(0).alias("x0"), pick(1).alias("x1"), F.first("g").alias("g")).select(
        *by, *([] if isinstance(quantile_type, int) else ["kind"]), "prob", F.when(F.col("g") == 0, F.col("x0")).when(F.col("g") == 1, F.col("x1")).otherwise((1 - F.col("g")) * F.col("x0") + F.col("g") * F.col("x1")).alias("value")
    )


def _matrix(df: DataFrame, cols: list[str], cell, by: list[str] | None, name: str) -> DataFrame:
    pairs = list(combinations_with_replacement(cols, 2))
    both = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(a, b).alias(name), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")) for a, b in pairs]
    return df.groupBy(*(by or [])).agg(F.array(*both).alias("m")).select(*(by or []), F.explode("m").alias("m")).select(*(by or []), "m.*")


def cov(df: DataFrame, cols: list[str], by: list[str] | None = None, na_action: str = "complete") -> DataFrame:
    """Covariances (n - 1) of all pairs, upper triangle with diagonal: one aggregation."""
    df = complete(df, cols, na_action)
    return _matrix(df, cols, lambda a, b: _spoiled(_spoiled(F.covar_samp(a, b), a, na_action), b, na_action), by, "cov")


def cor(df: DataFrame, cols: list[str], by: list[str] | None = None, na_action: str = "complete", method: str = "pearson") -> DataFrame:
    """Pearson, Spearman or Kendall (tau-b) correlations of all pairs."""
    if method in ("spearman", "kendall") and na_action == "pairwise":
        parts = [cor(df.select(*(by or []), a, b).dropna(subset=[a, b]), [a, b], by, "complete", method).where((F.col("a") == a) & (F.col("b") == b)) for a, b in combinations_with_replacement(cols, 2) if a != b]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    df = complete(df, cols, na_action)
    if method == "kendall":
        return _kendall(df, cols, by)
    if method == "spearman":
        for c in cols:
            df = with_ranks(df, c, f"{c}__rank", by)
        ranked = df.drop(*cols).withColumnsRenamed({f"{c}__rank": c for c in cols})
        return _matrix(ranked, cols, lambda a, b: F.lit(1.0) if a == b else F.corr(a, b), by, "cor")
    if method != "pearson":
        raise ValueError(f"no correlation method {method!r}")
    one = lambda a, b: F.when(F.var_samp(a) > 0, 1.0) if a == b else F.corr(a, b)
    return _matrix(df, cols, lambda a, b: _spoiled(_spoiled(one(a, b), a, na_action), b, na_action), by, "cor")


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in O(n log n): discordant pairs by merge counting, ties by counts."""
    n = len(x)
    at = np.lexsort((y, x))
    x, y = x[at], y[at]
    y = np.unique(y, return_inverse=True)[1]
    ties = lambda *k: sum(c * (c - 1) // 2 for c in np.unique(np.column_stack(k), axis=0, return_counts=True)[1].tolist())
    total, tx, ty, txy = n * (n - 1) // 2, ties(x), ties(y), ties(x, y)
    swaps, block = 0, y.copy()
    width = 1
    while width < n:
        out = block.copy()
        for lo in range(0, n, 2 * width):
            left, right = block[lo : lo + width], block[lo + width : lo + 2 * width]
            if len(right):
                swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
                out[lo : lo + 2 * width] = np.sort(block[lo : lo + 2 * width], kind="stable")
        block, width = out, 2 * width
    den = np.sqrt(float(total - tx) * float(total - ty))
    return float((total - tx - ty + txy - 2 * swaps) / den) if den else NAN


def _kendall(df: DataFrame, cols: list[str], by: list[str] | None) -> DataFrame:
    """Tau-b a group: a group's rows meet in one task, as the statistic has no partial form."""
    pairs = [(a, b) for a, b in combinations_with_replacement(cols, 2)]
    keys = by or ["_all"]
    df = df if by else df.withColumn("_all", F.lit(0))
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, a, b, NAN if pdf[[a, b]].isna().any(axis=None) else 1.0 if a == b else kendall_tau_b(pdf[a].to_numpy(), pdf[b].to_numpy()), int(pdf[[a, b]].notna().all(axis=1).sum())) for a, b in pairs]
        return pd.DataFrame(rows, columns=[*keys, "a", "b", "cor", "n"])

    out = df.select(*keys, *cols).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", a string, b string, cor double, n long")
    return out if by else out.drop("_all")
