"""Model terms as Spark columns: numeric columns, coded factors, interactions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class C:
    """A categorical column; levels sort as strings and the first, or `ref`, is the baseline."""

    name: str
    ref: str | None = None
    coding: str = "dummy"


@dataclass(frozen=True)
class Design:
    """Columns of the design matrix with labels, and for each the number of its term (0: intercept)."""

    columns: list[Column]
    labels: list[str]
    assign: list[int]
    terms: list[str]


def levels(df: DataFrame, name: str) -> list[str]:
    return [r[0] for r in df.where(F.col(name).isNotNull()).select(F.col(name).cast("string")).distinct().orderBy(F.col(name).cast("string")).collect()]


def encode(df: DataFrame, factor: C) -> list[tuple[str, Column]]:
    """Treatment columns (baseline left out) or sum-to-zero columns (last level is -1)."""
    lv, s = levels(df, factor.name), F.col(factor.name).cast("string")
    known = lambda v: F.when(s.isNotNull(), v)
    if factor.coding == "dummy":
        base = factor.ref if factor.ref is not None else lv[0]
        if base not in lv:
            raise ValueError(f"{base!r} is not a level of {factor.name}")
        return [(f"{factor.name}[{v}]", known(F.when(s == v, 1.0).otherwise(0.0))) for v in lv if v != base]
    return [(f"{factor.name}[{v}]", known(F.when(s == v, 1.0).when(s == lv[-1], -1.0).otherwise(0.0))) for v in lv[:-1]]


def build(df: DataFrame, terms: list, intercept: bool = True) -> Design:
    """Design of terms: a column name, C(...), or a tuple of those as their interaction (first varies fastest)."""
    cols, labels, assign, names = ([F.lit(1.0)], ["(Intercept)"], [0], ["(Intercept)"]) if intercept else ([], [], [], [])
    block = lambda t: encode(df, t) if isinstance(t, C) else [(t, F.col(t).cast("double"))]
    for k, term in enumerate(terms, 1):
        parts = [block(t) for t in (term if isinstance(term, tuple) else (term,))]
        for combo in product(*reversed(parts)):
            combo = combo[::-1]
            col = combo[0][1]
            for _, c in combo[1:]:
                col = col * c
            cols.append(col)
            labels.append(":".join(n for n, _ in combo))
            assign.append(k)
        names.append(":".join(t.name if isinstance(t, C) else t for t in (term if isinstance(term, tuple) else (term,))))
    return Design(cols, labels, assign, names)
