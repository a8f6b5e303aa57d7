"""Reading tables: CSV, TSV, Parquet, ORC, JSON and NPY, numbers checked and NaN taken as missing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_file(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A file or folder by its suffix; `columns` are pruned at the scan."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, sep="," if kind == "csv" else "\t")
    elif kind in ("parquet", "orc", "json"):
        df = getattr(spark.read, kind)(path)
    elif kind == "npy":
        raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
        import io

        a = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
        a = a.reshape(len(a), -1)
        df = spark.createDataFrame(pd.DataFrame(a, columns=[f"x{i}" for i in range(a.shape[1])]))
    else:
        raise ValueError(f"cannot read files of kind {kind!r}")
    return df.select(*columns) if columns else df


def from_arrays(spark: SparkSession, **columns) -> DataFrame:
    """Arrays of equal length as columns; a matrix gives a column for each of its own."""
    out: dict[str, np.ndarray] = {}
    for name, a in columns.items():
        a = np.asarray(a)
        if a.ndim == 2 and a.shape[1] > 1:
            out |= {f"{name}{i}": a[:, i] for i in range(a.shape[1])}
        else:
            out[name] = a.ravel()
    if len({len(a) for a in out.values()}) > 1:
        raise ValueError("the arrays differ in length")
    return missing_as_null(spark.createDataFrame(pd.DataFrame(out)))


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def validate(df: DataFrame, cols: list[str], min_rows: int = 1, finite: bool = True, varying: bool = False) -> DataFrame:
    """`df`, or ValueError if a column isn't numeric, holds infinities, is constant, or rows are too few: one aggregation."""
    for c in cols:
        if not isinstance(df.schema[c].dataType, NumericType):
            raise ValueError(f"{c} is not numeric")
    v = {c: F.col(c).cast("double") for c in cols}
    r = df.agg(F.count("*").alias("n"), *(F.sum((F.abs(x) == float("inf")).cast("int")).alias(f"i{k}") for k, x in enumerate(v.values())), *((F.min(x) < F.max(x)).alias(f"v{k}") for k, x in enumerate(v.values()))).first()
    if r["n"] < min_rows:
        raise ValueError(f"{r['n']} rows; {min_rows} are needed")
    for k, c in enumerate(cols):
        if finite and r[f"i{k}"]:
            raise ValueError(f"{c} holds infinite values")
        if varying and not r[f"v{k}"]:
            raise ValueError(f"{c} is constant")
    return df


def gaussian_table(spark: SparkSession, n: int, mean: list[float], cov: list[list[float]], seed: int = 1) -> DataFrame:
    """n rows of correlated normal columns x0, x1, ...: independent draws mixed by a Cholesky factor."""
    c = np.linalg.cholesky(np.array(cov, float))
    z = spark.range(n).select("id", *(F.randn(seed + i).alias(f"z{i}") for i in range(len(mean))))
    return z.select("id", *((F.lit(float(mean[i])) + sum((F.col(f"z{j}") * float(c[i, j]) for j in range(i + 1)), F.lit(0.0))).alias(f"x{i}") for i in range(len(mean))))
