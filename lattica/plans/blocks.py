"""Sums of per-block numpy statistics: the one way iterative models read data.

Each task folds its Arrow batches into one small vector; vectors are summed by position in Spark, so
the driver gets one vector whatever the number of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]) if batch.num_rows else np.zeros((0, batch.num_columns))


def block_sum(df: DataFrame, cols: list, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of `fold(X)`, X a block's rows of `cols` (names or Columns) as double, rows with missing values left out."""
    picked = [F.col(c) if isinstance(c, str) else c for c in cols]
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(picked))).dropna()

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = np.asarray(fold(_matrix(b)), float).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return total(rows.mapInArrow(run, "v array<double>"))


def total(vectors: DataFrame) -> np.ndarray:
    """Sum by position of the rows' vectors `v`."""
    sums = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(len(sums))
    out[sums["i"].to_numpy()] = sums["x"].to_numpy()
    return out


def equal_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, first): numbers of the distinct rows of `keys`, and for each a row that has it."""
    code = np.zeros(len(keys), np.int64)
    for col in keys.T:
        if (col == col[0]).all():
            continue
        u, at = np.unique(col, return_inverse=True)
        code = np.unique(code * len(u) + at, return_inverse=True)[1] if code.any() else at
    first = np.zeros(int(code.max()) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def collapse(df: DataFrame, cols: list, fold: Callable[[np.ndarray], np.ndarray], names: list[str], hold: int = 1 << 16) -> DataFrame:
    """Rows of `fold` over blocks of `cols` (as double, without missing values), folded again in each task while that shortens them.

    `fold` maps a matrix to one with `names` as columns, and such a matrix to a shorter one. Nothing is shuffled; rows
    that don't repeat pass through, `hold` at a time.
    """
    picked = [F.col(c) if isinstance(c, str) else c for c in cols]
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(picked))).dropna()
    send = lambda m: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[:, i])) for i in range(len(names))], names)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(fold(_matrix(b)))
                size += len(held[-1])
            if size > hold:
                held = [fold(np.vstack(held))]
                size = len(held[0])
                if size > hold // 2:
                    yield send(held[0])
                    held, size = [], 0
        if size:
            yield send(fold(np.vstack(held)))

    return rows.mapInArrow(run, ", ".join(f"{n} double" for n in names))


def tsqr(df: DataFrame, cols: list, fan_in: int = 64) -> np.ndarray:
    """R factor of the rows of `cols`: QR in each task, then of stacked factors, `fan_in` at a time."""
    picked = [F.col(c) if isinstance(c, str) else c for c in cols]
    k = len(picked)
    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(picked))).dropna()

    def factor(batches):
        r = np.zeros((0, k))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, _matrix(b)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.mapInArrow(factor, "v array<double>").withColumn("g", (F.spark_partition_id() / fan_in).cast("int"))

    def merge(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.vstack([np.array(v).reshape(-1, k) for v in table.column("v").to_pylist()]), mode="r")
        return pa.table({"v": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    got = parts.groupBy("g").applyInArrow(merge, "v array<double>").collect()
    if not got:
        return np.zeros((0, k))
    r = np.linalg.qr(np.vstack([np.array(x[0]).reshape(-1, k) for x in got]), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if r.shape[0] == k else r
