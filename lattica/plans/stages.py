"""Cutting plans, distributed order and ranks: what several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def settle(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder (a temporary one is made only in local mode where none is set)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return df.checkpoint(eager=True)


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", small: bool = False) -> DataFrame:
    """`left` joined with `right` on `keys`, of which nulls meet nulls; `small`: `right` is broadcast."""
    right = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_same_{k}"]) for k in keys]
    return left.join(F.broadcast(right) if small else right, on, how).drop(*(f"_same_{k}" for k in keys))


def ordered_values(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, count, part, before, total): how often each value occurs, how many rows lie below it, all rows of the family.

    Equal values are summed on the map side; the distinct ones are range-partitioned, counted within
    each partition (`part`, in their order) and shifted by the partitions before. No task sees all values,
    and a value of any frequency is one row. Rows whose `by` is null are a family too.
    """
    by = by or []
    freq = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(F.count("*").alias("count"))
    ranged = settle(freq.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "part").agg(F.sum("count").alias("n"))
    family = Window.partitionBy(*(by or [F.lit(0)]))
    over = family.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*by, "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("shift"), F.sum("n").over(family).alias("total"))
    before = F.col("shift") + F.coalesce(F.sum("count").over(inside), F.lit(0))
    return same(ranged, shift, [*by, "part"], small=not by).withColumn("before", before).drop("shift")


def running_extremes(df: DataFrame, by: list[str], **down: tuple) -> DataFrame:
    """Rows of `ordered_values` with further columns: name=(column, descending, function) gives the function (F.min or F.max) of all values up to each row's.

    Partitions are taken apart; the extremes of those before join them.
    """
    inside = Window.partitionBy(*by, "part")
    parts = df.groupBy(*by, "part").agg(*(f(c).alias(f"_{n}") for n, (c, _, f) in down.items()))
    family = Window.partitionBy(*(by or [F.lit(0)]))
    way = lambda c, desc: F.desc(c) if desc else F.asc(c)
    past = parts.select(*by, "part", *(f(f"_{n}").over(family.orderBy(way("part", desc)).rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{n}") for n, (_, desc, f) in down.items()))
    out = same(df, past, [*by, "part"], small=not by)
    pick = {F.min: F.least, F.max: F.greatest}  # both pass over null: the first partition has none before it
    return out.withColumns({n: pick[f](f(c).over(inside.orderBy(way("value", desc)).rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_{n}")) for n, (c, desc, f) in down.items()}).drop(*(f"_{n}" for n in down))


def cumulative_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, count, before): how often each value occurs and how many rows lie below it; see `ordered_values`."""
    return ordered_values(df, col, by).select(*(by or []), "value", "count", "before")


def with_ranks(df: DataFrame, col: str, out: str, by: list[str] | None = None) -> DataFrame:
    """`df` with average ranks of `col` (null stays null), joined by value."""
    by = by or []
    ranks = cumulative_counts(df, col, by).select(*(F.col(b).alias(f"_{b}") for b in by), "value", (F.col("before") + (F.col("count") + 1) / 2).alias(out))
    match = F.col(col) == F.col("value")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return df.join(ranks, match, "left").drop("value", *(f"_{b}" for b in by))


def running_sums(df: DataFrame, order: str, *cols: str) -> DataFrame:
    """`df` with `<col>_sum`, the sum of `col` up to and including each row by `order` (distinct values).

    Range partitions are summed apart and shifted by the totals of those before.
    """
    ranged = settle(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in cols))
    over = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_part", *(F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in cols))
    out = ranged.join(F.broadcast(shift), "_part")  # one row a partition
    return out.withColumns({f"{c}_sum": F.sum(c).over(inside) + F.col(f"_{c}") for c in cols}).drop("_part", *(f"_{c}" for c in cols))
