"""Running statistics over streams: windowed moments and simple regressions with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, on a time with zone as watermarks need; a table as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_moments(events: DataFrame, time: str, value: str, by: list[str] | None = None, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, by, n, mean, var, min, max) of a stream or table; state is a few sums a window and key."""
    v = F.col(value).cast("double")
    span: Column = F.window(time, width, slide) if slide else F.window(time, width)
    rows = _timed(events, time, late)
    return rows.groupBy(span.alias("w"), *(by or [])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "mean", "var", "min", "max")


def windowed_regression(events: DataFrame, time: str, x: str, y: str, by: list[str] | None = None, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Slope and intercept of y on x in each window, from five sums."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = _timed(events, time, late)
    return rows.groupBy(F.window(time, width).alias("w"), *(by or [])).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept")
    ).select(F.col("w.start").alias("start"), *(by or []), "n", "slope", "intercept")


def read_events(spark, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
