"""Closing algebra on result rows: aggregates stay in Spark, tails and small dense algebra run per result row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def finish(stats: DataFrame, keys: list[str], row: Callable[[dict], dict | list[dict]], schema: str) -> DataFrame:
    """Map every aggregate row (few: one a group) to one or more result rows after its keys.

    `schema` names the columns that `row` returns, as DDL.
    """
    types = {f.name: f.dataType.simpleString() for f in stats.schema}
    full = ", ".join([*(f"{k} {types[k]}" for k in keys), schema])
    names = [*keys, *StructType.fromDDL(schema).fieldNames()]

    def run(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                got = row(rec)
                out += [{**{k: rec[k] for k in keys}, **g} for g in (got if isinstance(got, list) else [got])]
            yield pd.DataFrame(out, columns=names)

    return stats.mapInPandas(run, full)


def frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small result table; numpy numbers become plain ones."""
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return spark.createDataFrame([tuple(plain(v) for v in r) for r in rows], schema)
