"""Every query with SQL against DuckDB on the small tables, and the contract of the entry point."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lattica.plans.queries import ORACLES, QUERIES
from lattica.sources.load import from_arrays, from_file, validate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(pdf):
    show = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(tuple(show(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2.5\n3\t\n")
    assert from_file(spark, str(tmp_path / "a.tsv"), ["y"]).collect()[0].y == 2.5
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert from_file(spark, str(tmp_path / "m.npy")).columns == ["x0", "x1"]
    df = from_arrays(spark, X=np.ones((4, 2)), y=np.array([1.0, np.nan, 3.0, 4.0]))
    assert df.columns == ["X0", "X1", "y"] and df.where("y is null").count() == 1
    with pytest.raises(ValueError):
        validate(df, ["X0"], varying=True)
    with pytest.raises(ValueError):
        from_file(spark, str(tmp_path / "a.xyz"))


def test_stream_equals_batch(spark, tmp_path):
    from lattica.streaming.moments import read_events, windowed_moments

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = windowed_moments(read_events(spark, str(tmp_path / "in"), events.schema), "ts", "value", ["event_type"], "1 day")
    job = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    assert job.awaitTermination(120)
    batch = windowed_moments(events, "ts", "value", ["event_type"], "1 day")
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.mean, 9)) for r in rows)
    assert key(spark.table("running").collect()) == key(batch.collect())
