"""Exact top-k search by inner product: tiled matrix products and tree merging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, small_batches


def usable(vec: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantise(vec: Column, scale: int = 256) -> Column:
    """Integer components floor(scale * x), with x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def select(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best of one query's scores, ties to the smaller id: a partial selection."""
    if len(scores) > k:
        least = scores[np.argpartition(-scores, k - 1)[:k]].min()
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((own[at], -scores[at]))[:k]]


def tile_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices of long: in doubles where every sum stays below 2**53, else in Python integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    kind = np.float64 if top < 2**53 else object
    return (a.astype(kind) @ np.ascontiguousarray(b.astype(kind).T)).astype(np.int64)


class TopLists:
    """The best k candidates so far of every query of a block; candidates come shard by shard."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], k: int) -> None:
        self.k, self.ids = k, ids
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            self.by_size[n] = at, np.stack([vectors[i] for i in at]).reshape(len(at), n)
        empty = np.zeros(0, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(empty, empty)] * len(ids)  # candidate ids, scores

    def add(self, ids: np.ndarray, matrix: np.ndarray, queries: int = 256) -> None:
        """One shard of candidates of equal length: a tile for each `queries` queries, each tile's best merged in."""
        at, own = self.by_size.get(matrix.shape[1], (np.zeros(0, np.int64), matrix))
        for lo in range(0, len(at), queries):
            for i, row in zip(at[lo : lo + queries].tolist(), tile_scores(own[lo : lo + queries], matrix)):
                if len(self.best[i][0]) == self.k:  # only scores that reach the list's last can enter it
                    near = np.flatnonzero(row >= self.best[i][1].min())
                    if not len(near):
                        continue
                    some, scores = ids[near], row[near]
                else:
                    some, scores = ids, row
                other = some != self.ids[i]
                some, scores = np.concatenate([self.best[i][0], some[other]]), np.concatenate([self.best[i][1], scores[other]])
                top = select(scores, some, self.k)
                self.best[i] = some[top], scores[top]


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _tasks(df: DataFrame) -> int:
    """How many tasks read `df` (a narrow plan); the plan is made, nothing runs."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def exact_top_k(
    queries: DataFrame,
    candidates: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "vec",
    k: int = 5,
    block_bytes: int = 32 << 20,
    shard_rows: int = 4096,
    fan_in: int = 16,
) -> DataFrame:
    """For each query id its k best candidates by integer inner product, ties to the smaller id.

    Vectors are arrays of long. Queries are dealt by hash into blocks of about `block_bytes` (their sizes
    are counted); one block at a time is sent to all tasks, which read the candidates where they lie and
    compare shard by shard of `shard_rows` rows: a tile is one matrix product, of which each query keeps its best.
    Candidates are never shuffled; a task holds a block, a tile and k rows a query, whatever
    the tables' sizes, and gives k rows a query at its end. Those lists merge `fan_in` tasks at a time,
    level by level.

    Rows with a null id or vector, or with a null component, take no part. A candidate with the query's own
    id is not compared with it. Of repeated query rows one counts (the least vector, if they differ), repeated
    candidate rows count each. Vectors of another length than the query's are not compared. Empty tables
    give no rows; other columns are not read. Returns query_id, rank (from 1), the candidate's id, score.
    """
    spark = queries.sparkSession
    small_batches(spark)
    rows = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    )
    q = rows(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    c = rows(candidates)
    n, size = q.agg(F.count("*"), F.coalesce(F.sum(F.size("vec") * 8 + 64), F.lit(0))).first()
    blocks = max(1, math.ceil(size / block_bytes))
    if blocks > 1:
        q = cut(q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    tops = None
    for block in range(blocks if n else 0):
        own = (q.where(F.col("block") == block) if blocks > 1 else q).select("id", "vec").toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((own.column("id").to_numpy(), [np.array(v, np.int64) for v in _vectors(own.column("vec").combine_chunks())]))

        def tiles(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lists = TopLists(*sent.value, k)
            for batch in batches:
                for lo in range(0, batch.num_rows, shard_rows):
                    part = batch.slice(lo, shard_rows)
                    ids, vectors = part.column(0).to_numpy(), _vectors(part.column(1))
                    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
                    for d in np.unique(sizes).tolist():
                        at = np.flatnonzero(sizes == d)
                        lists.add(ids[at], np.stack([vectors[i] for i in at]).reshape(len(at), d).astype(np.int64))
            found = [(i, *best) for i, best in zip(lists.ids.tolist(), lists.best) if len(best[0])]
            for lo in range(0, len(found), 10_000):
                some = found[lo : lo + 10_000]
                ids = np.repeat([f[0] for f in some], [len(f[1]) for f in some])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, np.concatenate([f[1] for f in some]), np.concatenate([f[2] for f in some]))], ["query_id", "vec_id", "score"])

        found = c.mapInArrow(tiles, "query_id long, vec_id long, score long").withColumn("shard", F.spark_partition_id())
        tops = found if tops is None else tops.unionByName(found)
    if tops is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    pair = F.struct((-F.col("score")).alias("minus"), F.col("vec_id"))
    lists = tops.groupBy("query_id", "shard").agg(F.collect_list(pair).alias("best"))
    left = fan_in ** max(1, math.ceil(math.log(max(2, _tasks(c)), fan_in)))
    while True:
        left = math.ceil(left / fan_in)
        lists = lists.groupBy("query_id", (F.pmod(F.col("shard"), F.lit(left)) if left > 1 else F.lit(0)).alias("shard")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        )
        if left == 1:
            break
    ranked = lists.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias(id_col), (-F.col("hit.minus")).alias("score")
    )
