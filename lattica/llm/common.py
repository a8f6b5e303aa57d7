"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows and, but for a single longer one, `size` bytes of a text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(total, total[at] + size, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of `size` bytes at most for this session, unless it has a setting of its own: the default lets a batch of texts reach 64 MB in the engine and again in the worker."""
    if spark.conf.get(BATCH_BYTES, "67108864b") == "67108864b":
        spark.conf.set(BATCH_BYTES, size)


def give_back() -> None:
    """Return what a worker has freed to the system, since it waits for further tasks beside others."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, keep: Sequence[str], text_col: str, added: str, read: Callable[[], Callable[[list], list[pa.Array]]], rows: int = 512) -> DataFrame:
    """The columns `keep` of `df` and those of the schema `added`, which what `read` returns makes of a list of texts; one narrow pass.

    Columns travel under names of their own, so none can clash with the added ones inside; the caller
    sees to it that the names of the result differ. `read` is called once in every task.
    """
    small_batches(df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [f"c{i}" for i in range(len(keep))]
    new = [part.split()[0] for part in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = read()
        for batch in batches:
            for b in slices(batch, len(names), rows):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *work(b.column(len(names)).to_pylist())], [*names, *new])
        give_back()

    sent = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).cast("string").alias("text"))
    out = sent.mapInArrow(run, ", ".join([*(f"{n} {types[c]}" for c, n in zip(keep, names)), added]))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *new)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one is made only in local mode where none is set (tests)."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and continue from there.

    The files are replicated by the store, so a lost executor costs a reread and not a
    recomputation, and a result that two branches use is computed once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables as Parquet in the shared checkpoint folder: compressed, and of known size to the planner.

    For operators with many rounds; a table that no later step reads is dropped at once, the rest when
    the driver's file system closes.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n = spark, f"{ensure_checkpoint_dir(spark)}/lattica-{uuid.uuid4().hex}", 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` written and reread; `rows` of the result is its number of rows, counted while writing."""
        path, seen = f"{self.base}/{self.n}", Observation()
        self.n += 1
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._rows = seen.get["rows"]
        self.paths[id(out)] = path
        out._kept_by = self  # the object stays, so its id does
        return out

    @staticmethod
    def rows(df: DataFrame) -> int:
        return df._rows

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                self.fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
