"""Histogram sort into byte-balanced shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import cut

#: Bits that each level of probing adds, and levels on each of the two hashes of the key.
BITS, LEVELS = 6, 10


def _digit() -> str:
    """SQL for the next digit of a row's key, by the level `at` that its bin is probed at."""
    parts = []
    for level in range(2 * LEVELS):
        key, shift = ("h1", level) if level < LEVELS else ("h2", level - LEVELS)
        parts.append(f"when {level} then shiftrightunsigned({key}, {64 - BITS * (shift + 1)}) & {(1 << BITS) - 1}")
    return f"cast(case at {' '.join(parts)} end as int)"


def _name(place: tuple[int, ...]) -> str:
    return "".join(f"{x:02d}" for x in place)


def _place(name: str) -> tuple[int, ...]:
    return tuple(int(name[i : i + 2]) for i in range(0, len(name), 2))


def histogram_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    tolerance: float = 0.001,
    bins: int = 1024,
    bin_rows: int = 250_000,
    most_bins: int = 1 << 16,
) -> DataFrame:
    """Sort rows by (hash of text, hash of id) into `shards` ranges of nearly equal bytes.

    Equal texts lie beside each other, so a group is cut only where a boundary must fall into it.
    The key space is probed in rounds: each counts the exact bytes and rows below the boundaries of
    64 parts of every bin still open, summed on the map side.  A bin stays open while it holds more
    than 1/`bins` of all bytes or rows, or a splitter and more than `tolerance` of a shard's share;
    one whose rows all share the first hash is next probed by the second, so that the largest group
    of copies is split too.  `bins` grows with the table so that a bin has about `bin_rows` rows, up to
    `most_bins`; there are at most about 64 * 2 * `most_bins` counts on the driver.  Rows' bins are
    written anew every four rounds, so that plans stay short.  Then rows move once, to their bin; the rank
    there plus the rows of the shard's bins before it give every row its slot.

    Size: UTF-8 bytes plus one; null text counts as empty and has CRC 0.  Rows that repeat id and
    text are told apart by their number in the checkpointed projection.  Null ids are kept.  Only id and text
    are read, texts whole, so other columns cannot clash.  An empty table gives no rows.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.octet_length(text)).alias("h1"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    tagged = rows.withColumns({"h2": F.xxhash64("id", "row"), "bin": F.lit(""), "at": F.lit(0)})
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = max(total, 1) / shards
    bins, turn = min(most_bins, max(bins, n // bin_rows)), 0

    closed: list[tuple[tuple[int, ...], int, int]] = []  # place in key order, bytes, rows
    probing = n > 0
    while probing:
        tagged = tagged.withColumn("d", F.expr(_digit()))
        counts = (
            tagged.where("at >= 0")
            .groupBy("bin", "at", "d")
            .agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("h1").alias("lo"), F.max("h1").alias("hi"))
            .collect()
        )
        found = {(*_place(r["bin"]), r["at"], r["d"]): r for r in counts}
        after: dict[str, int] = {}
        below = 0
        for place, b, k in sorted([*closed, *((p, r["b"], r["n"]) for p, r in found.items())]):
            if r := found.get(place):
                level = r["at"] + 1
                if r["lo"] == r["hi"]:
                    level = max(level, LEVELS)
                splits = any(below < share * s < below + b for s in range(1, shards))
                large = b > total / bins or k > n / bins or (splits and b > tolerance * share)
                if large and k > 1 and level < 2 * LEVELS:
                    after[_name(place)] = level
                else:
                    after[_name(place)] = -1
                    closed.append((place, b, k))
            below += b
        to = spark.createDataFrame(list(after.items()), "name string, next int")
        name = F.when(F.col("at") >= 0, F.concat("bin", F.lpad("at", 2, "0"), F.lpad("d", 2, "0")))
        tagged = (
            tagged.withColumn("name", name)
            .join(F.broadcast(to), "name", "left")
            .withColumns({"bin": F.coalesce("name", "bin"), "at": F.coalesce("next", F.lit(-1))})
            .drop("name", "next", "d")
        )
        probing, turn = any(level >= 0 for level in after.values()), turn + 1
        if probing and turn % 4 == 0:
            tagged = cut(tagged)

    # A bin goes to the shard in which its middle byte lies.
    where, below, filled = [("", 0, 0)], 0, {}
    for place, b, k in sorted(closed):
        shard = min(shards - 1, int((below + b / 2) / share))
        first = filled.get(shard, 0)
        where.append((_name(place), shard, first))
        filled[shard] = first + k
        below += b
    bins_df = spark.createDataFrame(where, "bin string, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("h1", "h2", "row"))
    return (
        tagged.join(F.broadcast(bins_df), "bin")
        .withColumn("slot", F.col("first") + rank - 1)
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
