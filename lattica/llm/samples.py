"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str):
    """The rows that no model learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def labelled_texts(
    docs: DataFrame, labels: DataFrame, per_label: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 16, max_labels: int = 64
) -> list[tuple[str, str, int]]:
    """(text, label, rows with that label) of at most `per_label` rows of each of the `max_labels` commonest labels, by smallest hash of id.

    `labels` has (id, label), held-out ids among them already removed. Only ids are sorted, and only
    the chosen ids (a bounded number) are broadcast to fetch their texts. Texts of more than `max_bytes`
    bytes are not learned from, and of rows that share an id the least text counts, so the driver gets
    `per_label * max_labels` texts of `max_bytes` at most.
    """
    counts = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels).collect()
    sizes = {r["label"]: r["count"] for r in counts}
    if not sizes:
        return []
    order = F.xxhash64("id")
    chosen = reduce(DataFrame.unionByName, [labels.where(F.col("label") == k).dropDuplicates(["id"]).orderBy(order, "id").limit(per_label) for k in sorted(sizes)])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["label"], sizes[r["label"]]) for r in sorted(rows, key=lambda r: (r["id"], r["label"]))]
