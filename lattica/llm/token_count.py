"""Token counts of whole texts by a compiled finite-state tokenizer (see `fst`)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import give_back, slices, small_batches
from lattica.llm.fst import release, transducer

VOCAB = "word_bpe_49k.json"


def resolve(vocab: str) -> str:
    """A vocabulary file's place on this machine; a bare name is looked up among the public files."""
    if "/" in vocab:
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, forget: bool = False) -> DataFrame:
    """One row (id, n_bytes, n_tokens) for every row of `df`; one narrow pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens; null ids stay null; repeated rows give repeated rows;
    an empty table gives none; other columns are not read, so their names cannot clash. Texts of any
    length are read whole; a task holds a few megabytes of them at a time beside the machine. `forget`
    drops the compiled machine at a task's end, for workers that serve other stages too.
    """
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(resolve(vocab))
        for batch in batches:
            for b in slices(batch, 2):
                n, _ = machine.run(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])
        if forget:
            release()
        give_back()

    rows = df.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
