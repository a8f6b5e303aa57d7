"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut, give_back, slices, small_batches
from lattica.llm.fst import release, transducer
from lattica.llm.token_count import VOCAB, resolve

PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part int"
#: Sequence numbers: the task or merge group in the upper bits, a counter in the lower 32.
MERGED = 1 << 62


class OpenWindows:
    """A fixed number of open windows; pieces are placed best-fit and closed windows are emitted.

    When no window has room, the fullest is emitted: first filled by the head of the piece, if both
    the head and the rest keep `min_cut` tokens, else as it is.
    """

    def __init__(self, size: int, slots: int, min_cut: int, first_id: int) -> None:
        self.size, self.min_cut, self.next_id = size, min_cut, first_id
        self.used = [0] * slots
        self.pieces: list[list[tuple]] = [[] for _ in range(slots)]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple], is_open: bool = False) -> None:
        at = 0
        for p in pieces:
            self.done.append((*p, self.next_id, at, is_open))
            at += p[2]
        self.next_id += 1

    def add(self, doc: tuple, start: int, n: int, piece) -> None:
        """Place tokens `start` to `start + n` of a document; `piece(doc, a, k)` makes a row."""
        while n >= self.size:
            self._emit([piece(doc, start, self.size)])
            start, n = start + self.size, n - self.size
        while n:
            fits = [(self.size - u, i) for i, u in enumerate(self.used) if self.size - u >= n]
            if fits:
                free, i = min(fits)
                self.pieces[i].append(piece(doc, start, n))
                self.used[i] += n
                if self.used[i] == self.size:
                    self._close(i)
                return
            i = max(range(len(self.used)), key=self.used.__getitem__)
            free = self.size - self.used[i]
            if free >= self.min_cut and n - free >= self.min_cut:
                self.pieces[i].append(piece(doc, start, free))
                start, n = start + free, n - free
            self._close(i)

    def _close(self, i: int) -> None:
        self._emit(self.pieces[i])
        self.pieces[i], self.used[i] = [], 0

    def leftovers(self) -> None:
        for pieces in self.pieces:
            if pieces:
                self._emit(pieces, True)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def merge_windows(left: pa.Table, size: int, first_id: int) -> pa.Table:
    """Best-fit decreasing over whole leftover windows; every piece keeps its tokens, ids are passed on untouched."""
    windows, own = np.unique(left.column("sequence_id").to_numpy(), return_inverse=True)
    used = np.bincount(own, left.column("length").to_numpy(), len(windows)).astype(np.int64)
    room: list[int] = []
    place, shift = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for w in np.argsort(-used, kind="stable").tolist():
        n = int(used[w])
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(size)
        place[w], shift[w] = first_id + i, size - room[i]
        room[i] -= n
    new = {"sequence_id": place[own], "offset": left.column("offset").to_numpy() + shift[own]}
    return pa.table({c: pa.array(new[c], pa.int64()) if c in new else left.column(c) for c in PIECE_COLUMNS})


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = VOCAB,
    size: int = 4096,
    end_id: int = 2,
    slots: int = 32,
    min_cut: int = 64,
    merge_parts: int = 32,
    forget: bool = False,
) -> DataFrame:
    """Pack every text's ids, then `end_id`, into sequences of at most `size` tokens.

    Each partition keeps `slots` open windows, so a task holds one Arrow batch and a few thousand
    piece rows at most. What is still open at a partition's end is merged with the leftovers of the
    `merge_parts` partitions beside it; those groups have `slots * merge_parts` windows at most.
    The one pass over texts is written to the checkpoint folder (a row for each piece), for both
    branches to read; `forget` drops the compiled tokenizer at a task's end, for workers that serve other
    stages too. Null and empty texts give a piece of one token (the end id). Repeated rows are
    packed as documents of their own; null ids stay null. A text longer than a window is cut into
    whole ones and a rest. Of the columns only id and text are read, so other names cannot clash. An empty table gives
    no rows. Returns one row a piece.
    """

    small_batches(df.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        machine = transducer(resolve(vocab))
        windows = OpenWindows(size, slots, min_cut, part << 32)

        def piece(doc: tuple, a: int, n: int) -> tuple:
            key, ids = doc
            return key, a, n, zlib.crc32(ids[a : a + n].data), len(ids)

        def rows() -> pa.RecordBatch:
            got = windows.take()
            cols = list(zip(*got)) if got else [[]] * 8
            types = [pa.int64()] * 7 + [pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array([part] * len(got), pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, [*PIECE_COLUMNS, "open", "part"])

        for b in batches:
            for part_of in slices(b, 1):
                _, ids = machine.run(part_of.column(1).to_pylist(), want_ids=True)
                for key, own in zip(part_of.column(0).to_pylist(), ids):
                    whole = np.append(own, np.int32(end_id)).astype("<i4")
                    windows.add((key, whole), 0, len(whole), piece)
            yield rows()
            give_back()
        windows.leftovers()
        yield rows()
        if forget:
            release()
        give_back()

    placed = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, PIECE_SCHEMA))

    def merge(key: tuple, left: pa.Table) -> pa.Table:
        return merge_windows(left, size, MERGED + (key[0].as_py() << 32))

    schema = ", ".join(f"{c} long" for c in PIECE_COLUMNS)
    merged = placed.where("open").groupBy((F.col("part") / merge_parts).cast("int").alias("g")).applyInArrow(merge, schema)
    return placed.where("not open").select(PIECE_COLUMNS).unionByName(merged).withColumnRenamed("doc_id", id_col)
