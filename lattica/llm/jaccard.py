"""Exact n-gram Jaccard join in the metric space of shingle sets, and its link components.

The Jaccard distance is a metric, so pivots part the space into regions, and a document can only be
linked with one whose distance to a pivot differs by at most the radius.  Nearly all pairs of texts
lie at distance 1, where documents as pivots tell nothing apart; so the first pivots are singleton
sets.  A document is at distance below 1 of exactly the pivots it holds, its cell is that of its
rarest shingle, and linked documents share a cell if each is replicated to the cells of its rarest
(1 - t) n + 1 shingles: the window that the triangle inequality leaves.  Within such regions
documents are pivots, round by round: the cell's documents are compared with them exactly, what is
within the radius joins their component, and pairs of what remains are only compared if their
distances to the cell's first pivot differ by the radius at most.  Compared pivots leave; a cell of one
component is done.  Pairs within a component are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import Tables, give_back, slices, small_batches
from lattica.llm.components import connected_components
from lattica.llm.shingles import Shingler, signature

#: Shingles whose commonness is known to all tasks; it only orders them, so the bound loses nothing.
COMMON = 200_000
#: Buckets of the parity bits.
LOG_BITS = 10
BITS = 1 << LOG_BITS


def _survey(k: int, chunk: int = 1_500_000):
    """Tasks' pass one: a row for each text (set size and signature), and locally common shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def common() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate([*held.values(), np.zeros(0, np.uint64)]), return_counts=True)
            u, c = u[c >= 3], c[c >= 3]
            top = np.argsort(-c, kind="stable")[:COMMON]
            held.clear()
            n = len(top)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(c[top].astype(np.int64)), pa.array(u[top].astype(np.int64)), pa.nulls(n, pa.int64())], ["id", "row_key", "n", "s1", "s2"])

        for b in batches:
            for part in slices(b, 1):
                sets = shingler.sets(part.column(1).to_pylist())
                signs = [signature(s) for s in sets]
                for sign, s in zip(signs, sets):
                    if sign not in held:
                        held[sign] = s
                        size += len(s)
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([a for a, _ in signs], pa.int64()), pa.array([a for _, a in signs], pa.int64())], ["id", "row_key", "n", "s1", "s2"])
                if size > chunk:
                    yield common()
                    size = 0
        yield common()
        give_back()

    return run


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A set's shingles counted modulo 2 in `BITS` buckets, as longs: sets differ in at least as many shingles as these differ in bits."""
    odd = np.bincount((s >> np.uint64(64 - LOG_BITS)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _prefixes(k: int, percent: int, shingles: np.ndarray, level: np.ndarray):
    """Tasks' pass two: each text's rarest shingles, first those of the lowest level, and its parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            for part in slices(b, 1):
                out, sizes, bits = [], [], []
                for s in shingler.sets(part.column(1).to_pylist()):
                    sizes.append(len(s))
                    n = len(s)
                    at = np.minimum(np.searchsorted(shingles, s), max(0, len(shingles) - 1))
                    rank = np.where(shingles[at] == s, level[at], 0) if len(shingles) else np.zeros(n, int)
                    out.append(s[np.lexsort((s, rank))][: n + (-percent * n // 100) + 1 if n else 0].astype(np.int64))
                    bits.append(parity_bits(s))
                offsets = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*out, np.zeros(0, np.int64)])))
                flat = pa.array(np.concatenate([*bits, np.zeros(0, np.int64)]))
                marks = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (BITS // 64)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), cells, marks], ["doc", "n", "cells", "bits"])
        give_back()

    return run


def _verify(k: int, percent: int):
    """Tasks' comparison of pairs by their whole texts; a text's set is kept while pairs of it follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        last: dict[int, tuple[int, np.ndarray]] = {}

        def grams(side: int, key: int, text: str) -> np.ndarray:
            if last.get(side, (None,))[0] != key:
                last[side] = (key, shingler.sets([text])[0])
            return last[side][1]

        for b in batches:
            x, y, tx, ty = (b.column(i) for i in range(4))
            dist, linked = [], []
            for i in range(b.num_rows):
                ga, gb = grams(0, x[i].as_py(), tx[i].as_py()), grams(1, y[i].as_py(), ty[i].as_py())
                both = len(np.intersect1d(ga, gb, assume_unique=True))
                union = len(ga) + len(gb) - both
                dist.append(1 - both / union)
                linked.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([x, y, pa.array(dist, pa.float64()), pa.array(linked, pa.bool_())], ["x", "y", "dist", "linked"])
        give_back()

    return run


def _count_links(k: int, percent: int):
    """(rep, n) of a pair of blocks of one component: each text's links to the other block, or within its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc")
        sets = Shingler(k).sets(pdf["text"].tolist())
        sizes = np.array([len(s) for s in sets])
        words, codes = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        member, own, out = np.zeros(len(words), np.int64), pdf["own"].to_numpy(), np.zeros(len(pdf), np.int64)
        for i, (lo, n) in enumerate(zip(starts, sizes)):
            member[codes[lo : lo + n]] = 1
            both = np.add.reduceat(member[codes], starts)
            linked = 100 * both >= percent * (sizes + n - both)
            linked &= own != own[i] if pdf["a"].iat[0] != pdf["b"].iat[0] else np.arange(len(pdf)) != i
            out[i] = linked.sum()
            member[codes[lo : lo + n]] = 0
        return pd.DataFrame({"rep": pdf["doc"], "n": out})

    return run


def _possible(percent: int, nx: str, ny: str, px: str, py: str) -> Column:
    """Sizes and places within prefixes that a link allows, if the shared shingle is the first shared."""
    least = F.expr(f"({percent} * ({nx} + {ny}) + {99 + percent}) div {100 + percent}")
    sizes = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return sizes & (1 + F.least(F.col(nx) - F.col(px) - 1, F.col(ny) - F.col(py) - 1) >= least)


def _degrees(read: DataFrame, links: DataFrame, components: DataFrame, tables: Tables, bounded, k: int, percent: int, block: int) -> DataFrame:
    """(rep, n_links): a component whose links are all its pairs is counted already; of the others every pair of blocks is."""
    degree = links.select(F.col("u").alias("rep")).union(links.select("v")).groupBy("rep").agg(F.count("*").alias("seen"))
    edges = links.join(components, F.col("u") == F.col("node")).groupBy("component").agg(F.count("*").alias("edges"))
    nodes = components.groupBy("component").agg(F.count("*").alias("nodes"))
    partial = nodes.join(edges, "component").where("2 * edges < nodes * (nodes - 1)").select("component", F.ceil(F.col("nodes") / block).alias("blocks"))
    members = tables.keep(components.join(partial, "component").select(F.col("node").alias("doc"), "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("own")))
    dealt = read.join(bounded(members), "doc").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("doc", "text", "component", "own", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"))
    counted = dealt.groupBy("component", "a", "b").applyInPandas(_count_links(k, percent), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("all"))
    counted = tables.keep(counted)
    tables.drop(members)
    return degree.join(counted, "rep", "left").select("rep", F.coalesce("all", "seen").alias("n_links"))


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 4,
    percent: int = 85,
    pivots: int = 64,
    broadcast_ids: int = 1_000_000,
    block: int = 128,
    count_links: bool = True,
) -> DataFrame:
    """(id, n_shingles, component_id, n_links, row_key, first) of every row; links are pairs of different sets with Jaccard >= percent / 100.

    Exact: every pair that may be linked is either verified on its whole sets or already in one
    component. Equal sets are one node; they share its component. `n_links` counts
    all links of a row's set to other sets: components with a pair not compared are dealt into blocks of about
    `block` sets, and each pair of blocks is counted in a task; without `count_links` it is null.

    Rows are told apart by `row_key`, 64 bits hashed from id and text, so rows that share an id keep their
    own links, and rows with a null id take part; component_id is the least id of the component that is not
    null. Rows that repeat an id and text repeat in the result. Null, empty and wordless texts have no
    shingle and are linked with nothing. `first` marks the row of a component with the least id, and of
    those the least key (its repetitions too), and every row without a shingle. Texts of any length
    are read whole. Other columns are not read, so names cannot clash. An empty table gives no rows.

    Pass one reads texts for sizes, signatures and common shingles, pass two for prefixes (a sixth of
    all shingles: the only large exchange), a third reads only documents of candidate pairs; their
    ids are broadcast while they are at most `broadcast_ids` (counted), and shuffled beyond.
    """
    small_batches(df.sparkSession)
    radius = 1 - percent / 100
    tables = Tables(df.sparkSession)
    keep, drop = tables.keep, tables.drop
    bounded = lambda d: F.broadcast(d) if tables.rows(d) <= broadcast_ids else d
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("id", "text").alias("row_key"), "text")
    surveyed = keep(docs.select("row_key", "text", "id").mapInArrow(_survey(k), "id long, row_key long, n long, s1 long, s2 long"))
    rows = surveyed.where("s2 is not null")
    # Ids name the rows where each has one text: the first of a group is often what its copies were made from, a good pivot.
    shared = rows.groupBy("id").agg((F.col("id").isNull() | (F.min("row_key") < F.max("row_key"))).alias("shared")).where("shared")
    name = "id" if shared.isEmpty() else "row_key"
    rows = rows.withColumn("doc", F.col(name))
    read = docs.select(F.col(name).alias("doc"), "text")
    common = surveyed.where("s2 is null").groupBy("s1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "s1").limit(COMMON).toPandas()
    order = np.argsort(common["s1"].to_numpy().astype(np.int64).view(np.uint64))
    shingles = common["s1"].to_numpy().astype(np.int64).view(np.uint64)[order]
    level = np.log2(common["c"].to_numpy(float)[order] + 1).astype(np.int64)

    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))
    classes = keep(rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), least.alias("head")))
    copies = keep(rows.join(classes, ["s1", "s2", "n"]).where("doc <> rep").select("doc").distinct())
    prefixes = read.mapInArrow(_prefixes(k, percent, shingles, level), "doc long, n long, cells array<long>, bits array<long>")
    if 0 < tables.rows(copies) <= broadcast_ids:
        prefixes = prefixes.join(F.broadcast(copies), "doc", "left_anti")
    elif tables.rows(copies):
        prefixes = prefixes.join(copies, "doc", "left_anti")
    prefixes = keep(prefixes.where("n > 0"))
    drop(copies)
    sketches = keep(prefixes.select("doc", "n", "bits").dropDuplicates(["doc"]))
    placed = prefixes.select("doc", "n", F.posexplode("cells").alias("pos", "cell"))

    def verified(pairs: DataFrame, settle: bool = False) -> DataFrame:
        """(x, y, dist, linked) of candidate pairs, by their whole texts, which compress better than sets.

        With `settle`, pairs whose parity bits differ in more places than linked sets have shingles apart are not
        linked, and need no text; their dist stays null.
        """
        far = None
        if settle:
            for c in "xy":
                pairs = pairs.join(sketches.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}")), c)
            apart = sum((F.bit_count(F.col("bx")[i].bitwiseXOR(F.col("by")[i])) for i in range(BITS // 64)), F.lit(0))
            near = apart * (100 + percent) <= (100 - percent) * (F.col("nx") + F.col("ny"))
            judged = keep(pairs.select("x", "y", near.alias("near")))
            pairs, far = judged.where("near").select("x", "y"), judged.where("not near")
        else:
            judged = pairs = keep(pairs)
        ids = keep(pairs.select(F.col("x").alias("doc")).union(pairs.select("y")).distinct())
        texts = keep(read.join(bounded(ids), "doc", "left_semi").dropDuplicates(["doc"]))
        a, b = (texts.select(F.col("doc").alias(c), F.col("text").alias(f"t{c}")) for c in "xy")
        both = pairs.join(b, "y").join(a, "x").select("x", "y", "tx", "ty")
        tested = both.mapInArrow(_verify(k, percent), "x long, y long, dist double, linked boolean")
        out = keep(tested if far is None else tested.union(far.select("x", "y", F.lit(None).cast("double"), F.lit(False))))
        drop(judged, ids, texts)
        return out

    # Every cell's extremes tell whether it is shared; a cell of two is one pair, judged by them alone.
    left_over = F.col("n") - F.col("pos") - 1
    cell = placed.groupBy("cell").agg(
        F.min("doc").alias("pivot"), F.max("doc").alias("other"), F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.min(left_over).alias("left_over")
    )
    overlap = F.expr(f"({percent} * (least + most) + {99 + percent}) div {100 + percent}")
    judged = (F.col("size") > 2) | (100 * F.col("least") >= percent * F.col("most")) & (1 + F.col("left_over") >= overlap)
    cell = keep(cell.where("pivot < other").where(judged).select("cell", "pivot", "other", "size"))
    twos = cell.where("size = 2").select(F.col("other").alias("x"), F.col("pivot").alias("y"))
    more = keep(cell.where("size > 2").select("cell", "pivot"))
    cells = keep(placed.join(bounded(more), "cell").dropDuplicates(["cell", "doc"]))
    drop(prefixes, more)

    # Round one: every cell's documents against its first pivot.
    first = cells.where("doc = pivot").select("cell", F.col("n").alias("np"), F.col("pos").alias("pp"))
    near = cells.where("doc <> pivot").join(first, "cell").where(_possible(percent, "n", "np", "pos", "pp"))
    known = verified(twos.union(near.select(F.col("doc").alias("x"), F.col("pivot").alias("y"))).distinct())
    links = keep(known.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
    to_first = known.select(F.col("x").alias("doc"), F.col("y").alias("pivot"), "dist")
    left = keep(cells.join(to_first, ["doc", "pivot"], "left").withColumn("dist", F.when(F.col("doc") == F.col("pivot"), 0.0).otherwise(F.col("dist"))))
    drop(cells, cell)

    # Further rounds: documents outside the cell's largest component against the cell, `pivots` of them, twice as
    # many in each round, or more where the cell is small: up to a million comparisons a cell. The number of rounds
    # grows with the logarithm of the largest cell.
    components = connected_components(links, tables)
    turns = 0
    while True:
        own = F.coalesce("component", "doc").alias("comp")
        named = keep(left.join(components.withColumnRenamed("node", "doc"), "doc", "left").select("cell", "doc", "n", "pos", "dist", own))
        sizes = named.groupBy("cell", "comp").count()
        mixed = sizes.groupBy("cell").agg(F.sum("count").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("count", "comp")).alias("top"))
        mixed = mixed.where("kinds > 1").select("cell", "size", F.col("top.comp").alias("main"))
        before, left = left, keep(named.join(mixed, "cell"))
        drop(before, named)
        if not tables.rows(left):
            break
        turn = F.row_number().over(Window.partitionBy("cell").orderBy("doc"))
        quota = F.greatest(F.lit(pivots << turns), F.floor(F.lit(1_000_000) / F.col("size")))
        chosen = left.where("comp <> main").withColumn("turn", turn).where(F.col("turn") <= quota)
        chosen = keep(chosen.select("cell", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("dist").alias("dy"), F.col("comp").alias("cy")))
        window = F.coalesce(F.abs(F.col("dist") - F.col("dy")) <= radius + 1e-9, F.lit(True))
        pairs = left.join(chosen, "cell").where((F.col("comp") != F.col("cy")) & window & _possible(percent, "n", "ny", "pos", "py"))
        turns += 1
        pairs = pairs.select(F.greatest("doc", "y").alias("x"), F.least("doc", "y").alias("y")).distinct()
        tested = verified(pairs.join(known, ["x", "y"], "left_anti"), settle=True)
        found = keep(tested.where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")))
        stale = [known, left, chosen, tested]
        known = keep(known.union(tested))
        if tables.rows(found):
            stale += [links, components]
            links = keep(links.union(found))
            components = connected_components(links, tables)
        left = keep(left.join(chosen.select("cell", F.col("y").alias("doc")), ["cell", "doc"], "left_anti").drop("comp", "size", "main"))
        drop(*stale, found)
    drop(known, left, sketches)

    heads = components.join(classes.select(F.col("rep").alias("node"), "head"), "node").groupBy("component").agg(F.min("head").alias("head_of"))
    found = classes.join(components.join(heads, "component").select(F.col("node").alias("rep"), "head_of"), "rep", "left")
    if count_links:
        found = found.join(_degrees(read, links, components, tables, bounded, k, percent, block), "rep", "left")
    else:
        found = found.withColumn("n_links", F.lit(None).cast("long"))
    lead = F.coalesce("head_of", "head")
    found = found.select("s1", "s2", F.col("n").alias("size"), lead["id"].alias("comp"), lead["row_key"].alias("lead"), F.coalesce("n_links", F.lit(0 if count_links else None)).alias("n_links"))
    match = (rows["s1"] == found["s1"]) & (rows["s2"] == found["s2"]) & (rows["n"] == found["size"])
    alone = F.col("n") == 0
    return rows.join(found, match, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("comp")).alias("component_id"),
        F.when(alone & F.lit(count_links), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), "row_key", (alone | (F.col("row_key") == F.col("lead"))).alias("first"),
    )
