"""Benchmark decontamination by template canonicalisation; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

#: Placeholders (private-use characters) of numbers, units and names, and the mark of a sentence's start.
NUM, UNIT, NAME, START = "\ue000", "\ue001", "\ue002", "\ue003"
#: Unit words, as such when they follow a number.
UNITS = "km|kg|cm|mm|mg|ml|m|g|l|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inches|pounds?|dollars?|euros?|percent"
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
WORD = r"\p{L}[\p{L}\p{M}]*"
#: Replaced in this order; a capital is a name's unless a sentence or the text starts with it.
REWRITES = (
    (NUMBER, NUM),
    (rf"{NUM}( ?)(?:{UNITS})([^\p{{L}}\p{{M}}]|$)", rf"{NUM}$1{UNIT}$2"),
    (rf"([.!?:\n][^\p{{L}}{NUM}]*)(\p{{Lu}})", rf"$1{START}$2"),
    (rf"([^\p{{L}}\p{{M}}{START}])\p{{Lu}}[\p{{L}}\p{{M}}]*\p{{Ll}}[\p{{L}}\p{{M}}]*", rf"$1{NAME}"),
)
CANON_TOKEN, RAW_TOKEN = rf"[{NUM}-{NAME}]|{WORD}", rf"{NUMBER}|{WORD}"


def canonical(text: Column) -> Column:
    """Canonical tokens of a text: words in lower case and typed placeholders."""
    text = F.translate(text, NUM + UNIT + NAME + START, "")
    for pattern, to in REWRITES:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_extract_all(F.lower(text), F.lit(CANON_TOKEN), F.lit(0))


def bare(text: Column) -> Column:
    """The text's own tokens, one for each canonical one: the values of slots."""
    text = F.translate(text, NUM + UNIT + NAME + START, "")
    return F.regexp_extract_all(F.lower(text), F.lit(RAW_TOKEN), F.lit(0))


def _slot(t: Column) -> Column:
    return t.isin(NUM, UNIT, NAME)


def _windows(codes: str, w: int) -> Column:
    """Hashes of the windows of `w` codes. `codes` is a column, not an expression: a lambda would compute it anew for each window."""
    at = F.sequence(F.lit(1), F.size(codes) - (w - 1))
    return F.when(F.size(codes) >= w, F.transform(at, lambda i: F.xxhash64(F.slice(codes, i, w))))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = 8,
    min_windows: int = 3,
    min_words: int = 4,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """Pairs of documents and benchmark items of which they hold a passage, parameters changed or not.

    Numbers, units and capitalised words within a sentence become typed placeholders.  Every
    window of `window` tokens of every whole text is hashed and joined with the windows of the items.
    Of those, ones with fewer than `min_words` plain words are told by their own words and numbers, so
    that only exact copies match, since their placeholders prove nothing.  Matches of
    a document and item at one shift are a run.  Within a run an item's number, unit (plural or not) or name
    must stand for one of the document, and a name for one name of the item; windows that hold a slot
    against this are left out, unless their own slots are all unchanged.  A pair leaks if its runs hold `min_windows` windows, or all
    that the item has.  Items shorter than a window are one window of their own length.

    Texts are read twice: for windows, and those with a slotted run for the tokens at the slots of their
    runs. Only these (place, token) pairs move on, so memory grows neither with the shifts nor with the
    length of a text that repeats a passage. The item side is broadcast while it has at most
    `broadcast_rows` windows (counted; about 40 bytes each), and shuffled beyond; so is the list of
    documents whose slots are compared. Tables between are written in as many files as there are cores.

    Texts with no token, null texts, ids and items match nothing.  Rows that share an id are judged each by
    its own text (so are items); a pair is reported once, with the most windows.  Texts of any length are
    read whole.  Empty tables give no rows.  Other columns are not read, so their names cannot clash.
    Returns id, item, n_windows (matched), item_windows, reparameterised.
    """
    spark, text = docs.sparkSession, F.col(text_col)
    files = spark.sparkContext.defaultParallelism
    key = lambda c: F.struct(F.col(c).alias("id"), F.xxhash64(text).alias("h"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(key(item_col).alias("item"), canonical(text).alias("canon"), bare(text).alias("itoks"))
    items = items.withColumn("codes", F.transform("canon", lambda t: F.xxhash64(t))).withColumn("own", F.transform("itoks", lambda t: F.xxhash64(t)))
    items = cut(items.where(F.size("itoks") > 0).dropDuplicates(["item"]).coalesce(files))
    short = [r[0] for r in items.where(F.size("itoks") < window).select(F.size("itoks")).distinct().collect()]
    sizes = [window, *sorted(short)]
    docs = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(key(id_col).alias("doc"), text.alias("text"))

    def item_windows(w: int) -> DataFrame:
        own = items.where(F.size("itoks") == w) if w < window else items.where(F.size("itoks") >= w)
        rows = own.select("item", "canon", F.posexplode(F.arrays_zip(_windows("codes", w).alias("h"), _windows("own", w).alias("o"))).alias("ipos", "at"))
        words = F.size(F.filter(F.slice("canon", F.col("ipos") + 1, w), lambda t: ~_slot(t)))
        rows = rows.withColumn("words", words).withColumn("exact", F.col("words") < min(min_words, w))
        return rows.select("item", F.lit(w).alias("w"), "ipos", F.when(F.col("exact"), F.col("at.o")).otherwise(F.col("at.h")).alias("h"), (F.col("words") < w).alias("slotted"), "exact")

    keys = cut(reduce(DataFrame.unionByName, [item_windows(w) for w in sizes]).coalesce(files))
    whole = keys.groupBy("item").agg(F.countDistinct("ipos").alias("item_windows"))
    few = keys.count() <= broadcast_rows
    right = F.broadcast(keys) if few else keys
    texts = docs.select("doc", *(F.transform(f(F.col("text")), lambda t: F.xxhash64(t)).alias(c) for c, f in (("codes", canonical), ("own", bare))))
    hits = []
    for exact, codes in ((False, "codes"), (True, "own")):
        used = [r[0] for r in keys.where(F.col("exact") == exact).select("w").distinct().collect()]
        for w in sorted(used):
            left = texts.select("doc", F.posexplode(_windows(codes, w)).alias("pos", "h")).withColumns({"exact": F.lit(exact), "w": F.lit(w)})
            hits.append(left.join(right, ["h", "exact", "w"]).select("doc", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", "slotted", "w"))
    if not hits:
        types = {f.name: f.dataType.simpleString() for f in benchmark.schema} | {f.name: f.dataType.simpleString() for f in docs.select("doc.id").schema}
        return spark.createDataFrame([], f"{id_col} {types['id']}, {item_col} {types[item_col]}, n_windows long, item_windows long, reparameterised boolean")
    runs = reduce(DataFrame.unionByName, hits).groupBy("doc", "item", "shift")
    runs = cut(runs.agg(F.collect_set("ipos").alias("at"), F.max("slotted").alias("slotted"), F.max("w").alias("w")).coalesce(files))

    # The slots of every run, and the document's tokens there: cut out in the task that reads the text.
    asked = runs.where("slotted")
    places = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("w") - 1))))
    slots = F.filter(F.transform(places, lambda p: F.struct(p.alias("p"), F.get("canon", p).alias("kind"), F.get("itoks", p).alias("i"))), lambda s: _slot(s["kind"]))
    sides = items.select("item", "canon", "itoks")
    slots = asked.join(F.broadcast(sides) if few else sides, "item").select("doc", "item", "shift", F.explode(slots).alias("s"))
    slots = slots.select("doc", "item", "shift", "s.*", (F.col("s.p") + F.col("shift")).alias("pos"))
    wanted = cut(slots.groupBy("doc").agg(F.collect_set("pos").alias("places")).coalesce(files))
    ids = wanted.select("doc")
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    read = docs.join(ids, "doc", "left_semi").dropDuplicates(["doc"]).select("doc", bare(F.col("text")).alias("dtoks"))
    values = read.join(wanted, "doc").select("doc", F.explode(F.transform("places", lambda p: F.struct(p.alias("pos"), F.get("dtoks", p).alias("d")))).alias("v"))
    slots = slots.join(values.select("doc", "v.pos", "v.d"), ["doc", "pos"]).groupBy("doc", "item", "shift").agg(F.collect_list(F.struct("p", "kind", "i", "d")).alias("slots"))

    form = lambda s, v: F.when(s["kind"] == UNIT, F.regexp_replace(s[v], r"(\p{L}{3})s$", "$1")).otherwise(s[v])
    pairs = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), form(s, "i").alias("i"), form(s, "d").alias("d"))))
    # Values of an item that stand for several of the document; of names also the other way.
    torn = F.filter("pairs", lambda s: F.exists("pairs", lambda o: (o["kind"] == s["kind"]) & (
        (o["i"] == s["i"]) & (o["d"] != s["d"]) | (s["kind"] == NAME) & (o["d"] == s["d"]) & (o["i"] != s["i"])
    )))
    clash = F.transform(F.filter("slots", lambda s: F.exists("torn", lambda o: (o["kind"] == s["kind"]) & (o["i"] == form(s, "i")))), lambda s: s["p"])
    altered = F.transform(F.filter("slots", lambda s: s["i"] != s["d"]), lambda s: s["p"])
    holds = lambda where, p: F.exists(where, lambda q: q.between(p, p + F.col("w") - 1))
    compared = (
        asked.join(slots, ["doc", "item", "shift"]).withColumn("pairs", pairs).withColumn("torn", torn)
        .withColumn("clash", clash).withColumn("altered", altered)
        .withColumn("at", F.filter("at", lambda p: ~holds("clash", p) | ~holds("altered", p)))
        .select("doc", "item", "at", F.exists("at", lambda p: holds("altered", p)).alias("changed"))
    )
    kept = runs.where("not slotted").select("doc", "item", "at", F.lit(False).alias("changed")).unionByName(compared)
    pairs = kept.select("doc", "item", "changed", F.explode("at").alias("ipos")).groupBy("doc", "item", "ipos").agg(F.max("changed").alias("changed"))
    pairs = pairs.groupBy("doc", "item").agg(F.count("*").alias("n_windows"), F.max("changed").alias("reparameterised"))
    enough = F.col("n_windows") >= F.least(F.lit(min_windows), F.col("item_windows"))
    best = pairs.join(whole, "item").where(enough).groupBy(F.col("doc.id").alias("_doc"), F.col("item.id").alias("_item"))
    best = best.agg(F.max(F.struct("n_windows", "item_windows", "reparameterised")).alias("b")).coalesce(files)
    return best.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "b.n_windows", "b.item_windows", "b.reparameterised")
