"""The corpus pipeline: five stages over `documents`, each one of the operators of lattica.llm.

Every stage but the last returns the rows it keeps with the columns they came with. Rows are judged one by
one, by their own id and text: rows that share an id, or have none, don't share decisions. Extra columns
travel along under whatever names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import Tables, table
from lattica.llm.decontaminate import find_leaks
from lattica.llm.jaccard import jaccard_components
from lattica.llm.langid import UNDETERMINED, fit_languages, predict_languages
from lattica.llm.packing import pack
from lattica.llm.queries import TOXIC_FROM
from lattica.llm.toxicity import fit_toxicity, score_toxicity

#: A language's pooled probability from which a document's language counts as known.
LANGUAGE_FROM = 0.4
#: Row keys that are broadcast at most (16 bytes each); beyond, they are shuffled.
BROADCAST_KEYS = 500_000


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with columns named by place, so that no name can clash with an operator's, and the names of id and text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    return docs.toDF(*names), at["doc_id"], at["text"]


def _row_key() -> Column:
    """What tells rows apart: 64 bits hashed from id and text, as in the Jaccard join."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if Tables.rows(keys) <= BROADCAST_KEYS else keys


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxic threshold; the lexicon is learned from the labelled ones among `docs`.

    Null and empty texts score as harmless and stay; so do all rows if nothing is labelled. Equal texts
    share their score, and every one of repeated rows stays or goes with it. Long texts are scored whole.
    """
    lexicon = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    plain, key, text = _plain(docs)
    scored = score_toxicity(plain, lexicon, key, text, tuple(plain.columns))
    return scored.where(F.col("score") < TOXIC_FROM).select(plain.columns).toDF(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language is predicted with some confidence.

    Null and empty texts and those without a letter go, and every row if none has a label to learn from.
    Repeated rows stay or go alike. Long texts are read whole.
    """
    net = fit_languages(docs)
    plain, key, text = _plain(docs)
    predicted = predict_languages(plain, net, key, text, tuple(plain.columns))
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LANGUAGE_FROM)
    return predicted.where(known).select(plain.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies: five-word shingles, Jaccard 0.8 or more.

    Of the rows with that id the one of least key stays, and one of its repetitions. Rows without a word
    (null and empty texts too) are copies of nothing and all stay. Texts are not shuffled: the keys of
    rows that go are broadcast, if there are few enough of them.
    """
    tables = Tables(spark)
    rows = tables.keep(jaccard_components(docs.select("doc_id", "text"), k=5, percent=80, count_links=False).select("row_key", "n_shingles", "first"))
    gone = tables.keep(rows.where("not first").select("row_key").distinct())
    again = tables.keep(rows.where("first and n_shingles > 0").groupBy("row_key").count().where("count > 1").select("row_key"))
    keyed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    names = dict(zip(docs.columns, keyed.columns))
    keyed = keyed.withColumn("row_key", F.xxhash64(F.col(names["doc_id"]).cast("long"), F.col(names["text"]).cast("string")))
    left = keyed.join(_sized(gone), "row_key", "left_anti")
    if Tables.rows(again):
        left = left.join(_sized(again), "row_key", "left_anti").unionByName(left.join(_sized(again), "row_key", "left_semi").dropDuplicates(["row_key"]))
    return left.select(keyed.columns[:-1]).toDF(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's passage, judged by their own text.

    Null and empty texts hold none and stay; repeated rows stay or go alike. Long texts are searched whole.
    """
    tables = Tables(spark)
    slim = docs.select(_row_key().alias("row_key"), "text")
    leaks = tables.keep(find_leaks(slim, table(spark, sf_dir, "benchmark"), id_col="row_key").select("row_key").distinct())
    plain, key, text = _plain(docs)
    keyed = plain.withColumn("row_key", F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")))
    return keyed.join(_sized(leaks), "row_key", "left_anti").select(plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed: one row a piece. Null and empty texts are a piece of one token; repeated rows are packed each."""
    return pack(docs, forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Learned models and the tokenizer can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again; a stage's folder goes once the next is written."""
    tables, docs = Tables(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, tables.keep(stage(spark, docs, sf_dir))
        tables.drop(before)
    return docs
