"""The registered queries of this subpackage: thin uses of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import table
from lattica.llm.decontaminate import CANON_TOKEN, NAME, NUM, RAW_TOKEN, REWRITES, START, UNIT, find_leaks
from lattica.llm.html_extract import extract
from lattica.llm.jaccard import jaccard_components
from lattica.llm.labelled_pages import trained_model
from lattica.llm.langid import fit_languages, predict_languages
from lattica.llm.packing import pack
from lattica.llm.samples import held_out
from lattica.llm.sharding import histogram_shards
from lattica.llm.token_count import count_tokens
from lattica.llm.topk import exact_top_k, quantise, usable
from lattica.llm.toxicity import fit_toxicity, score_toxicity
from lattica.llm.warc import audit, layout


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op1_tokens(source: str, key: str) -> str:
    """SQL for the tokens of a table by place: bare value and canonical form."""
    raw = f"translate(text, '{NUM}{UNIT}{NAME}{START}', '')"
    canon = raw
    for pattern, to in REWRITES:
        canon = f"regexp_replace({canon}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"""
  SELECT {key}, unnest(range(len(cs))) AS p, unnest(cs) AS c, unnest(bs) AS bare FROM (
    SELECT {key}, regexp_extract_all(lower({canon}), '{CANON_TOKEN}') AS cs, regexp_extract_all(lower({raw}), '{RAW_TOKEN}') AS bs
    FROM {source} WHERE text IS NOT NULL AND {key} IS NOT NULL)"""


_SLOTS = f"('{NUM}', '{UNIT}', '{NAME}')"


def _op1_windows(tokens: str, key: str) -> str:
    """SQL for the windows of eight tokens, with their plain words counted."""
    return f"""
  SELECT * FROM (
    SELECT {key}, p, string_agg(c, ' ') OVER w AS win, count(*) OVER w AS k, count(*) FILTER (c NOT IN {_SLOTS}) OVER w AS words
    FROM {tokens} WINDOW w AS (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE k = 8"""


OP1_SQL = f"""
WITH dt AS ({_op1_tokens("documents", "doc_id")}),
bt AS ({_op1_tokens("benchmark", "item_id")}),
bw AS ({_op1_windows("bt", "item_id")} AND words >= 4),
dw AS ({_op1_windows("dt", "doc_id")}),
m AS (SELECT doc_id, item_id, dw.p - bw.p AS shift, bw.p AS ipos FROM dw JOIN bw USING (win)),
s AS (
  SELECT DISTINCT doc_id, item_id, shift, bt.bare AS i, dt.bare AS d
  FROM (SELECT DISTINCT doc_id, item_id, shift, unnest(range(ipos, ipos + 8)) AS p FROM m) x
  JOIN bt USING (item_id, p) JOIN dt USING (doc_id) WHERE dt.p = x.p + shift AND bt.c IN {_SLOTS}),
ok AS (
  SELECT doc_id, item_id, shift, bool_or(i <> d) AS changed FROM s GROUP BY ALL
  HAVING count(*) = count(DISTINCT i) AND count(*) = count(DISTINCT d)),
kept AS (
  SELECT m.*, coalesce(ok.changed, FALSE) AS changed FROM m LEFT JOIN ok USING (doc_id, item_id, shift)
  WHERE ok.doc_id IS NOT NULL OR (doc_id, item_id, shift) NOT IN (SELECT (doc_id, item_id, shift) FROM s)),
n AS (SELECT item_id, count(DISTINCT p) AS item_windows FROM bw GROUP BY ALL)
SELECT doc_id, item_id, count(DISTINCT ipos) AS n_windows, item_windows, bool_or(changed) AS reparameterised
FROM kept JOIN n USING (item_id) GROUP BY doc_id, item_id, item_windows
HAVING count(DISTINCT ipos) >= least(3, item_windows)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select("vec_id", quantise(F.col("embedding")).alias("vec"))
    return exact_top_k(vectors.where("vec_id % 50 = 0"), vectors)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
c AS (SELECT list_sort(g) AS g, min(doc_id) AS rep, len(any_value(g)) AS n FROM g WHERE len(g) > 0 GROUP BY 1),
e AS (SELECT rep, n, unnest(g) AS s FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(g.g) AS n_shingles, CASE WHEN len(g.g) = 0 THEN doc_id ELSE least(c.rep, coalesce((SELECT min(b) FROM r WHERE r.a = c.rep), c.rep)) END AS component_id,
  (SELECT count(*) FROM l WHERE l.a = c.rep) AS n_links
FROM g LEFT JOIN c ON list_sort(g.g) = c.g
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained_model())


TOXIC_FROM = 0.3


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a damaged replica of all pages: every 97th record has a changed first byte of its payload,
    and every 13th archive has lost what lies beyond 90 % of its bytes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    whole = layout(pages)
    rotten = pages.withColumn("html", F.when((F.col("page_id") % 97 == 5) & (F.octet_length("html") > 0), F.overlay("html", F.lit("#"), 1)).otherwise(F.col("html")))
    end = F.max(F.col("offset") + F.col("length")).over(Window.partitionBy("archive"))
    lost = (F.col("archive") % 13 == 3) & ((F.col("offset") + F.col("length")) * 10 > end * 9)
    return audit(whole, layout(rotten).withColumn("lost", lost).where(~F.col("lost")).drop("lost")).withColumnRenamed("id", "page_id")


OP9_SQL = """
WITH r AS (
  SELECT page_id, page_id // 256 AS archive, u.bad,
         concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
           'WARC-Date: 1970-01-01T00:00:00Z', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(h), chr(13), chr(10), chr(13), chr(10),
           CASE WHEN u.bad THEN concat('#', substr(h, 2)) ELSE h END, chr(13), chr(10), chr(13), chr(10)) AS rec
  FROM (SELECT *, coalesce(html, '') AS h FROM pages) p, (VALUES (FALSE), (TRUE)) u(bad)),
d AS (
  SELECT page_id, archive, max(strlen(rec)) FILTER (NOT bad) AS length, max(sha256(rec)) FILTER (NOT bad) AS expected,
         max(sha256(rec)) FILTER (bad) AS rotten
  FROM r GROUP BY ALL),
o AS (SELECT *, (sum(length) OVER (PARTITION BY archive ORDER BY page_id) - length)::BIGINT AS off FROM d),
f AS (
  SELECT *, CASE WHEN archive % 13 = 3 AND (off + length) * 10 > 9 * max(off + length) OVER (PARTITION BY archive) THEN NULL
                 WHEN page_id % 97 = 5 THEN rotten ELSE expected END AS found
  FROM o)
SELECT archive, off AS "offset", length, page_id, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS kind, expected, found
FROM f WHERE found IS NULL OR found <> expected
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_exact_topk": op3_exact_topk,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op3_exact_topk": OP3_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op9_warc_fixity": OP9_SQL,
}
