"""WARC records and Merkle fixity audits of their replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import Tables


#: Archives of records without an id, by the first four digits of their digest.
LOOSE = 1 << 16


def record(url: Column, key: Column, payload: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A resource record as WARC 1.0 text with all mandatory fields; null url or payload: empty. The tables hold no fetch times, so `date` stands for all."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def layout(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_archive: int = 256) -> DataFrame:
    """Records in archive files of `per_archive` consecutive ids: (archive, offset, length, id, digest).

    Records are built and hashed where they are read; only digests and lengths move. Within an
    archive they follow by id, then digest. Rows with a null id are told by their digest alone and
    spread over 65536 archives of negative number by it, so an altered one is missing in its place
    and surplus elsewhere. Repeated rows are records of their own; texts of any length are hashed whole.
    Other columns are not read. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), record(F.col(url_col), F.col(id_col), F.col(payload_col)).alias("r"))
    rows = rows.select("id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("digest"))
    loose = -1 - F.conv(F.substring("digest", 1, 4), 16, 10).cast("long")
    rows = rows.select(F.coalesce(F.expr(f"id div {per_archive}"), loose).alias("archive"), "id", "length", "digest")
    before = Window.partitionBy("archive").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def trees(leaves: DataFrame, depth: int, range_bytes: int, fan_out: int, tables: Tables) -> list[DataFrame]:
    """Merkle levels from the leaves to the roots, each (archive, parent, node, digest), each written once and built from the one below.

    Level 1 nodes are ranges of `range_bytes` of offsets, a node above joins `fan_out` ranges. A node's
    digest covers its children's digests with their places, in order.
    """
    levels = [leaves.select("archive", F.expr(f"offset div {range_bytes}").alias("parent"), F.col("offset").alias("node"), F.sha2(F.concat_ws(" ", "offset", "length", "digest"), 256).alias("digest"))]
    for _ in range(depth):
        child = F.concat_ws(" ", F.lpad("node", 20, "0"), "digest")
        up = levels[-1].groupBy("archive", F.col("parent").alias("node")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(child))), 256).alias("digest"))
        levels.append(tables.keep(up.withColumn("parent", F.expr(f"node div {fan_out}"))))
    return levels


def audit(replica_a: DataFrame, replica_b: DataFrame, range_bytes: int = 1 << 18, fan_out: int = 16) -> DataFrame:
    """Records that differ between two replicas' layouts: (archive, offset, length, id, kind, expected, found).

    kind: altered, missing (in b) or surplus (in b). Roots are compared first; children are joined only
    under nodes that mismatch, level by level. Each replica's leaves are hashed once, and every level of
    its tree is written once to the checkpoint folder, so the descent reads a level's nodes and not the
    leaves again. Records that repeat at one offset (none in a well-formed archive) are compared as a set.
    Null ids are compared by place. Empty replicas differ in nothing; against an empty one every record is
    missing or surplus.
    """
    tables = Tables(replica_a.sparkSession)
    a, b = tables.keep(replica_a), tables.keep(replica_b)
    ends = [x.agg(F.max(F.col("offset") + 1)).first()[0] or 1 for x in (a, b)]
    depth, span = 1, range_bytes
    while span < max(ends):
        depth, span = depth + 1, span * fan_out
    ta, tb = (trees(x, depth, range_bytes, fan_out, tables) for x in (a, b))
    bad: DataFrame | None = None
    for level in range(depth, 0, -1):
        left, right = (t[level].select("archive", "node", "parent", F.col("digest").alias(d)) for t, d in ((ta, "da"), (tb, "db")))
        if bad is not None:
            left, right = (x.join(bad.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi") for x in (left, right))
        both = left.drop("parent").join(right.drop("parent"), ["archive", "node"], "full")
        bad = tables.keep(both.where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "node"))
        tables.drop(ta[level], tb[level])
    inside = lambda x: x.withColumn("node", F.expr(f"offset div {range_bytes}")).join(bad, ["archive", "node"], "left_semi")
    left = inside(a).select("archive", "offset", F.col("id").alias("id_a"), F.col("length").alias("n_a"), F.col("digest").alias("expected"))
    right = inside(b).select("archive", "offset", F.col("id").alias("id_b"), F.col("length").alias("n_b"), F.col("digest").alias("found"))
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "surplus").otherwise("altered")
    differs = left.join(right, ["archive", "offset"], "full").where(~(F.col("expected").eqNullSafe(F.col("found")) & F.col("n_a").eqNullSafe(F.col("n_b"))))
    return differs.select(
        "archive", "offset", F.coalesce("n_a", "n_b").alias("length"), F.coalesce("id_a", "id_b").alias("id"), kind.alias("kind"), "expected", "found"
    )
