"""Exact dedup by a heavy-hitter split; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", heavy_items: int = 256, heavy_share: float = 1e-3) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after each run of spaces becomes one space; null counts as empty.
    A Misra-Gries sketch (``approx_top_k``) names digests that may hold over ``heavy_share`` of the rows.
    An exact count verifies them; at most ``heavy_items`` winners, with their smallest id, are broadcast,
    so that their rows are decided where they lie. All other digests, and the few rows that carry a
    winner's smallest id, go through an ordinary shuffle.

    Rows with a null id take part (they sort last; a group of null ids alone keeps one). Of repeated rows
    with the smallest id one stays. Other columns, whatever their names, are not read. An empty table
    gives an empty table.
    """
    rows, _ = written(docs.select(F.col(id_column).alias("doc_id"), F.sha2(normalised(text_column), 256).alias("text_sha256")), "exact-dedup")
    total = rows.count()
    tracked = 1 << max(10, (4 * heavy_items).bit_length())
    found = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy_items}, {tracked})").alias("top")).first()["top"] if total else []
    names = [x["item"] for x in found or [] if x["count"] >= max(2, heavy_share * total)]
    counted = rows.where(F.col("text_sha256").isin(names)) if names else rows.where(F.lit(False))
    exact = counted.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where(F.col("group_size") >= max(2, heavy_share * total))
    winners = F.broadcast(exact.withColumnsRenamed({"keep_id": "_keep", "group_size": "_size"}))  # heavy_items rows at most
    split = rows.join(winners, "text_sha256", "left")
    gone = F.col("_size").isNotNull() & F.col("_keep").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("_keep"))
    here = split.where(gone).select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    order = group.orderBy(F.col("doc_id").asc_nulls_last())
    shuffled = split.where(~gone).select(
        "doc_id",
        F.coalesce("_keep", F.min("doc_id").over(group)).alias("keep_id"),
        F.coalesce("_size", F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
        "text_sha256",
    )
    return here.unionByName(shuffled)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""
