"""Weighted rendezvous hashing of record keys over shards; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

SLOT_BLOCK = 200_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = 11) -> Column:
    """The shard whose score -weight / ln(u(key, shard)) is greatest, u a hash in (0, 1).

    A shard's score doesn't depend on the other shards, so that a further shard takes keys only into
    itself and each shard's share follows its weight. A weight of zero gets no key; ties go to the smaller shard.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("some weight must be positive")
    at = F.coalesce(key.cast("string"), F.lit("\x00null"))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(at, F.lit(seed), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]).cast("int")


def with_slots(rows: DataFrame, shard: str = "shard", order: Sequence[str] = ("doc_id",), block_rows: int = SLOT_BLOCK) -> DataFrame:
    """Adds slot, gapless from 0 in each shard.

    Rows are dealt by hash into blocks of about ``block_rows`` within their shard; a row's slot is its rank
    in its block plus the sizes of the blocks before, so that no task holds a whole shard.
    """
    total = rows.count()
    blocks = max(1, -(-total // block_rows))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(blocks)))
    sizes = dealt.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_block").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, [shard, "_block"]).withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long")).drop("_block", "_rank", "_start")


def shard_records(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size: the text's UTF-8 bytes (null: none) plus 8. grown_shard: the shard with one more shard of
    ``grown_weight``; it equals shard or is the new one. A null id is a key of its own; rows with equal
    ids share a shard, repeated rows get slots of their own. Extra columns aren't read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    base = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = base.withColumns({"law": F.lit("key"), "shard": rendezvous(F.col("doc_id"), weights), "grown_shard": rendezvous(F.col("doc_id"), [*weights, grown_weight])})
    return with_slots(written(rows, "shards")[0], order=("doc_id", "text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * 24)
