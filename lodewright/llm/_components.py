"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import forget, written

HUBS = 4096
HUB_EDGES = 500


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for nodes that aren't the smallest of their component; label is the smallest.

    ``edges``: columns a, b, of any type that orders. Loops and repeats are allowed; an empty table
    gives an empty table. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before, state = None, _state(now)
    while state != before and state[0]:
        # Every table is named as seldom as can be: a plan holds its whole subtree for each time that it is, and the driver
        # keeps plans, stages and broadcasts.
        both = now.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("at"), F.least("m", "u").alias("m"), "n")
        # Nodes that very many others hang on are told to all; there are at most 2 * HUBS of them. Their edges are dealt
        # by the other end, whose row of least isn't used.
        hubs = F.broadcast(least.where(F.col("n") > max(HUB_EDGES, state[0] // HUBS)).select(F.col("at").alias("u"), F.col("m").alias("_m")))
        split = both.join(hubs, "u", "left").where("v > u").withColumn("at", F.when(F.col("_m").isNull(), F.col("u")).otherwise(F.col("v")))
        large = split.join(least.select("at", "m"), "at").select(F.col("v").alias("u"), F.coalesce("_m", "m").alias("v")).distinct()
        paired = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = paired.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after, fresh = written(small, name)
        forget(spark, path)
        now, path, before, state = after, fresh, state, _state(after)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _state(edges: DataFrame) -> tuple:
    """How many edges there are, and a digest of all."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
