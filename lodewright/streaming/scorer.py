"""A stream of predicted triples against static gold triples: matches as they come, and running averages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodewright.functions.text import safe_ratio
from lodewright.operators.matching import normalized

PRED = "text_id string, system string, seq long, sub string, rel string, obj string, ts timestamp"


def read_predictions(spark: SparkSession, path: str, schema: str = PRED) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def matched(stream: DataFrame, gold: DataFrame) -> DataFrame:
    """Each prediction with hit: whether its normal triple is in gold; a stream-static join on equal keys."""
    keys = ["text_id", "nsub", "nrel", "nobj"]
    known = normalized(gold).select(*keys).distinct().withColumn("_hit", F.lit(True))
    return normalized(stream).join(known, keys, "left").withColumn("hit", F.col("_hit").isNotNull()).drop("_hit")


def running_precision(stream: DataFrame, gold: DataFrame) -> DataFrame:
    """(system, n, hits, precision), for complete mode; the state is a row a system."""
    return matched(stream, gold).groupBy("system").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("precision", safe_ratio(F.col("hits"), F.col("n")))


def windowed_precision(stream: DataFrame, gold: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, system, n, hits) by event time; rows later than the watermark are left out, closed windows leave the state."""
    rows = matched(stream.withWatermark("ts", late), gold)
    return rows.groupBy(F.window("ts", window).alias("w"), "system").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).select(F.col("w.start").alias("start"), "system", "n", "hits")


def score_batches(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores each micro-batch with ``score`` and keeps it under its number, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
