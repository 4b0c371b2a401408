"""Tables for publication, and their check against expected cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.functions.text import rounded


def headline_table(scores: DataFrame, metrics: tuple[str, ...] = ("f1_p", "f1_all", "oc", "rh", "entity_recall", "type_f1", "predicate_coverage")) -> DataFrame:
    """A row a system: metrics at three places, and "scored / all"."""
    shown = [rounded(F.col(m), 3).alias(m) for m in metrics]
    return scores.select("system", *shown, F.concat_ws(" / ", F.col("n_scored").cast("string"), F.col("n_total").cast("string")).alias("parsed"))


#: The failure modes' table: metric, its column in ``failure_modes.summarize``, and places (None: a whole number).
FAILURE_METRICS = [
    ("FM1 event-type recall", "event_recall_all", 3),
    ("FM2 fabricated prefixes / text", "fabricated_mean", 2),
    ("FM2 malformed URIs", "invalid_total", None),
    ("FM5 predicate-set divergence", "divergence_parsed", 3),
    ("FM6 vocabulary injection", "injection_parsed", 3),
    ("FM7 time-span detachment", "detachment_parsed", 3),
]


def failure_mode_cells(summary: DataFrame, statements: DataFrame, parsed: DataFrame, triples: DataFrame) -> DataFrame:
    """(metric, system, value) of the failure modes' table, nine metrics, values as texts.

    summary: ``failure_modes.summarize``. statements, triples: (system, n) same-as links in raw answers and in parsed ones.
    parsed: (system, shown), scored and strictly parsed texts.
    """
    shown = [F.struct(F.lit(name).alias("metric"), (F.col(c).cast("long") if places is None else rounded(F.col(c).cast("double"), places)).cast("string").alias("value")) for name, c, places in FAILURE_METRICS]
    cells = summary.select("system", F.explode(F.array(*shown)).alias("x")).select("x.metric", "system", "x.value")
    row = lambda d, name, c: d.select(F.lit(name).alias("metric"), "system", F.col(c).cast("string").alias("value"))
    return cells.unionByName(row(statements, "FM3 sameAs statements", "n")).unionByName(row(parsed, "FM4 parsed (scored / strict)", "shown")).unionByName(row(triples, "FM3 sameAs triples", "n"))


def headline_cells(table: DataFrame) -> DataFrame:
    """(cell, value) of ``headline_table``, values as texts."""
    names = [c for c in table.columns if c != "system"]
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("value")) for c in names))
    return table.select("system", F.explode(cells).alias("x")).select(F.concat_ws(" ", F.lit("T4"), "system", "x.c").alias("cell"), "x.value")


def metric_table(long: DataFrame, systems: list[str]) -> DataFrame:
    """(metric, value, system) as a row a metric and a column a system; the systems are given, so no pass finds them."""
    return long.groupBy("metric").pivot("system", systems).agg(F.first("value"))


def verify_cells(found: DataFrame, expected: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(cell, found, expected, match): numbers within the tolerance, whole numbers equal, texts equal but for blanks."""
    both = expected.withColumnRenamed("value", "expected").join(found.withColumnRenamed("value", "found"), "cell", "left")
    x, y = F.expr("try_cast(found AS DOUBLE)"), F.expr("try_cast(expected AS DOUBLE)")
    whole = ~F.col("found").contains(".") & ~F.col("expected").contains(".")
    bare = lambda c: F.regexp_replace(c, " ", "")
    close = F.when(x.isNotNull() & y.isNotNull(), F.when(whole, x == y).otherwise(F.abs(x - y) <= tolerance)).otherwise(bare("found") == bare("expected"))
    return both.select("cell", "found", "expected", F.when(F.coalesce(close, F.lit(False)), "PASS").otherwise("FAIL").alias("match"))
