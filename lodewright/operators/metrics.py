"""Averages, hallucination rates, entity-link sensitivity and bootstrap intervals."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.lineage import checkpointed
from lodewright.functions.text import is_same_as, rounded

from .matching import match_counts


def macro_scores(scores: DataFrame, *by: str, metrics: tuple[str, ...] = ("p", "r", "f1")) -> DataFrame:
    """Means of the metrics over scored rows, and how many there are."""
    return scores.groupBy(*by).agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n"))


def f1_over_all(items: DataFrame, scores: DataFrame, systems: DataFrame) -> DataFrame:
    """(system, n_total, n_scored, f1_all): items without a score count as 0."""
    grid = items.select("text_id").crossJoin(F.broadcast(systems)).join(scores.select("text_id", "system", "f1"), ["text_id", "system"], "left")
    return grid.groupBy("system").agg(F.count("*").alias("n_total"), F.count("f1").alias("n_scored"), (F.sum(F.coalesce("f1", F.lit(0.0))) / F.count("*")).alias("f1_all"))


def by_domain(scores: DataFrame, items: DataFrame) -> DataFrame:
    """Macro F1 by system and domain, with subtotals (domain null) and the total."""
    return scores.join(items.select("text_id", "domain"), "text_id").rollup("system", "domain").agg(F.avg("f1").alias("f1"), F.count("*").alias("n"))


def hallucination_rates(items: DataFrame, triples: DataFrame, relations: DataFrame, concepts: list[str], stem: Column | None = None, form=None, strict: bool = False) -> DataFrame:
    """(text_id, system, n, oc, sh, rh, oh): conformance, and subjects, relations and objects without support.

    A relation conforms if its trimmed lower-case form is in ``relations`` (column relation, a small or large table).
    A subject or object is supported if its form is inside its text's form, or inside a concept, or the other way
    round; ``strict`` leaves out empty concepts, inside which everything would be. Texts without triples rate 0.
    ``concepts`` come as an array, a bounded list.
    """
    form = form or (lambda c: F.lower(F.trim(c)))
    known = relations.select(F.lower(F.trim("relation")).alias("low")).distinct().withColumn("_known", F.lit(True))
    words = [c for c in dict.fromkeys(concepts) if c or not strict]
    texts = items.select("text_id", form(F.col("text")).alias("context"))
    rows = triples.select("text_id", "system", form(F.col("sub")).alias("fs"), form(F.col("obj")).alias("fo"), F.lower(F.trim("rel")).alias("low")).join(known, "low", "left").join(texts, "text_id")

    def supported(x: Column) -> Column:
        near = F.exists(F.array(*map(F.lit, words)), lambda c: c.contains(x) | x.contains(c)) if words else F.lit(False)
        return F.col("context").contains(x) | near

    rated = rows.select("text_id", "system", F.col("_known").isNotNull().alias("known"), supported(F.col("fs")).alias("s"), supported(F.col("fo")).alias("o"))
    share = lambda c: F.count_if(c) / F.count("*")
    return rated.groupBy("text_id", "system").agg(F.count("*").alias("n"), share(F.col("known")).alias("oc"), share(~F.col("s")).alias("sh"), share(~F.col("known")).alias("rh"), share(~F.col("o")).alias("oh"))


def link_sensitivity(gold: DataFrame, pred: DataFrame, systems: DataFrame, matcher) -> DataFrame:
    """(text_id, system, n_gold, n_gold_sameas, n_pred, n_pred_sameas, f1_full, f1_no_sameas)."""

    def f1(g: DataFrame, p: DataFrame, name: str) -> DataFrame:
        return match_counts(g, p, matcher(g, p), systems).select("text_id", "system", rounded(F.col("f1"), 4).alias(name))

    link = is_same_as(F.col("rel"))
    counts_g = gold.groupBy("text_id").agg(F.count("*").alias("n_gold"), F.count_if(link).alias("n_gold_sameas"))
    counts_p = pred.groupBy("text_id", "system").agg(F.count("*").alias("n_pred"), F.count_if(link).alias("n_pred_sameas"))
    grid = counts_g.crossJoin(F.broadcast(systems)).join(counts_p, ["text_id", "system"], "left")
    full = f1(gold, pred, "f1_full")
    without = f1(gold.where(~link), pred.where(~link), "f1_no_sameas")
    return grid.join(full, ["text_id", "system"], "left").join(without, ["text_id", "system"], "left").fillna(0, ["n_pred", "n_pred_sameas"]).fillna(0.0, ["f1_full", "f1_no_sameas"])


def sensitivity_summary(rows: DataFrame, parsed: Column | None = None) -> DataFrame:
    """By system: F1 over parsed and over all texts, with and without same-as triples, and the differences."""
    ok = F.col("parsed") if parsed is None else parsed
    mean = lambda c, when=None: rounded(F.coalesce(F.avg(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0.0)), 4)
    out = rows.groupBy("system").agg(F.count_if(ok).alias("n_parsed"), mean("f1_full", ok).alias("f1_p_full"), mean("f1_no_sameas", ok).alias("f1_p_no_sameas"), mean("f1_full").alias("f1_all_full"), mean("f1_no_sameas").alias("f1_all_no_sameas"), F.sum("n_gold_sameas").alias("gold_sameas"))
    return out.withColumns({"delta_p": rounded(F.col("f1_p_no_sameas") - F.col("f1_p_full"), 4), "delta_all": rounded(F.col("f1_all_no_sameas") - F.col("f1_all_full"), 4)})


#: At most so many scores are told to all executors.
MOST_BROADCAST = 500_000
#: About so many draws are made in a task.
TASK_DRAWS = 4_000_000


def bootstrap_by_hash(values: DataFrame, iterations: int = 10_000, alpha: float = 0.05, seed: int = 20260507) -> DataFrame:
    """(system, n, mean, ci_lo, ci_hi) from resamples drawn by hash: slot = md5(seed|system|iteration|k) mod n.

    values: system, slot (from 0, gapless), value. Bounds are order statistics of the sorted means, not
    interpolated. The draws are never told to all executors nor, up to ``MOST_BROADCAST`` scores, shuffled: the scores
    are told to all then, a row a text and system, and each resample is averaged where it is drawn; beyond that both
    are merged. A mean is a sum over a count of its own, and doesn't depend on the order of its rows beyond 12 places.
    """
    spark = values.sparkSession
    values = checkpointed(values.select("system", "slot", "value"))  # read by three branches; what made it leaves the plan
    total = values.count()
    sizes = values.groupBy("system").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    tasks = max(spark.sparkContext.defaultParallelism, min(iterations, iterations * total // TASK_DRAWS))
    grid = spark.range(0, iterations, 1, tasks).withColumnRenamed("id", "it").crossJoin(F.broadcast(sizes))  # a row a system
    draws = grid.select("system", "n", "it", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    name = F.concat_ws("|", F.lit(str(seed)), "system", F.col("it").cast("string"), F.col("k").cast("string"))
    drawn = draws.select("system", "n", "it", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long") % F.col("n")).alias("slot"))
    values = F.broadcast(values) if total <= MOST_BROADCAST else values.hint("merge")
    means = drawn.join(values, ["system", "slot"]).groupBy("system", "n", "it").agg(F.round(F.avg("value"), 12).alias("m"))
    placed = means.withColumn("at", F.row_number().over(Window.partitionBy("system").orderBy("m", "it")) - 1)
    low, high = int(iterations * alpha / 2), min(iterations - 1, int(iterations * (1 - alpha / 2)))
    bounds = placed.groupBy("system").agg(F.max(F.when(F.col("at") == low, F.col("m"))).alias("ci_lo"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("ci_hi"))
    return sizes.join(bounds, "system").select("system", "n", "mean", "ci_lo", "ci_hi")


def bootstrap_seeded(groups: list[tuple[str, list[float]]], iterations: int = 10_000, alpha: float = 0.05, seed: int = 20260507) -> list[dict]:
    """Bit-exact intervals with one shared generator, consumed group by group in the order given."""
    rng, out = random.Random(seed), []
    for name, values in groups:
        n = len(values)
        if not n:
            out.append({"name": name, "n": 0, "mean": 0.0, "ci_lo": 0.0, "ci_hi": 0.0})
            continue
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(iterations))
        out.append({"name": name, "n": n, "mean": round(sum(values) / n, 4), "ci_lo": round(means[int(iterations * alpha / 2)], 4), "ci_hi": round(means[int(iterations * (1 - alpha / 2))], 4)})
    return out


def bootstrap_grouped(values: DataFrame, iterations: int = 10_000, alpha: float = 0.05, seed: int = 20260507) -> DataFrame:
    """(system, n, mean, ci_lo, ci_hi), each system with its own generator of the same seed; a group is one system's scores."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = bootstrap_seeded([(key[0], rows.sort_values("slot")["value"].tolist())], iterations, alpha, seed)[0]
        return pd.DataFrame([(key[0], found["n"], found["mean"], found["ci_lo"], found["ci_hi"])], columns=["system", "n", "mean", "ci_lo", "ci_hi"])

    return values.groupBy("system").applyInPandas(run, "system string, n long, mean double, ci_lo double, ci_hi double")


