"""Evaluation of predictions against gold graphs, from files or tables, as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions.arrow import normalize_dates, stem_text, stemmed
from lodewright.functions.lineage import checkpointed
from lodewright.functions.text import clean_turtle, strip_fences
from lodewright.operators import failure_modes as fm
from lodewright.operators import graphs, matching, metrics, report
from lodewright.operators.ontology import ontology_meta
from lodewright.sources import turtle


@dataclass
class Graphs:
    """Gold and predicted triples, strictly read and read up to the first error, with their label triples."""

    items: DataFrame
    outputs: DataFrame
    systems: DataFrame
    gold: DataFrame
    strict: DataFrame
    status: DataFrame
    prefix: DataFrame
    gold_labels: DataFrame
    pred_labels: DataFrame


def _by_system(joint: DataFrame) -> DataFrame:
    parts = F.split("graph_id", "\\|")
    return joint.withColumns({"system": parts[0], "graph_id": parts[1]})


def read_graphs(items: DataFrame, outputs: DataFrame, ontology: DataFrame | None = None, today: str = "2000-01-01", keep: Callable[[DataFrame], DataFrame] = checkpointed) -> Graphs:
    """items: text_id, domain, text, gold. outputs: system, text_id, output (not empty).

    The strict reading cleans an output fully; the reading up to the first error only strips fences. What several
    metrics use goes through ``keep``.
    """
    items, outputs = keep(items), keep(outputs)
    gold = turtle.parse_turtle(items.select(F.col("text_id").alias("graph_id"), F.col("gold").alias("text")))
    gold = keep(gold)
    joint = outputs.select(F.concat_ws("|", "system", "text_id").alias("graph_id"), "output")
    cleaned = joint.select("graph_id", clean_turtle(F.col("output")).alias("text"))
    strict, status = keep(turtle.parse_turtle(cleaned)), keep(turtle.turtle_status(cleaned))
    prefix = turtle.parse_turtle(joint.select("graph_id", strip_fences(F.col("output")).alias("text")), turtle.PREFIX)
    prefix = keep(prefix)
    form = normalize_dates(today)
    labels = lambda t: keep(matching.normalized_once(keep(graphs.label_triples(t, ontology)), form))
    gold_labels = labels(gold).withColumnRenamed("graph_id", "text_id")
    pred_labels = _by_system(labels(strict)).withColumnRenamed("graph_id", "text_id")
    systems = outputs.select("system").distinct()
    return Graphs(items, outputs, systems, gold, _by_system(strict), _by_system(status), _by_system(prefix), gold_labels, pred_labels)


def evaluate(g: Graphs, ontology: DataFrame | None = None) -> DataFrame:
    """A row a scored text and system: p, r, f1, oc, sh, rh, oh, entity_recall, type_f1, predicate_coverage, counts."""
    own = matching.on_schema(g.pred_labels, g.gold_labels)
    own = checkpointed(own)
    triple = checkpointed(matching.match_counts(g.gold_labels, own, checkpointed(matching.greedy_matches(g.gold_labels, own)), g.systems))
    to_text = lambda d: d.withColumnRenamed("graph_id", "text_id")
    per = lambda f, *c: to_text(_by_system(f(g.prefix.withColumn("graph_id", F.concat_ws("|", "system", "graph_id")).drop("system"))).select("graph_id", "system", *c))
    entities = matching.entity_recall(to_text(graphs.labelled_entities(g.gold)).select("text_id", "label"), per(graphs.labelled_entities, "label"), g.systems)
    types = matching.type_scores(to_text(graphs.type_sets(g.gold)), per(graphs.type_sets, "label", "types", "at"), g.systems)
    cover = matching.predicate_coverage(to_text(graphs.predicate_names(g.gold)), per(graphs.predicate_names, "predicate"), g.systems)
    if ontology is None:
        relations, concepts = g.items.sparkSession.createDataFrame([("sameas",)], "relation string"), []
    else:
        meta = ontology_meta(ontology)
        relations = meta.where("kind = 'relation'").select(F.col("name").alias("relation")).unionByName(g.items.sparkSession.createDataFrame([("sameas",)], "relation string"))
        concepts = [stem_text(r["name"]) for r in meta.where("kind = 'concept'").collect()]  # an ontology's names
    rates = metrics.hallucination_rates(g.items, g.pred_labels, relations, concepts, form=stemmed)
    keys = ["text_id", "system"]
    rows = g.outputs.select(*keys).join(triple.select(*keys, "p", "r", "f1"), keys, "left")
    rows = rows.join(rates.drop("n"), keys, "left").join(entities.select(*keys, F.col("recall").alias("entity_recall")), keys, "left")
    rows = rows.join(types.select(*keys, F.col("f1").alias("type_f1")), keys, "left").join(cover.select(*keys, F.col("coverage").alias("predicate_coverage")), keys, "left")
    counts = g.gold_labels.groupBy("text_id").agg(F.count("*").alias("gt_count"))
    predicted = g.pred_labels.groupBy(*keys).agg(F.count("*").alias("pred_count"))
    rows = rows.join(counts, "text_id", "left").join(predicted, keys, "left").join(g.items.select("text_id", "domain"), "text_id", "left")
    return rows.fillna(0.0, ["p", "r", "f1", "oc", "sh", "rh", "oh", "entity_recall", "type_f1", "predicate_coverage"]).fillna(0, ["gt_count", "pred_count"])


METRICS = ("p", "r", "f1", "oc", "sh", "rh", "oh", "entity_recall", "type_f1", "predicate_coverage")


def summary(scores: DataFrame, items: DataFrame, systems: DataFrame) -> DataFrame:
    """Macro averages by system, with F1 over all items."""
    macro = metrics.macro_scores(scores, "system", metrics=METRICS)
    return macro.join(metrics.f1_over_all(items, scores, systems), "system")


def failure_rows(g: Graphs, imported: DataFrame | None = None) -> DataFrame:
    """A row a text and system, also of empty and unreadable outputs: the per-text values of all failure modes."""
    keys = ["graph_id", "system"]
    grid = g.items.select(F.col("text_id").alias("graph_id")).crossJoin(F.broadcast(g.systems))  # a handful of systems
    docs = g.outputs.select(F.concat_ws("|", "system", "text_id").alias("graph_id"), strip_fences(F.col("output")).alias("text"))
    spaces = _by_system(fm.namespace_counts(docs))
    parsed = g.status.select(*keys, F.col("valid").alias("parsed"))
    rows = grid.join(parsed, keys, "left").join(spaces, keys, "left")
    for f, c, to in ((fm.event_recall, "recall", "event_recall"), (fm.pair_substitution, "rate", "substitution"), (fm.predicate_divergence, "divergence", "divergence"), (fm.time_span_detachment, "rate", "detachment")):
        rows = rows.join(f(g.gold, g.strict, g.systems).select(*keys, F.round(c, 4).alias(to)), keys, "left")
    injected = fm.vocabulary_injection(g.gold, g.strict, g.systems, imported)
    rows = rows.join(injected.select(*keys, F.round("rate", 4).alias("injection")), keys, "left")
    return rows.fillna(False, ["parsed"]).fillna(0, ["fabricated", "invalid"]).fillna(0.0, ["event_recall", "substitution", "divergence", "detachment", "injection"])


def link_rows(g: Graphs) -> DataFrame:
    """Entity-link sensitivity by text and system, with parsed."""

    def matcher(gold: DataFrame, pred: DataFrame) -> DataFrame:
        return checkpointed(matching.greedy_matches(gold, pred))

    own = checkpointed(matching.on_schema(g.pred_labels, g.gold_labels))
    rows = metrics.link_sensitivity(g.gold_labels, own, g.systems, matcher).drop("n_pred", "n_pred_sameas")
    link = F.regexp_replace(F.lower("rel"), "[ _]", "").isin("sameas", "owl:sameas")
    counted = g.pred_labels.groupBy("text_id", "system").agg(F.count("*").alias("n_pred"), F.count_if(link).alias("n_pred_sameas"))
    parsed = g.status.select(F.col("graph_id").alias("text_id"), "system", F.col("valid").alias("parsed"))
    return rows.join(counted, ["text_id", "system"], "left").join(parsed, ["text_id", "system"], "left").fillna(0, ["n_pred", "n_pred_sameas"]).fillna(False, ["parsed"])


def failure_cells(g: Graphs, imported: DataFrame | None = None) -> DataFrame:
    """(metric, system, value) of the failure modes' table."""
    raw = g.outputs.select("system", F.col("text_id").alias("graph_id"), F.col("output").alias("text"))
    links = link_rows(g).groupBy("system").agg(F.sum("n_pred_sameas").alias("n"))
    statements = fm.same_as_statements(raw, "system").withColumnRenamed("statements", "n")
    return report.failure_mode_cells(fm.summarize(failure_rows(g, imported)), statements, fm.parse_counts(raw, g.status), links)


def printed_tables(g: Graphs, ontology: DataFrame | None = None, imported: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The headline table, the failure modes' cells, and both as (cell, value) for ``report.verify_cells``."""
    headline = checkpointed(report.headline_table(summary(evaluate(g, ontology), g.items, g.systems).withColumnRenamed("f1", "f1_p")))
    cells = checkpointed(failure_cells(g, imported))
    return headline, cells, report.headline_cells(headline).unionByName(cells.select(F.concat_ws(" ", F.lit("T5"), "metric", "system").alias("cell"), "value"))


def load(spark: SparkSession, index: str, texts: str, golds: str, predictions: str, domain: str | None = None, ontology: DataFrame | None = None) -> Graphs:
    """Graphs from files."""
    from lodewright.sources.files import read_items, read_predictions

    items = read_items(spark, index, texts, golds, domain)
    outputs = read_predictions(spark, predictions).where(F.length(F.coalesce("output", F.lit(""))) > 0).join(items.select("text_id"), "text_id").select("system", "text_id", "output")
    return read_graphs(items, outputs, ontology)
