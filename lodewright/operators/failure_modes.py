"""Failure modes of predicted graphs: events, namespaces, links, parsing, predicates, vocabulary, time spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.text import CRM, RDF_TYPE, RDFS_LABEL, SAME_AS, classify_prefix, invalid_namespace, local_name, rounded, safe_ratio, used_prefixes

from .graphs import LABEL_LIKE, crm_predicates, is_crm, lower_label

# The event classes of the reference ontology that count.
EVENT_CLASSES = [
    "E5_Event", "E7_Activity", "E8_Acquisition", "E9_Move",
    "E10_Transfer_of_Custody", "E11_Modification", "E12_Production",
    "E13_Attribute_Assignment", "E14_Condition_Assessment",
    "E15_Identifier_Assignment", "E16_Measurement", "E17_Type_Assignment",
    "E63_Beginning_of_Existence", "E64_End_of_Existence",
    "E65_Creation", "E66_Formation", "E67_Birth", "E68_Dissolution",
    "E69_Death", "E79_Part_Addition", "E80_Part_Removal",
    "E81_Transformation", "E83_Type_Creation", "E85_Joining",
    "E86_Leaving", "E87_Curation_Activity",
]
TIME_SPANS = ["E52_Time-Span", "E52_Time_Span"]
TIME_SPAN_EDGES = [CRM + x for x in ("P4_has_time-span", "P4_has_time_span", "P4i_is_time-span_of", "P4i_is_time_span_of")]


def event_types(triples: DataFrame, *keys: str) -> DataFrame:
    """(keys, nodes, types): distinct event nodes and their class names."""
    typed = triples.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == "uri")).select(*keys, "s", local_name(F.col("o")).alias("type")).where(F.col("type").isin(EVENT_CLASSES))
    return typed.groupBy(*keys).agg(F.countDistinct("s").alias("nodes"), F.array_sort(F.collect_set("type")).alias("types"))


def _grid(gold: DataFrame, systems: DataFrame) -> DataFrame:
    return gold.select("graph_id").distinct().crossJoin(F.broadcast(systems))


def _or_empty(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def event_recall(gold: DataFrame, pred: DataFrame, systems: DataFrame) -> DataFrame:
    """FM1: (graph_id, system, gold_events, pred_events, recall); recall over distinct class names."""
    g, p = event_types(gold, "graph_id"), event_types(pred, "graph_id", "system").withColumnsRenamed({"nodes": "p_nodes", "types": "p_types"})
    both = _grid(gold, systems).join(g, "graph_id", "left").join(p, ["graph_id", "system"], "left")
    types = _or_empty("types")
    hit = F.size(F.array_intersect(types, _or_empty("p_types")))
    return both.select("graph_id", "system", F.coalesce("nodes", F.lit(0)).alias("gold_events"), F.coalesce("p_nodes", F.lit(0)).alias("pred_events"), safe_ratio(hit, F.size(types)).alias("recall"))


def namespace_counts(docs: DataFrame, key: str = "graph_id") -> DataFrame:
    """FM2: (key, fabricated, invalid) of the prefixes that each text declares; a text without any counts 0."""
    classes = used_prefixes(docs, key).withColumn("class", classify_prefix(F.col("prefix"), F.col("uri")))
    counted = classes.groupBy(key).agg(F.count_if(F.col("class") == "fabricated").alias("fabricated"), F.count_if(invalid_namespace(F.col("uri"))).alias("invalid"))
    return docs.select(key).distinct().join(counted, key, "left").fillna(0, ["fabricated", "invalid"])


def same_as_statements(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """FM3: occurrences of owl:sameAs in raw outputs."""
    return docs.groupBy(*by).agg(F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit("owl:sameAs"))), F.lit(0)).cast("long").alias("statements"))


def parse_counts(outputs: DataFrame, status: DataFrame) -> DataFrame:
    """FM4: (system, scorable, strict, shown) from outputs (system, graph_id, text) and status (graph_id, system, valid)."""
    both = outputs.select("system", "graph_id", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("some")).join(status.select("system", "graph_id", "valid"), ["system", "graph_id"], "left")
    out = both.groupBy("system").agg(F.count_if("some").alias("scorable"), F.count_if(F.col("some") & F.coalesce("valid", F.lit(False))).alias("strict"))
    return out.withColumn("shown", F.concat_ws(" / ", F.col("scorable").cast("string"), F.col("strict").cast("string")))


def labelled_pairs(triples: DataFrame, *keys: str) -> DataFrame:
    """(keys, sl, ol, predicates): predicate names between the labels of subject and object, of the reference ontology."""
    graph = [*keys] if keys else ["graph_id"]
    labels = triples.where(F.col("p") == RDFS_LABEL).groupBy(*graph, F.col("s").alias("node")).agg(F.min_by("o", "seq").alias("label"))
    own = triples.where(is_crm(F.col("p"))).select(*graph, "s_kind", "s", local_name(F.col("p")).alias("predicate"), "o_kind", "o")
    for column, kind, to in (("s", "s_kind", "sl"), ("o", "o_kind", "ol")):
        named = labels.select(*graph, F.col("node").alias(column), F.col("label").alias("_label"))
        own = own.join(named, [*graph, column], "left").withColumn(to, lower_label(F.col(kind), F.col(column), F.col("_label"))).drop("_label")
    return own.where("sl <> '' and ol <> ''").groupBy(*graph, "sl", "ol").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))


def pair_substitution(gold: DataFrame, pred: DataFrame, systems: DataFrame, examples: int = 5) -> DataFrame:
    """FM5a: (graph_id, system, matched, substituted, rate, examples): pairs in both graphs whose predicates have none in common."""
    g = labelled_pairs(gold, "graph_id").withColumnRenamed("predicates", "gp")
    p = labelled_pairs(pred, "graph_id", "system").withColumnRenamed("predicates", "pp")
    both = p.join(g, ["graph_id", "sl", "ol"]).withColumn("swapped", ~F.arrays_overlap("gp", "pp"))
    shown = F.concat_ws(" | ", "sl", "ol", F.array_join("gp", ","), F.array_join("pp", ","))
    keys = ["graph_id", "system"]
    first = both.where("swapped").select(*keys, shown.alias("shown")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("shown"))).where(F.col("_n") <= examples)
    listed = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("shown")), "; ").alias("examples"))  # a few rows a text
    counted = both.groupBy(*keys).agg(F.count("*").alias("matched"), F.count_if("swapped").alias("substituted"))
    out = _grid(gold, systems).join(counted, keys, "left").join(listed, keys, "left").fillna(0, ["matched", "substituted"]).fillna("", ["examples"])
    return out.select(*keys, "matched", "substituted", "examples", safe_ratio(F.col("substituted"), F.col("matched")).alias("rate"))


def predicate_divergence(gold: DataFrame, pred: DataFrame, systems: DataFrame) -> DataFrame:
    """FM5b: (graph_id, system, n_pred, n_divergent, divergence): predicted ontology predicates that gold hasn't."""
    g = crm_predicates(gold).groupBy("graph_id").agg(F.collect_set("predicate").alias("g"))
    names = pred.where(is_crm(F.col("p"))).select("graph_id", "system", local_name(F.col("p")).alias("predicate"))
    p = names.groupBy("graph_id", "system").agg(F.collect_set("predicate").alias("p"))
    both = _grid(gold, systems).join(g, "graph_id", "left").join(p, ["graph_id", "system"], "left")
    out = both.select("graph_id", "system", F.size(_or_empty("p")).alias("n_pred"), F.size(F.array_except(_or_empty("p"), _or_empty("g"))).alias("n_divergent"))
    return out.withColumn("divergence", safe_ratio(F.col("n_divergent"), F.col("n_pred")))


def vocabulary_injection(gold: DataFrame, pred: DataFrame, systems: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """FM6: (graph_id, system, total, injected, rate, names): triples with a predicate outside the allowed ones, of all triples.

    ``imported``: a table of allowed addresses (column uri).
    """
    odd = ~is_crm(F.col("p")) & ~F.col("p").isin([*LABEL_LIKE, SAME_AS])
    own = pred.select("graph_id", "system", "p", odd.alias("odd"))
    if imported is not None:
        own = own.join(imported.select(F.col("uri").alias("p")).distinct().withColumn("_ok", F.lit(True)), "p", "left").withColumn("odd", F.col("odd") & F.col("_ok").isNull())
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("odd"), local_name(F.col("p"))))), ",")
    counted = own.groupBy("graph_id", "system").agg(F.count("*").alias("total"), F.count_if("odd").alias("injected"), names.alias("names"))
    out = _grid(gold, systems).join(counted, ["graph_id", "system"], "left").fillna(0, ["total", "injected"]).fillna("", ["names"])
    return out.withColumn("rate", safe_ratio(F.col("injected"), F.col("total")))


def time_span_detachment(gold: DataFrame, pred: DataFrame, systems: DataFrame) -> DataFrame:
    """FM7: (graph_id, system, total, detached, rate): time-span nodes at neither end of a time-span edge."""
    spans = pred.where((F.col("p") == RDF_TYPE) & local_name(F.col("o")).isin(TIME_SPANS)).select("graph_id", "system", F.col("s").alias("node")).distinct()
    edges = pred.where(F.col("p").isin(TIME_SPAN_EDGES)).select("graph_id", "system", F.explode(F.array("s", "o")).alias("node")).distinct()
    both = spans.join(edges.withColumn("_at", F.lit(1)), ["graph_id", "system", "node"], "left")
    counted = both.groupBy("graph_id", "system").agg(F.count("*").alias("total"), F.count_if(F.col("_at").isNull()).alias("detached"))
    out = _grid(gold, systems).join(counted, ["graph_id", "system"], "left").fillna(0, ["total", "detached"])
    return out.withColumn("rate", safe_ratio(F.col("detached"), F.col("total")))


def summarize(rows: DataFrame) -> DataFrame:
    """By system from per-text rows (parsed, event_recall, fabricated, invalid, divergence, injection, detachment, ...).

    Means are over parsed texts or over all, as the name says; totals over all.
    """
    mean = lambda c, only=False: rounded(F.coalesce(F.avg(F.when(F.col("parsed"), F.col(c)) if only else F.col(c)), F.lit(0.0)), 4)
    return rows.groupBy("system").agg(
        F.count("*").alias("n_total"), F.count_if("parsed").alias("n_parsed"),
        mean("event_recall").alias("event_recall_all"), mean("event_recall", True).alias("event_recall_parsed"),
        F.sum("fabricated").alias("fabricated_total"), F.sum("invalid").alias("invalid_total"), mean("fabricated").alias("fabricated_mean"),
        mean("substitution", True).alias("substitution_parsed"), mean("divergence", True).alias("divergence_parsed"),
        mean("injection", True).alias("injection_parsed"), mean("detachment", True).alias("detachment_parsed"),
    )


