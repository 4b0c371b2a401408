"""How many rows a query's plan handles, where they once grew with a square of the data."""

import random

import pytest
from pyspark.sql import functions as F

from lodewright.functions import arrow
from lodewright.operators import matching, metrics, ontology

from .plans import most_rows


@pytest.fixture
def many(spark):
    """300 nodes of two classes that have shapes for 150 paths each; each node has a value of one path of its class."""
    e = lambda c: F.concat(F.lit("http://e/"), c)
    ids = spark.range(300).select(F.col("id").cast("string").alias("i"))
    kind = e(F.concat(F.lit("C"), (F.col("i").cast("int") % 2).cast("string")))
    typed = ids.select(F.lit("g").alias("graph_id"), e(F.concat(F.lit("n"), "i")).alias("s"), F.lit(ontology.RDF_TYPE).alias("p"), F.lit("uri").alias("o_kind"), kind.alias("o"))
    valued = ids.select(F.lit("g").alias("graph_id"), e(F.concat(F.lit("n"), "i")).alias("s"), e(F.concat(F.lit("p"), "i")).alias("p"), F.lit("uri").alias("o_kind"), F.lit("http://e/x").alias("o"))
    data = typed.unionByName(valued).withColumns({"lang": F.lit(None).cast("string"), "datatype": F.lit(None).cast("string")})
    shape = lambda c, d: ids.select(kind.alias("target_class"), e(F.concat(F.lit("p"), "i")).alias("path"), F.lit(c).cast("string").alias("class"), F.lit(d).cast("string").alias("datatype"), F.lit(1).alias("min_count"), F.lit(1).alias("max_count"))
    return data, shape, ontology.inferred_types(data)


def test_class_violations_meet_only_the_paths_that_nodes_have(many):
    data, shape, types = many
    found = ontology.class_violations(data, shape("http://e/D", None), types)
    assert most_rows(found, "Join") <= 600
    assert {(r["focus_node"], r["path"]) for r in found.collect()} == {(f"http://e/n{i}", f"http://e/p{i}") for i in range(300)}


def test_datatype_violations_meet_only_the_paths_that_nodes_have(many):
    data, shape, types = many
    found = ontology.datatype_violations(data, shape(None, "http://e/int"), types)
    assert most_rows(found, "Join") <= 600
    assert {(r["focus_node"], r["path"]) for r in found.collect()} == {(f"http://e/n{i}", f"http://e/p{i}") for i in range(300)}


def test_first_like_is_the_first_by_any_tier():
    draw = random.Random(7)
    short = lambda: "".join(draw.choice("ab1 ") for _ in range(draw.randrange(9)))
    long = lambda: " ".join(draw.choice(["customer#0001", "customer#0012", "old", "hall", "hail", "e12345", "t12345"]) for _ in range(draw.randrange(1, 4)))
    hits = 0
    for make in (short, long):
        for _ in range(300):
            golds, preds = [make() for _ in range(4)], [make() for _ in range(7)]
            wanted = [next((i for i, p in enumerate(preds) if arrow.smart_similarity(g, p)), -1) for g in golds]
            assert arrow.first_like(golds, preds) == wanted
            hits += sum(i > 0 for i in wanted)
    assert hits > 100
    assert arrow.first_like([None, "a"], [None, "a"]) == [-1, 1] and arrow.first_like(["a"], []) == [-1]


def test_types_by_ratio_make_no_rows_of_pairs(spark):
    systems = spark.createDataFrame([("V",)], "system string")
    label = lambda x: F.concat(F.lit(f"label {x} "), F.conv(F.substring(F.md5(F.concat(F.lit(x), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10))
    rows = lambda x: spark.range(200).select(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("text_id"), F.lit("V").alias("system"), F.when(F.col("id") + (0 if x == "b" else 2) < 2, "label a").otherwise(label(x)).alias("label"), F.array(F.lit("T")).alias("types"), F.col("id").alias("at"))
    scores = matching.type_scores(rows("a").drop("system"), rows("b"), systems)
    assert most_rows(scores, "Join", "Eval") <= 400
    assert [r["tp"] for r in scores.collect()] == [100, 100]  # each is like the first prediction of its text


def test_draws_stay_where_they_are_made(spark, monkeypatch):
    values = spark.createDataFrame([("V", i, float(i)) for i in range(50)] + [("W", i, i / 7) for i in range(20)], "system string, slot long, value double")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # whatever Spark guesses of sizes
    try:
        found = metrics.bootstrap_by_hash(values, 200)
        assert most_rows(found, "Exchange") <= 2 * 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    monkeypatch.setattr(metrics, "MOST_BROADCAST", 0)
    assert sorted(metrics.bootstrap_by_hash(values, 200).collect()) == sorted(found.collect())


def test_schemas_are_not_sent_to_the_driver(spark):
    e = lambda c, n: F.concat(F.lit(f"http://e/{c}"), F.col("id").cast("string") if n else F.lit(""))
    row = lambda p, o: spark.range(50).select(e("p", 1).alias("s"), F.lit(p).alias("p"), F.lit("uri").alias("o_kind"), o.alias("o"))
    schema = row(ontology.RDFS + "domain", e("C", 1)).unionByName(row(ontology.RDFS + "subPropertyOf", e("q", 0)))
    data = spark.range(50).select(F.lit("g").alias("graph_id"), e("n", 1).alias("s"), e("p", 1).alias("p"), F.lit("uri").alias("o_kind"), e("x", 0).alias("o"))
    found = ontology.rdfs_types(data, schema)
    assert most_rows(found, "BroadcastExchange") == 0
    assert {(r["node"], r["class"]) for r in found.collect()} == {(f"http://e/n{i}", f"http://e/C{i}") for i in range(50)}


def test_counts_shuffle_no_row_of_the_result(many):
    data, shape, types = many
    found = ontology.count_violations(data, shape(None, None), types)
    assert most_rows(found, "Exchange") <= 600
    assert found.count() == found.distinct().count() == 2 * 150 * 149  # of its class's paths each node has one
