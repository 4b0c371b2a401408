import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodewright.functions.arrow import native_similarity, smart_similarity
from lodewright.operators import graphs, matching, metrics, ontology, pipeline, report
from lodewright.sources import turtle


def triples(spark, rows, system=False):
    return matching.normalized(spark.createDataFrame(rows, ("text_id string, " + ("system string, " if system else "") + "seq long, sub string, rel string, obj string")))


def greedy(gold, pred):
    """Greedy matching in plain Python: predictions in order, each takes the first free gold row."""
    free, hits = list(gold), []
    for p in pred:
        for g in free:
            if p[2] == g[2] and smart_similarity(p[1], g[1]) and smart_similarity(p[3], g[3]):
                hits.append((p[0], g[0]))
                free.remove(g)
                break
    return hits


def test_greedy_matches_plain_python(spark):
    r = random.Random(1)
    words = ["berlin", "berlin wall", "tide", "diet", "anna", "anne", "x y z", "x y", ""]
    make = lambda n: [(i, r.choice(words), r.choice(["in", "of"]), r.choice(words)) for i in range(n)]
    golds, preds = [make(8) for _ in range(6)], [make(9) for _ in range(6)]
    gold = triples(spark, [(f"t{t}", *x) for t, g in enumerate(golds) for x in g])
    pred = triples(spark, [(f"t{t}", "V", *x) for t, p in enumerate(preds) for x in p], True)
    found = {(x["text_id"], x["seq"], x["gold_seq"]) for x in matching.greedy_matches(gold, pred).collect()}
    assert found == {(f"t{t}", *h) for t in range(6) for h in greedy(golds[t], preds[t])}


def test_true_positives_are_distinct_and_errors_are_rows(spark):
    gold = triples(spark, [("t", 0, "a", "r", "b"), ("t", 1, "a", "r", "b"), ("t", 2, "c", "r", "d")])
    pred = triples(spark, [("t", "V", 0, "a", "r", "b"), ("t", "V", 1, "A", "r", "B"), ("t", "V", 2, "zz", "r", "qq"), ("t", "V", 3, "a", "p7", "b"), ("t", "V", 4, "a", "other", "b")], True)
    own = matching.on_schema(pred, gold)
    row = matching.match_counts(gold, own, matching.greedy_matches(gold, own), spark.createDataFrame([("V",)], "system string")).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 1)


def test_identity_scores_one(spark):
    rows = [(f"t{t}", i, f"s{i}", f"r{i % 3}", f"o{i} x{i}") for t in range(3) for i in range(7)]
    gold = triples(spark, rows)
    pred = triples(spark, [(t, "V", *x) for t, *x in rows], True)
    systems = spark.createDataFrame([("V",)], "system string")
    for scored in (matching.exact_scores(gold, pred, systems), matching.match_counts(gold, pred, matching.greedy_matches(gold, pred), systems)):
        assert {(r["p"], r["r"], r["f1"]) for r in scored.collect()} == {(1.0, 1.0, 1.0)}


def test_labels(spark):
    text = """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix c: <http://c/> .
    e:a r:label "Anne"@fr , "Anna"@en , "other" ; e:knows e:b_c , [ a c:T ; e:v "1" ] , "Area: 1,500" . e:d r:label "first" , "second" ."""
    g = turtle.parse_turtle(spark.createDataFrame([("g", text)], "graph_id string, text string"))
    got = {(r["sub"], r["rel"], r["obj"]) for r in graphs.label_triples(g).collect()}
    assert ("Anna", "knows", "b c") in got and ("Anna", "knows", "1,500") in got and ("Anna", "knows", "T v=1") in got and ("T v=1", "v", "1") in got
    assert {r["node"]: r["label"] for r in graphs.english_labels(g).collect()} == {"http://e/a": "Anna", "http://e/d": "first"}


def test_entity_recall_and_types_fuzzy(spark):
    systems = spark.createDataFrame([("V",)], "system string")
    gold = spark.createDataFrame([("t", "Berlin"), ("t", "Paris"), ("t", "architecture")], "text_id string, label string")
    pred = spark.createDataFrame([("t", "V", "BERLIN"), ("t", "V", "architectures"), ("t", "V", "pariss")], "text_id string, system string, label string")
    assert matching.entity_recall(gold, pred, systems).first()["matched"] == 3
    pred = pred.where("label <> 'architectures'").unionByName(spark.createDataFrame([("t", "V", "architektura")], pred.schema))
    assert matching.entity_recall(gold, pred, systems, ratio=False).first()["matched"] == 2
    g = spark.createDataFrame([("t", "Berlin", ["A", "B"], 0), ("t", "Paris", ["A"], 1)], "text_id string, label string, types array<string>, at long")
    p = spark.createDataFrame([("t", "V", "Berlin wall", ["C"], 0), ("t", "V", "berlin", ["A", "C"], 1)], "text_id string, system string, label string, types array<string>, at long")
    row = matching.type_scores(g, p, systems).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 2)


def test_types_go_by_the_order_of_their_objects(spark):
    text = """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> .
    e:a a e:T . e:b a e:U , e:T ; r:label "one" , "two" . e:c r:label "two" , "one" ; a e:U ."""
    g = turtle.parse_turtle(spark.createDataFrame([("g", text)], "graph_id string, text string"))
    got = [(r["label"], r["types"]) for r in graphs.type_sets(g).orderBy("at").collect()]
    # "two" comes after "one" as an object, so that both subjects are called so; of the type T all are before those of U.
    assert got == [("a", ["T"]), ("two", ["T", "U"])]


def test_bootstrap(spark):
    values = spark.createDataFrame([("V", i, float(i)) for i in range(10)], "system string, slot long, value double")
    row = metrics.bootstrap_by_hash(values, 100).first()
    assert row["n"] == 10 and row["ci_lo"] <= row["mean"] <= row["ci_hi"]
    draws = lambda it: [int(hashlib.md5(f"20260507|V|{it}|{k}".encode()).hexdigest()[:12], 16) % 10 for k in range(10)]
    means = sorted(sum(draws(it)) / 10 for it in range(100))
    assert (row["ci_lo"], row["ci_hi"]) == pytest.approx((means[2], means[97])) and len({tuple(draws(it)) for it in range(100)}) == 100
    assert metrics.bootstrap_seeded([("x", [])])[0]["mean"] == 0.0
    again = [metrics.bootstrap_seeded([("x", [0.0, 1.0, 0.5])], 200) for _ in range(2)]
    assert again[0] == again[1]


def test_shapes_of_restrictions(spark):
    text = """@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix e: <http://e/> .
    e:C a o:Class ; r:subClassOf [ a o:Restriction ; o:onProperty e:p ; o:minCardinality 2 ] , [ a o:Restriction ; o:onProperty e:q ; o:maxCardinality 0 ] , [ a o:Restriction ; o:onProperty e:s ; o:someValuesFrom e:D ] ."""
    onto = turtle.parse_turtle(spark.createDataFrame([("o", text)], "graph_id string, text string"))
    got = {(r["path"], r["class"], r["min_count"], r["max_count"]) for r in ontology.shapes_from_schema(onto).collect()}
    assert got == {(None, None, None, None), ("http://e/p", None, 2, None), ("http://e/s", "http://e/D", 1, None)}


def test_violations_and_status(spark):
    data = turtle.parse_turtle(spark.createDataFrame([("g", "@prefix e: <http://e/> . e:a a e:C ; e:p e:b . e:b a e:X .")], "graph_id string, text string"))
    shapes = spark.createDataFrame([("http://e/C", "http://e/p", "http://e/D", None, 1, 1), ("http://e/C", "http://e/q", None, None, 1, None)], ontology.SHAPES)
    assert sorted(r["path"] for r in ontology.violations(data, shapes).collect()) == ["http://e/p", "http://e/q"]
    edges = spark.createDataFrame([("http://e/X", "http://e/D")], "sub string, sup string")
    assert [r["path"] for r in ontology.violations(data, shapes, ontology.closure(edges)).collect()] == ["http://e/q"]


def test_closure_of_a_long_chain_and_of_diamonds(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    assert ontology.closure(spark.createDataFrame(chain, "sub string, sup string")).count() == 41 * 42 // 2
    diamonds = [(f"d{i}", f"{x}{i}") for i in range(12) for x in "lr"] + [(f"{x}{i}", f"d{i + 1}") for i in range(12) for x in "lr"]
    found = ontology.closure(spark.createDataFrame(diamonds, "sub string, sup string"))
    assert found.where("sub = 'd0'").count() == 1 + 12 * 3 and found.count() == found.distinct().count()
    cycle = ontology.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "sub string, sup string"))
    assert {(r["sub"], r["sup"]) for r in cycle.collect()} == {(x, y) for x in "ab" for y in "ab"}
    assert ontology.closure(spark.createDataFrame([], "sub string, sup string")).count() == 0


def test_rdfs_types(spark):
    text = """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> .
    e:q r:subPropertyOf e:p . e:p r:domain e:A ; r:range e:B . e:A r:subClassOf e:C . e:x e:q e:y . e:z e:p "text" ."""
    g = turtle.parse_turtle(spark.createDataFrame([("g", text)], "graph_id string, text string"))
    got = {(r["node"][-1], r["class"][-1]) for r in ontology.rdfs_types(g, g).collect()}
    assert got == {("x", "A"), ("x", "C"), ("z", "A"), ("z", "C"), ("y", "B")}
    shapes = spark.createDataFrame([("http://e/C", "http://e/name", None, None, 1, None)], ontology.SHAPES)
    assert {r["focus_node"] for r in ontology.violations(g, shapes, schema=g).collect()} == {"http://e/x", "http://e/z"}


def test_greedy_compares_few_pairs():
    asked = []

    def like(a, b):
        asked.append((a, b))
        return native_similarity(a, b)

    pred = [(f"s{i}", f"o{i % 20}") for i in range(400)]
    found = matching.first_free(pred, pred, like)
    assert found == [(i, i) for i in range(400)] and len(asked) < 400 * 400 / 10 and len(asked) == len(set(asked))


def test_closure_with_a_cycle(spark):
    got = ontology.closure(spark.createDataFrame([("a", "b"), ("b", "c")], "sub string, sup string"))
    assert {(r["sub"], r["sup"]) for r in got.collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "c"), ("a", "c")}


def test_generation_keeps_failures_apart(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "bad")], "text_id string, text string")

    def generator(stage, row):
        if row["text"] == "bad":
            raise ValueError("no answer")
        return f"{stage} of {row['text']}"

    rows = {r["text_id"]: r for r in pipeline.run_variant(docs, "baseline", generator).collect()}
    assert rows["a"]["output"] == "rdf_kg of x" and rows["b"]["status"].startswith("error") and rows["b"]["output"] is None


def test_contracts(spark):
    answers = spark.createDataFrame([(1, '```json\n[{"entity": "x", "class": "C"}]\n```'), (2, "nothing")], "id long, answer string")
    got = {r["id"]: r["parsed"] for r in pipeline.parse_answers(answers, "named_entities").collect()}
    assert got[1][0]["entity"] == "x" and not got[2]
    entities = spark.createDataFrame([(1, "x and y", "x"), (1, "x and y", "w")], "doc_id long, text string, entity string")
    relations = spark.createDataFrame([(1, "x", "knows", "y")], "doc_id long, head string, relation string, tail string")
    assert {(r["breach"], r["item"]) for r in pipeline.contract_breaches(entities, relations).collect()} == {("entity not in text", "w"), ("tail unknown", "y")}
    assert [r[0] for r in spark.createDataFrame([("VALID",), ("INVALID",)], "x string").select(pipeline.verdict(F.col("x"))).collect()] == [True, False]


def test_verify_cells(spark):
    found = spark.createDataFrame([("a", "0.1004"), ("b", "3"), ("c", "30/14")], "cell string, value string")
    expected = spark.createDataFrame([("a", "0.100"), ("b", "4"), ("c", "30 / 14"), ("d", "1")], "cell string, value string")
    assert {r["cell"]: r["match"] for r in report.verify_cells(found, expected).collect()} == {"a": "PASS", "b": "FAIL", "c": "PASS", "d": "FAIL"}
