import datetime

from pyspark.sql import functions as F

from lodewright.functions import arrow, text
from lodewright.operators import graphs, ontology
from lodewright.sources import files, turtle
from lodewright.streaming import scorer

ONTO = """@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix e: <http://e/> .
<http://e/onto> a o:Ontology . e:C a o:Class ; r:label "Thing"@en , "Ding"@de . e:p a o:ObjectProperty ; r:label "part" ; r:domain e:C ; r:range e:C ."""


def onto(spark):
    return turtle.parse_turtle(spark.createDataFrame([("o", ONTO)], "graph_id string, text string"))


def test_summary_and_namespace(spark):
    o = onto(spark)
    assert {r["section"]: r["text"] for r in ontology.summary_text(ontology.ontology_summary(o)).collect()} == {"namespaces": "http://e/", "concepts": "Concept 'Thing (C)'", "relations": "Relation 'part (p)' : C -> C"}
    assert ontology.ontology_namespace(o).first()[0] == "http://e/onto#"
    prefixes = text.used_prefixes(spark.createDataFrame([("o", ONTO)], "graph_id string, text string"))
    assert {r["prefix"] for r in graphs.bound_namespaces(o, prefixes).collect()} == {"o", "r", "e"}
    assert ontology.ontology_namespace(o.where("false"), prefixes).first()[0] == "http://e/"


def test_shapes_are_kept(spark, tmp_path):
    at = str(tmp_path / "shapes")
    made = ontology.resolve_shapes(spark, at, onto(spark))
    assert made.count() == ontology.resolve_shapes(spark, at, None).count() == 2
    assert ontology.resolve_shapes(spark, None, None).count() == 1


def test_repeated_triples_and_tables(spark, tmp_path):
    o = onto(spark)
    assert turtle.distinct_triples(o.unionByName(o)).count() == o.count()
    page = spark.createDataFrame([('<table class="table-striped"><tr><th>a</th></tr><tr><td>1</td></tr></table>',)], "html string")
    assert page.select(arrow.html_table()("html")).first()[0] == [{"a": "1"}]
    files.write_json(page, str(tmp_path / "json"))
    assert files.read_results(spark, str(tmp_path / "json")).count() == 1


def test_windows_leave_late_rows_out(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 12)
    gold = spark.createDataFrame([("t", 0, "a", "in", "b")], "text_id string, seq long, sub string, rel string, obj string")
    stream = None
    for n, minute in enumerate((0, 5, 120, 1)):  # the last comes too late
        spark.createDataFrame([("t", "V", n, "a", "in", "b", t + datetime.timedelta(minutes=minute))], scorer.PRED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream or scorer.read_predictions(spark, str(tmp_path / "in"))
        q = scorer.windowed_precision(stream, gold).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r["n"], r["hits"]) for r in rows] == [(2, 2)]
    assert spark.read.parquet(str(tmp_path / "in")).agg(F.count("*")).first()[0] == 4
