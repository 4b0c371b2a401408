import datetime
import json

from pyspark.sql import functions as F

from lodewright import evaluation
from lodewright.operators import failure_modes, metrics
from lodewright.sources import files
from lodewright.streaming import scorer

GOLD = """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix c: <http://www.cidoc-crm.org/cidoc-crm/> .
e:a a c:E39_Actor ; r:label "Anna"@en ; c:P74_has_current_or_former_residence e:b . e:b a c:E53_Place ; r:label "Berlin" ."""


def layout(tmp_path):
    for name in ("texts", "gold", "pred/V1", "pred/V2"):
        (tmp_path / name).mkdir(parents=True)
    rows = [{"id": f"x{i}", "domain": "d" if i else "e", "source_text": "", "gold_ttl": "", "ontologies": []} for i in range(3)]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for i in range(2):  # the third item has no files
        (tmp_path / f"texts/x{i}.txt").write_text(" Anna lives in Berlin. ")
        (tmp_path / f"gold/x{i}.ttl").write_text(GOLD)
        (tmp_path / f"pred/V1/x{i}.json").write_text(json.dumps({"id": f"x{i}", "output": f"```turtle\n{GOLD}\n```"}))
    (tmp_path / "pred/V2/x0.json").write_text(json.dumps({"id": "x0", "output": GOLD + "\nbroken"}))
    (tmp_path / "pred/V2/x1.json").write_text(json.dumps({"id": "x1", "output": ""}))
    return [str(tmp_path / x) for x in ("items.jsonl", "texts", "gold", "pred")]


def test_evaluation_from_files(spark, tmp_path):
    g = evaluation.load(spark, *layout(tmp_path))
    assert g.items.count() == 2
    scores = {(r["system"], r["text_id"]): r for r in evaluation.evaluate(g).collect()}
    for i in range(2):
        row = scores["V1", f"x{i}"]
        assert row["f1"] == row["entity_recall"] == row["type_f1"] == row["predicate_coverage"] == 1.0
    assert scores["V2", "x0"]["f1"] == 0.0 and scores["V2", "x0"]["entity_recall"] == 1.0 and ("V2", "x1") not in scores
    rows = evaluation.failure_rows(g)
    total = {r["system"]: r for r in failure_modes.summarize(rows).collect()}
    assert total["V1"]["n_parsed"] == 2 and total["V2"]["n_parsed"] == 0 and total["V2"]["n_total"] == 2
    assert {r["system"]: r["n_parsed"] for r in metrics.sensitivity_summary(evaluation.link_rows(g)).collect()} == {"V1": 2, "V2": 0}


def test_terms_and_sinks(spark, tmp_path):
    (tmp_path / "terms").mkdir()
    (tmp_path / "terms/a.txt").write_text("# note\nhttp://x/a .\n\nhttp://x/b\nhttp://x/a\n")
    assert {r["uri"] for r in files.read_terms(spark, str(tmp_path / "terms")).collect()} == {"http://x/a", "http://x/b"}
    rows = spark.createDataFrame([("V1", "a", "```\né\n```")], "system string, text_id string, output string")
    files.write_predictions(rows, str(tmp_path / "out"))
    assert "é" in next((tmp_path / "out/system=V1").glob("*.json")).read_text()
    many = spark.createDataFrame([(s, f"t{i}", f"<a> <b> {i} .") for s in ("V1", "V2") for i in range(6)], "system string, text_id string, output string").coalesce(2)
    files.write_predictions(many, str(tmp_path / "many"))
    back = files.read_predictions(spark, str(tmp_path / "many"))
    assert sorted(map(tuple, back.select(*many.columns).collect())) == sorted(map(tuple, many.collect()))
    (tmp_path / "lines/V9").mkdir(parents=True)
    (tmp_path / "lines/V9/all.json").write_text('{"id": "a", "output": "x"}\n{"id": "b", "output": "y"}\n')
    assert sorted(map(tuple, files.read_predictions(spark, str(tmp_path / "lines"), lines=True).collect())) == [("V9", "a", "x"), ("V9", "b", "y")]
    files.write_csv(rows.select("system", "text_id"), str(tmp_path / "csv"))
    assert files.read_results(spark, str(tmp_path / "csv"), "csv").count() == 1
    (tmp_path / "V1.json").write_text(json.dumps({"p": 1.0, "details": [{"id": "a", "f1": 0.5}]}))
    assert files.read_scores(spark, str(tmp_path / "V1.json")).first().asDict() == {"system": "V1", "text_id": "a", "f1": 0.5}


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [("t", "V", i, "a", "in", "b" if i % 2 else "c", t + datetime.timedelta(minutes=i)) for i in range(6)]
    spark.createDataFrame(rows, scorer.PRED).write.parquet(str(tmp_path / "in"))
    gold = spark.createDataFrame([("t", 0, "A", "in", "B")], "text_id string, seq long, sub string, rel string, obj string")
    stream = scorer.read_predictions(spark, str(tmp_path / "in"))
    q = scorer.running_precision(stream, gold).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("running").first()["precision"] == 0.5
    q = scorer.score_batches(stream, lambda b: scorer.matched(b, gold).groupBy("system").agg(F.count_if("hit").alias("hits")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("hits")).first()[0] == 3
