"""RDF/XML and JSON-LD against the same graph in Turtle; shapes written and read again; the commands."""

import json

import pytest

from lodewright import __main__ as commands
from lodewright.operators import ontology
from lodewright.sources import graph_files, turtle
from tests.test_files_and_streams import layout

TURTLE = """@prefix e: <http://e/> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix o: <http://www.w3.org/2002/07/owl#> . @prefix x: <http://www.w3.org/2001/XMLSchema#> .
<http://e/onto> a o:Ontology .
e:C a o:Class ; r:label "Thing"@en , "Ding"@de ; r:subClassOf [ a o:Restriction ; o:onProperty e:p ; o:minCardinality "1"^^x:integer ] ; o:unionOf ( e:A e:B ) .
e:p a o:ObjectProperty ; r:domain e:C ; r:range e:C ; e:note "plain" ."""
XML = """<?xml version="1.0"?>
<rdf:RDF xml:base="http://e/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
  <owl:Ontology rdf:about="http://e/onto"/>
  <rdf:Description rdf:about="C">
    <rdf:type rdf:resource="http://www.w3.org/2002/07/owl#Class"/>
    <rdfs:label xml:lang="en">Thing</rdfs:label><rdfs:label xml:lang="de">Ding</rdfs:label>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="p"/><owl:minCardinality rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">1</owl:minCardinality></owl:Restriction></rdfs:subClassOf>
    <owl:unionOf rdf:parseType="Collection"><rdf:Description rdf:about="A"/><rdf:Description rdf:about="B"/></owl:unionOf>
  </rdf:Description>
  <owl:ObjectProperty rdf:about="p" e:note="plain"><rdfs:domain rdf:resource="C"/><rdfs:range rdf:resource="http://e/C"/></owl:ObjectProperty>
</rdf:RDF>"""
JSONLD = {
    "@context": {"@base": "http://e/", "e": "http://e/", "owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#", "range": {"@id": "rdfs:range", "@type": "@id"}, "members": {"@id": "owl:unionOf", "@container": "@list", "@type": "@id"}, "count": {"@id": "owl:minCardinality", "@type": "xsd:integer"}, "domainOf": {"@reverse": "rdfs:domain"}},
    "@graph": [
        {"@id": "onto", "@type": "owl:Ontology"},
        {"@id": "C", "@type": "owl:Class", "rdfs:label": [{"@value": "Thing", "@language": "en"}, {"@value": "Ding", "@language": "de"}], "rdfs:subClassOf": {"@type": "owl:Restriction", "owl:onProperty": {"@id": "p"}, "count": 1}, "members": ["A", "e:B"], "domainOf": {"@id": "p"}},
        {"@id": "p", "@type": "owl:ObjectProperty", "range": "C", "e:note": "plain"},
    ],
}


def shape(triples):
    """Triples with blank nodes told apart by what they say alone, as often as needed."""
    names: dict[str, str] = {}
    for _ in range(6):
        said: dict[str, list] = {}
        for _, sk, s, p, ok, o, lang, kind in triples:
            if sk == "bnode":
                said.setdefault(s, []).append((p, names.get(o, "_") if ok == "bnode" else o))
        names = {s: str(sorted(x)) for s, x in said.items()}
    return sorted((sk, names.get(s, s), p, ok, names.get(o, o), str(lang), str(kind)) for _, sk, s, p, ok, o, lang, kind in triples)


def test_formats_give_the_same_graph(spark, tmp_path):
    for name, text in (("a.ttl", TURTLE), ("b.owl", XML), ("c.jsonld", json.dumps(JSONLD))):
        (tmp_path / name).write_text(text)
    found: dict[str, list] = {}
    for r in graph_files.read_graphs(spark, str(tmp_path)).collect():
        found.setdefault(r["graph_id"], []).append(tuple(r)[1:])
    assert set(found) == {"a", "b", "c"} and len(found["a"]) == 17
    assert shape(found["b"]) == shape(found["a"]) and shape(found["c"]) == shape(found["a"])
    assert {r["graph_id"] for r in graph_files.read_graphs(spark, str(tmp_path), "*.ttl").collect()} == {"a"}


def test_rdfxml_and_jsonld_odds():
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">
      <rdf:Seq rdf:nodeID="s"><rdf:li>a</rdf:li><rdf:li rdf:nodeID="t"/></rdf:Seq>
      <e:T rdf:ID="i"><e:p rdf:parseType="Resource"><e:q>1</e:q></e:p><e:x rdf:parseType="Literal"><b>y</b></e:x><e:z e:w="v"/></e:T></rdf:RDF>"""
    said = {(p.split("#")[-1].split("/")[-1], o) for _, _, p, kind, o, _, _ in graph_files.read_rdfxml(xml, "http://base/") if kind == "literal"}
    assert said == {("_1", "a"), ("q", "1"), ("x", "<b>y</b>"), ("w", "v")}
    assert ("uri", "http://base/#i") in {(k, s) for k, s, *_ in graph_files.read_rdfxml(xml, "http://base/")}
    found = graph_files.read_jsonld('[{"@id": "http://a", "http://p": [1.5, true, null, {"@list": []}], "skipped": 1}]')
    assert [(o, d and d.split("#")[1]) for *_, o, _, d in found] == [("1.5E0", "double"), ("true", "boolean"), (turtle.RDF + "nil", None)]
    with pytest.raises(ValueError):
        graph_files.read_jsonld('{"@context": "http://elsewhere/", "@id": "http://a"}')


def test_shapes_written_and_read(spark, tmp_path):
    onto = turtle.parse_turtle(spark.createDataFrame([("o", TURTLE.replace('"Thing"', '"The \\"big\\\\\\\\ thing"'))], "graph_id string, text string"))
    shapes = ontology.shapes_from_schema(onto)
    path = str(tmp_path / "onto.shacl.ttl")
    rows = lambda d: sorted(map(str, d.select("target_class", "path", "class", "datatype", "min_count", "max_count").collect()))
    assert rows(ontology.resolve_shapes(spark, path, onto)) == rows(shapes) == rows(ontology.resolve_shapes(spark, path, None))
    assert 'Shape for The \\"big' in spark.read.text(path).first()[0]
    assert rows(ontology.resolve_shapes(spark, None, None)) == rows(ontology.basic_shapes(spark))


def test_identifiers_with_prefixes(spark):
    onto = turtle.parse_turtle(spark.createDataFrame([("o", TURTLE)], "graph_id string, text string"))
    found = {r["identifier"] for r in ontology.class_identifiers(onto, spark.createDataFrame([("e", "http://e/")], "prefix string, uri string")).collect()}
    assert found == {"http://e/C", "e:C", "Thing", "Ding", "Thing (e:C)"}


def test_commands(spark, tmp_path, capsys):
    index, texts, golds, predictions = layout(tmp_path)
    (tmp_path / "onto.owl").write_text(XML)
    (tmp_path / "expected.csv").write_text("cell,value\nT4 V1 f1_p,1.0\nT4 V2 parsed,9 / 9\nT5 FM4 parsed (scored / strict) V1,2/2\n")
    where = ["--index", index, "--texts", texts, "--golds", golds, "--predictions", predictions]
    assert commands.main(["evaluate", *where, "--ontology", str(tmp_path / "onto.owl")]) == 0
    assert {r["system"]: r["f1"] for r in json.loads(capsys.readouterr().out)} == {"V1": 1.0, "V2": 0.0}
    assert commands.main(["paper-tables", *where, "--expected", str(tmp_path / "expected.csv"), "--out", str(tmp_path / "tables.json")]) == 0
    rows = json.loads((tmp_path / "tables.json").read_text())
    assert [r["system"] for r in rows if r["table"] == "headline"] == ["V1", "V2"] and sum(r["table"] == "failure modes" for r in rows) == 9
    assert {r["cell"]: r["match"] for r in rows if r["table"] == "verification"} == {"T4 V1 f1_p": "PASS", "T4 V2 parsed": "FAIL", "T5 FM4 parsed (scored / strict) V1": "PASS"}
