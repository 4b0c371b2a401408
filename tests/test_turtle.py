import pytest

from lodewright.sources import turtle

HEAD = "@prefix ex: <http://e/> .\n@prefix rdfs: <http://r#> .\n"


def triples(text, mode=turtle.STRICT):
    return [(r[2], r[3], r[5]) for r in turtle.read(text, mode)[0]]


def test_statements():
    text = HEAD + 'ex:a a ex:T ; rdfs:label "x"@en , \'y\' ; .\n# note\nPREFIX f: <http://f/>\nf:b f:c 1, 1.5, 2e3, true, "z"^^f:d .'
    rows, error = turtle.read(text)
    assert error is None and len(rows) == 8
    assert rows[1][5:7] == ("x", "en") and [r[7] for r in rows[3:7]] == [turtle.XSD + n for n in ("integer", "decimal", "double", "boolean")] and rows[7][7] == "http://f/d"


def test_blank_nodes_and_collections():
    rows, error = turtle.read(HEAD + "ex:a ex:p [ ex:q 1 ; ex:r [ ] ] .\n[ ex:s 2 ] .\n_:x ex:t ( 1 2 ) .\n[] ex:u () .")
    assert error is None
    assert [r[3] for r in rows][:3] == ["http://e/q", "http://e/r", "http://e/p"]  # a node's own triples come first
    assert sum(r[3].endswith("first") for r in rows) == 2


def test_strings():
    rows, error = turtle.read(HEAD + 'ex:a ex:p """two\n"lines\\"""" , "tab\\t\\u00e9", \'\'\'x\'y\'\'\' .')
    assert error is None and [r[5] for r in rows] == ['two\n"lines"', "tab\té", "x'y"]


@pytest.mark.parametrize("bad", ["ex:a foaf:b 1 .", "ex:a ex:b", "ex:a ex:b Object of it .", "ex:a ; ex:b .", '"x" ex:a 1 .', "ex:a ex:b 'open .", "ex:a ex:b [ ex:c 1 ."])
def test_errors_keep_what_came_before(bad):
    text = HEAD + "ex:x ex:y 1 .\n" + bad
    assert turtle.read(text)[0] == [] and turtle.read(text)[1]
    assert triples(text, turtle.PREFIX)[0] == ("http://e/x", "http://e/y", "1")


def test_repeats_count_once_and_empty_is_valid():
    assert len(triples(HEAD + "ex:a ex:b 1 . ex:a ex:b 1 .")) == 1
    assert turtle.read("") == ([], None) and turtle.read(None) == ([], None)


def test_tables(spark, tmp_path):
    docs = spark.createDataFrame([("g", HEAD + "ex:a ex:b 1 ."), ("h", "broken"), ("n", None)], "graph_id string, text string")
    assert [r["graph_id"] for r in turtle.parse_turtle(docs).collect()] == ["g"]
    status = {r["graph_id"]: (r["valid"], r["triple_count"]) for r in turtle.turtle_status(docs).collect()}
    assert status == {"g": (True, 1), "h": (False, 0), "n": (True, 0)}
    turtle.register_turtle(spark)
    docs.createOrReplaceTempView("docs")
    assert spark.sql("SELECT s FROM docs, LATERAL parse_turtle(text, 'STRICT')").count() == 1
    (tmp_path / "a.ttl").write_text(HEAD + "ex:a ex:b 1 .")
    assert spark.read.format("turtle").option("path", str(tmp_path)).load().first()["graph_id"] == "a"


def test_an_error_loses_its_list_of_objects():
    head = "@prefix e: <http://e/> . e:a e:p e:b ; "
    assert len(turtle.read(head + "e:q e:c , bare , e:d .", turtle.PREFIX)[0]) == 1
    assert len(turtle.read(head + "e:q e:c , e:d ; e:r bare .", turtle.PREFIX)[0]) == 3
    rows, error = turtle.read(head + "e:q [ e:r e:x , e:y ] , bare .", turtle.PREFIX)
    assert [r[3].rsplit("/", 1)[1] for r in rows] == ["p", "r", "r"] and error
    assert [r[3].rsplit("/", 1)[1] for r in turtle.read(head + "e:q [ e:r e:x ] , e:y .")[0]] == ["p", "r", "q", "q"]
