import pytest
from pyspark.sql import functions as F

from lodewright.functions import arrow, text


def one(spark, f, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(f(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a ```turtle\nx y\n``` b", "x y"), ("```\nx\n```\n```\ny\n```", "x"), ("x ``` y", "x  y"), ("  plain ", "plain"), ("```TURTLE\nx```", "x")],
)
def test_strip_fences(spark, raw, want):
    assert one(spark, text.strip_fences, raw) == want


def test_dedupe_prefixes_keeps_the_first(spark):
    raw = "@prefix a: <x> .\n@prefix a: <y> .\na:b a:c 1 .\n @prefix b: <z> ."
    assert one(spark, text.dedupe_prefixes, raw) == "@prefix a: <x> .\na:b a:c 1 .\n @prefix b: <z> ."


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("@prefix a.b: <x> .\n@prefix a.b: <y> .", "@prefix a.b: <x> ."),
        ("@prefix ex:<x> .\n@prefix ex:<y> .", "@prefix ex:<x> .\n@prefix ex:<y> ."),
        ("@prefix ex: <> .\n@prefix ex: <> .", "@prefix ex: <> .\n@prefix ex: <> ."),
        ("@prefix ex: <x> . a b c .\n@prefix ex: <x> .", "@prefix ex: <x> . a b c .\n@prefix ex: <x> ."),
    ],
)
def test_declarations_are_whole_lines_of_any_name(spark, raw, want):
    assert one(spark, text.dedupe_prefixes, raw) == want


def test_default_prefixes_only_where_none_and_numbered(spark):
    assert one(spark, text.clean_turtle, "ns1:a ns1:b 1 .").startswith("@prefix ns1:")
    assert one(spark, text.clean_turtle, "<x> <y> 1 .") == "<x> <y> 1 ."


@pytest.mark.parametrize(
    ("prefix", "uri", "want"),
    [("ns3", "ns3:", "invalid"), ("crm", "http://any/", "allowed"), ("NS1", "http://x/", "fabricated"), ("own", text.CRM, "allowed"), ("own", "https://x/", "fabricated")],
)
def test_classify_prefix(spark, prefix, uri, want):
    assert one(spark, text.classify_prefix, prefix, uri) == want


@pytest.mark.parametrize(("a", "b", "want"), [("", "x", True), ("berlin", "berlin museum", True), ("a b c", "a b d", True), ("a b", "a c", False), ("abc", "abd", False)])
def test_similar_native(spark, a, b, want):
    assert one(spark, text.similar_native, a, b) is want


def test_local_name_and_namespace(spark):
    assert one(spark, text.local_name, "http://a/b#c") == "c"
    assert one(spark, text.namespace, "http://a/b#c") == "http://a/b#"
    assert one(spark, text.namespace, "abc") == ""


def test_normalize(spark):
    assert one(spark, text.normalize, "  The  \"Big\" House! ") == "the big house"
    assert one(spark, text.normalize, "...") == ""


@pytest.mark.parametrize(("raw", "want"), [("1896", "1896"), ("12", "2000-01-12"), ("May 5", "2000-05-05"), ("1896-03-04", "1896-03-04"), ("Q55686163", "q55686163"), ("1930s", "1930s"), ("1896-01-01/1896-12-31", "1896010118961231")])
def test_normalize_dates(raw, want):
    assert arrow.normalize_string(raw, "2000-01-01") == want


def test_ratio_is_asymmetric():
    assert arrow.ratio("tide", "diet") == 0.25 and arrow.ratio("diet", "tide") == 0.5


@pytest.mark.parametrize(("word", "want"), [("consignment", "consign"), ("consistency", "consist"), ("knocked", "knock"), ("happily", "happili"), ("skies", "sky"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("ties", "tie"), ("relational", "relat"), ("kneel", "kneel"), ("crying", "cri"), ("by", "by"), ("falling", "fall"), ("agreed", "agre"), ("buildings", "build")])
def test_stem(word, want):
    assert arrow.stem(word) == want


def test_stem_text_keeps_words_alone():
    assert arrow.stem_text("The Buildings, of 1896!") == "the build of 1896"


def test_html():
    page = '<div class="mw-search-results-container"><ul><li><a href="/a">A</a> about a</li><li>none</li></ul></div><li><a href="/b">B</a></li>'
    assert arrow.list_links(page, "mw-search-results-container") == [{"title": "A", "link": "/a", "description": "about a"}]
    table = '<table class="table table-striped"><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table>'
    assert arrow.table_records(table) == [{"x": "1", "y": "2"}]
    assert arrow.table_records(None) == [] and arrow.list_links("") == []


def test_rounding(spark):
    assert one(spark, lambda x: text.rounded(x, 4), 0.00005) == 0.0
