"""Text functions on columns, all native: cleaning of Turtle answers, names, normal forms, cheap similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FENCE = r"(?is)```(?:turtle)?[ \t]*\n?(.*?)```"

# Prefixes and namespaces that count as known.
STRUCTURAL_PREFIXES = ["rdf", "rdfs", "owl", "xsd"]
ONTOLOGY_PREFIXES = ["crm", "cidoc", "cidoc-crm", "cacao", "foaf", "odrl", "prov", "schema", "sdo"]
EXTERNAL_PREFIXES = ["wd", "wikidata", "aat", "getty", "iconclass", "ex", "dc", "dcterms", "skos"]
KNOWN_PREFIXES = STRUCTURAL_PREFIXES + ONTOLOGY_PREFIXES + EXTERNAL_PREFIXES
CRM = "http://www.cidoc-crm.org/cidoc-crm/"
DOMAIN = "http://w3id.org/cacao/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
# The prefixes given to an answer that uses numbered ones and declares none.
DEFAULT_HEADER = (
    "@prefix ns1: <http://example.org/ns1/> .\n"
    "@prefix ns2: <http://example.org/ns2/> .\n"
    "@prefix ns3: <http://example.org/ns3/> .\n"
    "@prefix wd: <http://www.wikidata.org/entity/> .\n"
    "@prefix wdt: <http://www.wikidata.org/prop/direct/> .\n"
)


def safe_ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def local_name(uri: Column) -> Column:
    """What follows the last slash, and in that the last hash."""
    return F.substring_index(F.substring_index(uri, "/", -1), "#", -1)


def namespace(uri: Column) -> Column:
    """Up to and with the last hash or slash; empty if there is none."""
    return F.regexp_extract(uri, r"^(.*[#/])", 1)


def normalize(text: Column) -> Column:
    """Lower case, no punctuation, single spaces; the form of strings that aren't dates."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(text)), PUNCTUATION, ""), r"\s+", " "))


def strip_fences(text: Column) -> Column:
    """The first fenced block, else the text without stray fences; trimmed."""
    bare = F.replace(F.replace(text, F.lit("```turtle"), F.lit("")), F.lit("```"), F.lit(""))
    white = r"^\s+|\s+$"
    return F.regexp_replace(F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(bare), white, "")


def with_default_prefixes(text: Column) -> Column:
    return F.when(~text.contains("@prefix") & text.contains("ns"), F.concat(F.lit(DEFAULT_HEADER), text)).otherwise(text)


def dedupe_prefixes(text: Column) -> Column:
    """Keeps the first whole-line ``@prefix`` declaration of each name; an array fold, without a shuffle."""
    declared = r"(?U)^\s*@prefix\s+(\S+)\s+<[^>]+>\s*\.\s*$"  # the name is any run of non-blanks, with its colon
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.when(x.rlike(declared), F.regexp_extract(x, declared, 1)).alias("name")))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        again = x["name"].isNotNull() & F.array_contains(state["seen"], F.coalesce(x["name"], F.lit("")))
        seen = F.when(x["name"].isNotNull(), F.array_append(state["seen"], x["name"])).otherwise(state["seen"])
        kept = F.when(again, state["kept"]).otherwise(F.array_append(state["kept"], x["line"]))
        return F.struct(seen.alias("seen"), kept.alias("kept"))

    return F.array_join(F.aggregate(lines, start, step)["kept"], "\n")


def clean_turtle(text: Column) -> Column:
    return dedupe_prefixes(with_default_prefixes(strip_fences(text)))


#: Fixed: the declarations that count are those of this form.
PREFIX_PATTERN = r"@prefix\s+([A-Za-z][A-Za-z0-9_-]*)\s*:\s*<([^>]*)>\s*\."


def used_prefixes(docs: DataFrame, key: str = "graph_id", text: str = "text") -> DataFrame:
    """(key, prefix, uri): declared prefixes whose name begins with a letter; the last declaration counts."""
    names = F.regexp_extract_all(F.col(text), F.lit(PREFIX_PATTERN), F.lit(1))
    uris = F.regexp_extract_all(F.col(text), F.lit(PREFIX_PATTERN), F.lit(2))
    pairs = docs.select(key, F.posexplode(F.arrays_zip(names.alias("prefix"), uris.alias("uri"))).alias("pos", "x"))
    return pairs.groupBy(key, F.col("x.prefix").alias("prefix")).agg(F.max_by("x.uri", "pos").alias("uri"))


def invalid_namespace(uri: Column) -> Column:
    return ~(uri.startswith("http://") | uri.startswith("https://"))


def classify_prefix(prefix: Column, uri: Column) -> Column:
    """invalid, allowed or fabricated, tested in that order; numbered prefixes are fabricated."""
    name = F.lower(prefix)
    return (
        F.when(invalid_namespace(uri), "invalid")
        .when(name.isin(KNOWN_PREFIXES), "allowed")
        .when(name.rlike(r"^ns[0-9]+$"), "fabricated")
        .when(uri.contains(CRM) | uri.contains(DOMAIN), "allowed")
        .otherwise("fabricated")
    )


def is_same_as(relation: Column) -> Column:
    return F.regexp_replace(F.lower(relation), "[ _]", "").isin("sameas", "owl:sameas")


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def word_overlap(a: Column, b: Column, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """Common distinct words over the smaller number of distinct words; 0 if one has none. The words may be given."""
    x, y = distinct_words(a) if a_words is None else a_words, distinct_words(b) if b_words is None else b_words
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def similar_native(a: Column, b: Column, a_words: Column | None = None, b_words: Column | None = None) -> Column:
    """Equal, one inside the other (an empty string is inside any), or words overlapping by over 0.66."""
    return (a == b) | a.contains(b) | b.contains(a) | (word_overlap(a, b, a_words, b_words) > 0.66)


def may_match_by_ratio(a: Column, b: Column) -> Column:
    """False where the lengths alone rule out a sequence ratio over 0.85."""
    la, lb = F.char_length(a), F.char_length(b)
    return 2 * F.least(la, lb) > 0.85 * (la + lb)


def severity_name(uri: Column, default: str = "Violation") -> Column:
    return F.coalesce(F.substring_index(uri, "#", -1), F.lit(default))


def rounded(x: Column, digits: int) -> Column:
    """Half-even on the decimal expansion, as Python's round, but for binary ties."""
    return F.bround(x.cast("decimal(38,18)"), digits).cast("double")


def fenced_json(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?\s*", ""), r"\s*```$", "")
