"""Gold and predicted graphs derived from the star schema, as DataFrames and as SQL.

Fifty customers in a row are a text, so that texts grow in number with the data and not in length; a customer's gold
triples follow from its row. Several customers of a text share a household, so that gold triples are alike. Systems V1, V2 and V4
are perturbations: they drop, change, repeat and invent triples by the key's remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions.text import CRM, RDF_TYPE, RDFS_LABEL, SAME_AS

EX = "http://example.org/"
SYSTEMS = [("V1", 0), ("V2", 1), ("V4", 2)]
TEXT_CUSTOMERS = 50
DOMAINS = ["sound", "sound", "architecture", "fashion", "olympic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, "system string, m int").select("system")


def _salted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, "system string, m int")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor(F.col("c_custkey") / TEXT_CUSTOMERS)
    ids = table(spark, sf_dir, "customer").select(number.alias("id")).distinct().withColumn("text_id", F.concat(F.lit("t"), F.col("id").cast("string")))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("id") % len(DOMAINS)).cast("int") + 1)
    return ids.select("text_id", domain.alias("domain"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, text_id, c_name, segment, balance, nation, n_name: a row a customer."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")  # 25 rows
    own = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.select(F.col("c_custkey").alias("c"), F.concat(F.lit("t"), F.floor(F.col("c_custkey") / TEXT_CUSTOMERS).cast("string")).alias("text_id"), "c_name", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("long").cast("string").alias("balance"), F.col("c_nationkey").alias("nation"), "n_name")


BASE_SQL = f"""base AS (
  SELECT c_custkey AS c, 't' || CAST(c_custkey // {TEXT_CUSTOMERS} AS VARCHAR) AS text_id, c_name, c_mktsegment AS segment,
         CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) AS balance, c_nationkey AS nation, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), systems(system, m) AS (VALUES ('V1', 0), ('V2', 1), ('V4', 2)),
items AS (
  SELECT 't' || CAST(i AS VARCHAR) AS text_id, list_extract(['sound', 'sound', 'architecture', 'fashion', 'olympic'], CAST(i % 5 AS INT) + 1) AS domain
  FROM (SELECT DISTINCT c_custkey // {TEXT_CUSTOMERS} AS i FROM customer)
)"""


# -- label triples --------------------------------------------------------------------------------------------------


def gold_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, seq, sub, rel, obj."""
    row = lambda k, rel, obj: F.struct((F.col("c") * 4 + k).alias("seq"), F.col("c_name").alias("sub"), F.lit(rel).alias("rel"), obj.alias("obj"))
    rows = F.array(row(0, "lives in", F.col("n_name")), row(1, "has segment", F.col("segment")), row(2, "sameAs", F.concat(F.lit("Q"), F.col("c").cast("string"))))
    home = F.array(F.struct((F.col("c") * 4 + 3).alias("seq"), F.concat("n_name", F.lit(" household")).alias("sub"), F.lit("member of").alias("rel"), F.col("segment").alias("obj")))
    return base(spark, sf_dir).select("text_id", F.explode(F.concat(home, F.when(F.col("c") % 5 == 0, rows).otherwise(F.slice(rows, 1, 2)))).alias("x")).select("text_id", "x.*")


GOLD_SQL = """gold AS (
  SELECT text_id, c * 4 AS seq, c_name AS sub, 'lives in' AS rel, n_name AS obj FROM base
  UNION ALL SELECT text_id, c * 4 + 1, c_name, 'has segment', segment FROM base
  UNION ALL SELECT text_id, c * 4 + 2, c_name, 'sameAs', 'Q' || CAST(c AS VARCHAR) FROM base WHERE c % 5 = 0
  UNION ALL SELECT text_id, c * 4 + 3, n_name || ' household', 'member of', segment FROM base
)"""


def pred_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, system, seq, sub, rel, obj; some texts of a system are empty."""
    salted = base(spark, sf_dir).crossJoin(F.broadcast(_salted(spark)))  # three systems
    at = F.col("c") + F.col("m")
    text_no = F.floor(F.col("c") / TEXT_CUSTOMERS)
    kept = salted.where((at % 3 != 0) & ((text_no + 7 * F.col("m")) % 9 != 0)).withColumn("mark", at)
    changed = F.when(F.col("mark") % 4 == 1, F.concat(F.upper("n_name"), F.lit("!"))).when(F.col("mark") % 4 == 2, F.concat(F.lit("somewhere "), F.col("c").cast("string"))).otherwise(F.col("n_name"))
    relation = F.when(F.col("mark") % 7 == 0, "has segment").when(F.col("mark") % 11 == 0, "born in").when(F.col("mark") % 13 == 0, "p74").otherwise("lives in")
    row = lambda k, rel, obj: F.struct((F.col("c") * 8 + k).alias("seq"), F.col("c_name").alias("sub"), rel.alias("rel"), obj.alias("obj"))
    rows = F.array(row(0, relation, changed), row(1, F.lit("has segment"), F.lower("segment")))
    again = F.when(F.col("mark") % 13 == 1, F.array(row(2, F.lit("has segment"), F.lower("segment")))).otherwise(F.array().cast("array<struct<seq:bigint,sub:string,rel:string,obj:string>>"))
    links = F.when(F.col("mark") % 5 == 1, F.array(row(3, F.lit("same as"), F.concat(F.lit("Q"), F.col("c").cast("string"))))).otherwise(F.array().cast("array<struct<seq:bigint,sub:string,rel:string,obj:string>>"))
    household = F.when(F.col("mark") % 4 == 0, F.col("n_name")).when(F.col("mark") % 4 == 1, F.concat(F.upper("n_name"), F.lit(" household!"))).when(F.col("mark") % 4 == 2, F.concat(F.lit("the old household of "), "n_name")).otherwise(F.lit("household"))
    home = F.array(F.struct((F.col("c") * 8 + 4).alias("seq"), household.alias("sub"), F.lit("Member of").alias("rel"), F.when(F.col("mark") % 5 == 2, F.lit("none")).otherwise(F.lower("segment")).alias("obj")))
    return kept.select("text_id", "system", F.explode(F.concat(rows, again, links, home)).alias("x")).select("text_id", "system", "x.*")


PRED_SQL = f"""kept AS (
  SELECT base.*, system, c + m AS mark FROM base, systems WHERE (c + m) % 3 <> 0 AND (c // {TEXT_CUSTOMERS} + 7 * m) % 9 <> 0
), pred AS (
  SELECT text_id, system, c * 8 AS seq, c_name AS sub,
         CASE WHEN mark % 7 = 0 THEN 'has segment' WHEN mark % 11 = 0 THEN 'born in' WHEN mark % 13 = 0 THEN 'p74' ELSE 'lives in' END AS rel,
         CASE WHEN mark % 4 = 1 THEN upper(n_name) || '!' WHEN mark % 4 = 2 THEN 'somewhere ' || CAST(c AS VARCHAR) ELSE n_name END AS obj
  FROM kept
  UNION ALL SELECT text_id, system, c * 8 + 1, c_name, 'has segment', lower(segment) FROM kept
  UNION ALL SELECT text_id, system, c * 8 + 2, c_name, 'has segment', lower(segment) FROM kept WHERE mark % 13 = 1
  UNION ALL SELECT text_id, system, c * 8 + 3, c_name, 'same as', 'Q' || CAST(c AS VARCHAR) FROM kept WHERE mark % 5 = 1
  UNION ALL SELECT text_id, system, c * 8 + 4, CASE WHEN mark % 4 = 0 THEN n_name WHEN mark % 4 = 1 THEN upper(n_name) || ' household!' WHEN mark % 4 = 2 THEN 'the old household of ' || n_name ELSE 'household' END,
         'Member of', CASE WHEN mark % 5 = 2 THEN 'none' ELSE lower(segment) END FROM kept
)"""

_PUNCTUATION_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(translate(lower(trim({x})), {_PUNCTUATION_SQL}, ''), '\\s+', ' ', 'g'))"


NORM_SQL = f"""g AS (SELECT *, {norm_sql("sub")} AS nsub, {norm_sql("rel")} AS nrel, {norm_sql("obj")} AS nobj FROM gold),
p AS (SELECT *, {norm_sql("sub")} AS nsub, {norm_sql("rel")} AS nrel, {norm_sql("obj")} AS nobj FROM pred)"""

TRIPLES_SQL = f"WITH RECURSIVE {BASE_SQL}, {GOLD_SQL}, {PRED_SQL}, {NORM_SQL}"


# -- RDF triples ----------------------------------------------------------------------------------------------------

# seq, subject (kind, value), predicate, object (kind, value, language), condition; mark is the key plus the system's number.
_COMMON = [
    (3, "uri", f"'{EX}c' || {{c}}", "P74", "uri", f"'{EX}n' || {{n}}", "NULL"),
    (5, "uri", f"'{EX}n' || {{n}}", "label", "literal", "n_name", "NULL"),
    (4, "uri", f"'{EX}n' || {{n}}", "type", "uri", f"'{CRM}E53_Place'", "NULL"),
    (7, "uri", f"'{EX}e' || {{c}}", "P14", "uri", f"'{EX}c' || {{c}}", "NULL"),
    (9, "uri", f"'{EX}t' || {{c}}", "type", "uri", f"'{CRM}E52_Time-Span'", "NULL"),
    (10, "bnode", "'_:b' || {c}", "P90", "literal", "balance", "NULL"),
    (11, "bnode", "'_:b' || {c}", "type", "uri", f"'{CRM}E54_Dimension'", "NULL"),
    (12, "uri", f"'{EX}c' || {{c}}", "P43", "bnode", "'_:b' || {c}", "NULL"),
]
_PREDICATES = {"type": RDF_TYPE, "label": RDFS_LABEL, "sameAs": SAME_AS, "P74": CRM + "P74_has_current_or_former_residence", "P14": CRM + "P14_carried_out_by", "P4": CRM + "P4_has_time-span", "P90": CRM + "P90_has_value", "P43": CRM + "P43_has_dimension", "home": "http://schema.org/homeLocation"}
_EVENTS = f"CASE c % 3 WHEN 0 THEN '{CRM}E7_Activity' WHEN 1 THEN '{CRM}E12_Production' ELSE '{CRM}E65_Creation' END"
_GOLD = [
    (1, "uri", f"'{EX}c' || {{c}}", "type", "uri", f"'{CRM}E39_Actor'", "NULL", "true"),
    (2, "uri", f"'{EX}c' || {{c}}", "label", "literal", "c_name", "CASE WHEN c % 2 = 0 THEN 'en' END", "true"),
    (6, "uri", f"'{EX}e' || {{c}}", "type", "uri", _EVENTS, "NULL", "true"),
    (8, "uri", f"'{EX}e' || {{c}}", "P4", "uri", f"'{EX}t' || {{c}}", "NULL", "true"),
    *((*x, "true") for x in _COMMON),
]
_PRED = [
    (1, "uri", f"'{EX}c' || {{c}}", "type", "uri", f"CASE WHEN mark % 4 = 1 THEN '{CRM}E21_Person' ELSE '{CRM}E39_Actor' END", "NULL", "true"),
    (2, "uri", f"'{EX}c' || {{c}}", "label", "literal", "CASE WHEN mark % 8 = 3 THEN upper(c_name) WHEN mark % 8 = 4 THEN 'the ' || c_name ELSE c_name END", "CASE WHEN c % 2 = 0 THEN 'en' END", "true"),
    (6, "uri", f"'{EX}e' || {{c}}", "type", "uri", f"CASE WHEN mark % 6 = 2 THEN '{CRM}E5_Event' ELSE {_EVENTS} END", "NULL", "true"),
    (8, "uri", f"'{EX}e' || {{c}}", "P4", "uri", f"'{EX}t' || {{c}}", "NULL", "mark % 7 <> 0"),
    *((*x, "mark % 5 <> 0" if x[3] == "P74" else "true") for x in _COMMON),
    (13, "uri", f"'{EX}c' || {{c}}", "home", "uri", f"'{EX}n' || {{n}}", "NULL", "mark % 5 = 0"),
    (14, "uri", f"'{EX}c' || {{c}}", "sameAs", "uri", "'http://www.wikidata.org/entity/Q' || {c}", "NULL", "mark % 5 = 1"),
]


def _rdf_spark(rows: DataFrame, spec: list[tuple], *keys: str) -> DataFrame:
    """All of a row's triples from one pass over it."""
    place = {"c": "CAST(c AS STRING)", "n": "CAST(nation AS STRING)"}
    made = []
    for seq, s_kind, s, p, o_kind, o, lang, when in spec:
        made.append(
            f"CASE WHEN {when} THEN named_struct('seq', CAST(c * 16 + {seq} AS BIGINT), 's_kind', '{s_kind}', 's', {s.format(**place)}, 'p', '{_PREDICATES[p]}', "
            f"'o_kind', '{o_kind}', 'o', {o.format(**place)}, 'lang', CAST({lang} AS STRING), 'datatype', CAST(NULL AS STRING)) END"
        )
    array = F.expr(f"array({', '.join(made)})")
    return rows.select(F.col("text_id").alias("graph_id"), *keys, F.explode(F.filter(array, lambda x: x.isNotNull())).alias("x")).select("graph_id", *keys, "x.*")


def _rdf_sql(source: str, spec: list[tuple], keys: str = "") -> str:
    place = {"c": "CAST(c AS VARCHAR)", "n": "CAST(nation AS VARCHAR)"}
    return "\n  UNION ALL ".join(
        f"SELECT text_id AS graph_id, {keys}c * 16 + {seq} AS seq, '{s_kind}' AS s_kind, {s.format(**place)} AS s, '{_PREDICATES[p]}' AS p, '{o_kind}' AS o_kind, {o.format(**place)} AS o, CAST({lang} AS VARCHAR) AS lang FROM {source} WHERE {when}"
        for seq, s_kind, s, p, o_kind, o, lang, when in spec
    )


def gold_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rdf_spark(base(spark, sf_dir), _GOLD)


def pred_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With system; graph_id is the text's."""
    salted = base(spark, sf_dir).crossJoin(F.broadcast(_salted(spark))).withColumn("mark", F.col("c") + F.col("m"))  # three systems
    return _rdf_spark(salted.where("mark % 3 <> 0"), _PRED, "system")


_RDF_BODY = f"""salted AS (SELECT base.*, system, c + m AS mark FROM base, systems WHERE (c + m) % 3 <> 0),
grdf AS (
  {_rdf_sql("base", _GOLD)}
), prdf AS (
  {_rdf_sql("salted", _PRED, "system, ")}
)"""
RDF_SQL = f"WITH RECURSIVE {BASE_SQL}, {_RDF_BODY}"
#: Label triples and RDF triples together.
BOTH_SQL = f"{TRIPLES_SQL}, {_RDF_BODY}"


def local_sql(x: str) -> str:
    return f"regexp_extract({x}, '[^/#]*$', 0)"


def lower_label_sql(kind: str, node: str, label: str) -> str:
    return f"CASE WHEN {kind} = 'literal' THEN lower(trim({node})) WHEN {kind} = 'bnode' THEN '' ELSE lower(trim(coalesce({label}, replace({local_sql(node)}, '_', ' ')))) END"


# -- Turtle texts ---------------------------------------------------------------------------------------------------

DEFECTS = ["ok", "fenced", "dup_prefix", "no_prefix", "undeclared", "truncated", "invalid_ns", "empty"]


def turtle_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (long), defect, name, text: a small Turtle text for each part, most with a defect."""
    no = F.col("p_partkey")
    defect = F.element_at(F.array(*map(F.lit, DEFECTS)), (no % len(DEFECTS)).cast("int") + 1)
    return table(spark, sf_dir, "part").select(no.alias("graph_id"), defect.alias("defect"), F.col("p_name").alias("name"), _turtle_text(no, defect, F.col("p_name")).alias("text"))


_HEAD = f"@prefix ex: <{EX}> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix ns1: <http://example.org/x/> .\n"


def _turtle_text(no, defect, name):
    body = F.concat(F.lit("ex:p"), no.cast("string"), F.lit(' a ex:Part ;\n  rdfs:label "'), name, F.lit('"@en ;\n  ns1:number '), no.cast("string"), F.lit(" .\n"))
    head = F.lit(_HEAD)
    return (
        F.when(defect == "ok", F.concat(head, body))
        .when(defect == "fenced", F.concat(F.lit("Here it is:\n```turtle\n"), head, body, F.lit("```\nDone.")))
        .when(defect == "dup_prefix", F.concat(head, F.lit("@prefix ex: <http://other.org/> .\n"), body))
        .when(defect == "no_prefix", F.concat(F.lit("<http://example.org/ns> <http://example.org/q> "), no.cast("string"), F.lit(" .\n")))
        .when(defect == "undeclared", F.concat(head, body, F.lit("ex:a foaf:name ex:b .\n")))
        .when(defect == "truncated", F.concat(head, body, F.lit("ex:a ex:b")))
        .when(defect == "invalid_ns", F.concat(head, F.lit("@prefix ns3: <ns3:> .\n@prefix own: <http://own.org/> .\n"), body))
        .otherwise(F.lit(""))
    )


def _turtle_case(no: str, name: str) -> str:
    """The text by its defect d, as ``_turtle_text`` makes it."""
    nl = "chr(10)"
    q = lambda text: "(" + f" || {nl} || ".join(f"'{part}'" for part in text.split("\n")) + ")"
    body = f"('ex:p' || {no} || ' a ex:Part ;' || {nl} || '  rdfs:label \"' || {name} || '\"@en ;' || {nl} || '  ns1:number ' || {no} || ' .' || {nl})"
    head = q(_HEAD)
    fence = "'```'"
    return f"""CASE d
    WHEN 'ok' THEN {head} || {body}
    WHEN 'fenced' THEN 'Here it is:' || {nl} || {fence} || 'turtle' || {nl} || {head} || {body} || {fence} || {nl} || 'Done.'
    WHEN 'dup_prefix' THEN {head} || '@prefix ex: <http://other.org/> .' || {nl} || {body}
    WHEN 'no_prefix' THEN '<http://example.org/ns> <http://example.org/q> ' || {no} || ' .' || {nl}
    WHEN 'undeclared' THEN {head} || {body} || 'ex:a foaf:name ex:b .' || {nl}
    WHEN 'truncated' THEN {head} || {body} || 'ex:a ex:b'
    WHEN 'invalid_ns' THEN {head} || '@prefix ns3: <ns3:> .' || {nl} || '@prefix own: <http://own.org/> .' || {nl} || {body}
    ELSE '' END"""


_DEFECTS_SQL = "[" + ", ".join(f"'{d}'" for d in DEFECTS) + "]"


def _turtle_sql() -> str:
    return f"""tdocs AS (SELECT p_partkey AS graph_id, d AS defect, p_name AS name, {_turtle_case("CAST(p_partkey AS VARCHAR)", "p_name")} AS text
  FROM (SELECT *, list_extract({_DEFECTS_SQL}, CAST(p_partkey % {len(DEFECTS)} AS INT) + 1) AS d FROM part))"""


def pred_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id (a system and a text), text_id, system, defect, text: each system's Turtle answer for each text, some of them empty."""
    n = F.substring("text_id", 2, 20).cast("long")
    both = items(spark, sf_dir).crossJoin(F.broadcast(_salted(spark)))  # three systems
    defect = F.element_at(F.array(*map(F.lit, DEFECTS)), ((n + 3 * F.col("m")) % len(DEFECTS)).cast("int") + 1)
    text = _turtle_text(n, defect, F.col("text_id"))
    links = F.when(text != "", F.concat(text, F.repeat(F.lit("# owl:sameAs\n"), (n % 3).cast("int")))).otherwise(text)
    return both.select(F.concat_ws("|", "system", "text_id").alias("graph_id"), "text_id", "system", defect.alias("defect"), links.alias("text"))


PRED_DOCS_SQL = f"""pdocs AS (SELECT system || '|' || text_id AS graph_id, text_id, system, defect, CASE WHEN text = '' THEN '' ELSE text || repeat('# owl:sameAs' || chr(10), CAST(n % 3 AS INT)) END AS text FROM (
  SELECT text_id, system, n, d AS defect, {_turtle_case("CAST(n AS VARCHAR)", "text_id")} AS text FROM (
    SELECT *, list_extract({_DEFECTS_SQL}, CAST((n + 3 * m) % {len(DEFECTS)} AS INT) + 1) AS d FROM (SELECT text_id, system, m, CAST(substr(text_id, 2) AS BIGINT) AS n FROM items, systems))))"""


TURTLE_SQL = f"WITH {_turtle_sql()}"
