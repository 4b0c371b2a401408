"""Query key -> DataFrame function, and SQL that gives the same rows from the same tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions import arrow, text
from lodewright.functions.lineage import checkpoint_dir, checkpointed
from lodewright.functions.text import CRM, RDF_TYPE, RDFS_LABEL, SAME_AS
from lodewright.operators import failure_modes as fm
from lodewright.operators import graphs, matching, metrics, ontology, pipeline, report
from lodewright.sources import turtle

from . import views
from .views import BOTH_SQL, PRED_DOCS_SQL, RDF_SQL, TRIPLES_SQL, TURTLE_SQL, local_sql, lower_label_sql, norm_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(c: str, n: int = 6):
    return F.round(F.col(c), n).alias(c)


# -- text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {norm_sql("c_name || ' - (' || c_mktsegment || ')  ' || c_name")} AS form FROM customer")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("c_name", F.lit(" - ("), "c_mktsegment", F.lit(")  "), "c_name")
    return views.table(spark, sf, "customer").select("c_custkey", text.normalize(raw).alias("form"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS form FROM orders")
def normalize_dates(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate").cast("string")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    rows = views.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    forms = rows.select("raw").distinct().withColumn("form", arrow.normalize_dates()(F.col("raw")))
    return rows.join(forms, "raw").select("o_orderkey", "form")


_FENCE_SQL = "(?is)```(?:turtle)?[ \\t]*\\n?(.*?)```"
_STRIPPED_SQL = f"regexp_replace(CASE WHEN regexp_matches(text, '{_FENCE_SQL}') THEN regexp_extract(text, '{_FENCE_SQL}', 1) ELSE replace(replace(text, '```turtle', ''), '```', '') END, '^\\s+|\\s+$', '', 'g')"
_HEADER_SQL = "(" + " || chr(10) || ".join(f"'{x}'" for x in text.DEFAULT_HEADER.split("\n")) + ")"
_DEDUPED_SQL = """
  SELECT graph_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id, name ORDER BY pos) AS n FROM (
      SELECT graph_id, pos, line, CASE WHEN regexp_matches(line, '^\\s*@prefix\\s+\\S+\\s+<[^>]+>\\s*\\.\\s*$') THEN regexp_extract(line, '^\\s*@prefix\\s+(\\S+)\\s', 1) END AS name
      FROM (SELECT graph_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {0})
    )
  ) WHERE name IS NULL OR n = 1 GROUP BY graph_id"""


@query(f"{TURTLE_SQL} SELECT graph_id, {_STRIPPED_SQL} AS text FROM tdocs")
def strip_fences(spark: SparkSession, sf: str) -> DataFrame:
    return views.turtle_docs(spark, sf).select("graph_id", text.strip_fences(F.col("text")).alias("text"))


@query(f"{TURTLE_SQL} {_DEDUPED_SQL.format('tdocs')}")
def dedupe_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return views.turtle_docs(spark, sf).select("graph_id", text.dedupe_prefixes(F.col("text")).alias("text"))


_CLEAN_SQL = f"""{TURTLE_SQL}, stripped AS (SELECT graph_id, {_STRIPPED_SQL} AS text FROM tdocs),
headed AS (SELECT graph_id, CASE WHEN NOT contains(text, '@prefix') AND contains(text, 'ns') THEN {_HEADER_SQL} || text ELSE text END AS text FROM stripped),
cleaned AS ({_DEDUPED_SQL.format("headed")})"""


@query(f"{_CLEAN_SQL} SELECT * FROM cleaned")
def clean_turtle(spark: SparkSession, sf: str) -> DataFrame:
    return views.turtle_docs(spark, sf).select("graph_id", text.clean_turtle(F.col("text")).alias("text"))


@query(f"SELECT page_id, {local_sql('url')} AS name FROM pages")
def local_names(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", text.local_name(F.col("url")).alias("name"))


@query(f"""{RDF_SQL} SELECT DISTINCT graph_id, regexp_extract(u, '^(.*[#/])', 1) AS namespace FROM (
  SELECT graph_id, CASE WHEN s_kind = 'uri' THEN s END AS u FROM grdf UNION ALL SELECT graph_id, p FROM grdf UNION ALL SELECT graph_id, CASE WHEN o_kind = 'uri' THEN o END FROM grdf
) WHERE u IS NOT NULL AND regexp_extract(u, '^(.*[#/])', 1) <> ''""")
def namespaces_used(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.used_namespaces(views.gold_rdf(spark, sf))


_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _prefix_ctes(source: str) -> str:
    found = lambda n: f"regexp_extract_all(text, '@prefix\\s+([A-Za-z][A-Za-z0-9_-]*)\\s*:\\s*<([^>]*)>\\s*\\.', {n})"
    return f"""declared AS (SELECT graph_id, unnest({found(1)}) AS prefix, unnest({found(2)}) AS uri, unnest(range(len({found(1)}))) AS pos FROM {source}),
used AS (SELECT graph_id, prefix, arg_max(uri, pos) AS uri FROM declared GROUP BY graph_id, prefix),
classed AS (SELECT *, CASE WHEN NOT (starts_with(uri, 'http://') OR starts_with(uri, 'https://')) THEN 'invalid' WHEN lower(prefix) IN ({_IN(text.KNOWN_PREFIXES)}) THEN 'allowed'
  WHEN regexp_matches(lower(prefix), '^ns[0-9]+$') THEN 'fabricated' WHEN contains(uri, '{CRM}') OR contains(uri, '{text.DOMAIN}') THEN 'allowed' ELSE 'fabricated' END AS class FROM used)"""


_PREFIX_SQL = f"{TURTLE_SQL}, {_prefix_ctes('tdocs')}"


@query(f"{_PREFIX_SQL} SELECT graph_id, prefix, uri, class FROM classed")
def prefix_classify(spark: SparkSession, sf: str) -> DataFrame:
    return text.used_prefixes(views.turtle_docs(spark, sf)).withColumn("class", text.classify_prefix(F.col("prefix"), F.col("uri")))


@query(f"{_PREFIX_SQL} SELECT t.graph_id, count(*) FILTER (WHERE class = 'fabricated') AS fabricated, count(*) FILTER (WHERE class = 'invalid') AS invalid FROM tdocs t LEFT JOIN classed c USING (graph_id) GROUP BY t.graph_id")
def fm2_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    return fm.namespace_counts(views.turtle_docs(spark, sf))


_WORDS_SQL = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


@query(f"""WITH pairs AS (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, a.p_name || ' ' || lower(a.p_type) AS a, b.p_name || ' ' || lower(b.p_type) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 + a.p_partkey % 5)
SELECT a_key, b_key, a = b OR contains(a, b) OR contains(b, a) OR len(list_intersect({_WORDS_SQL.format("a")}, {_WORDS_SQL.format("b")})) / least(len({_WORDS_SQL.format("a")}), len({_WORDS_SQL.format("b")})) > 0.66 AS alike FROM pairs""")
def similarity_native(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _pairs(spark, sf)
    both = a.join(b, F.col("b_key") == F.col("a_key") + 1 + F.col("a_key") % 5)
    return both.select("a_key", "b_key", text.similar_native(F.col("a"), F.col("b")).alias("alike"))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = views.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("x"))
    return (part.select(F.col("p_partkey").alias(f"{n}_key"), F.col("x").alias(n)) for n in "ab")


@query()
def similarity_ratio(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _pairs(spark, sf)
    both = a.join(b, F.col("b_key") == F.col("a_key") + 1 + F.col("a_key") % 5)
    return both.select("a_key", "b_key", arrow.sequence_ratio("a", "b").alias("ratio"))


# -- triples --------------------------------------------------------------------------------------------------------


def _triples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return matching.normalized(views.gold_triples(spark, sf)), matching.normalized(views.pred_triples(spark, sf)), views.systems(spark)


_EXACT_SQL = f"""{TRIPLES_SQL}, dg AS (SELECT DISTINCT text_id, nsub, nrel, nobj FROM g), dp AS (SELECT DISTINCT text_id, system, nsub, nrel, nobj FROM p),
counted AS (SELECT t.text_id, s.system,
  (SELECT count(*) FROM dp JOIN dg USING (text_id, nsub, nrel, nobj) WHERE dp.text_id = t.text_id AND dp.system = s.system) AS tp,
  (SELECT count(*) FROM dp WHERE dp.text_id = t.text_id AND dp.system = s.system) AS n_pred, (SELECT count(*) FROM dg WHERE dg.text_id = t.text_id) AS n_gold
  FROM (SELECT DISTINCT text_id FROM g) t, systems s),
scored AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS p, CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0.0 END AS r FROM counted))"""


@query(f"{_EXACT_SQL} SELECT text_id, system, n_gold, n_pred, tp, p, r, f1 FROM scored")
def triples_exact_prf(spark: SparkSession, sf: str) -> DataFrame:
    return matching.exact_scores(*_triples(spark, sf)).select("text_id", "system", "n_gold", "n_pred", "tp", "p", "r", "f1")


@query(f"{TRIPLES_SQL} SELECT text_id, system, seq, nrel FROM p WHERE NOT regexp_matches(nrel, '^p[0-9]+$') AND EXISTS (SELECT 1 FROM g WHERE g.text_id = p.text_id AND g.nrel = p.nrel)")
def relation_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred, _ = _triples(spark, sf)
    return matching.on_schema(pred, gold).select("text_id", "system", "seq", "nrel")


def _like_sql(a: str, b: str) -> str:
    x, y = _WORDS_SQL.format(a), _WORDS_SQL.format(b)
    return f"({a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) OR len(list_intersect({x}, {y})) / greatest(1, least(len({x}), len({y}))) > 0.66)"


def _greedy_sql(x: str = "", gold: str = "g", pred: str = "p") -> str:
    """Scores of the greedy match by the native tiers: a walk over each text's, system's and relation's predictions."""
    return f"""o{x} AS (SELECT p.* FROM {pred} p WHERE NOT regexp_matches(nrel, '^p[0-9]+$') AND EXISTS (SELECT 1 FROM {gold} g WHERE g.text_id = p.text_id AND g.nrel = p.nrel)),
ranked{x} AS (SELECT *, row_number() OVER (PARTITION BY text_id, system, nrel ORDER BY seq) AS i FROM (
  SELECT o.text_id, o.system, o.nrel, o.seq, list(g.seq ORDER BY g.seq) AS golds FROM o{x} o JOIN {gold} g USING (text_id, nrel) WHERE {_like_sql("o.nsub", "g.nsub")} AND {_like_sql("o.nobj", "g.nobj")} GROUP BY ALL)),
walk{x}(text_id, system, nrel, i, used, seq, got) AS (
  SELECT text_id, system, nrel, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ranked{x} WHERE i = 1
  UNION ALL SELECT text_id, system, nrel, i, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, seq, got FROM (
    SELECT r.text_id, r.system, r.nrel, r.i, w.used, r.seq, list_extract(list_filter(r.golds, lambda s: NOT list_contains(w.used, s)), 1) AS got
    FROM walk{x} w JOIN ranked{x} r ON r.text_id = w.text_id AND r.system = w.system AND r.nrel = w.nrel AND r.i = w.i + 1)),
m{x} AS (SELECT text_id, system, count(DISTINCT nsub || '|' || nrel || '|' || nobj) AS tp, count(*) AS matched FROM o{x} JOIN walk{x} USING (text_id, system, nrel, seq) WHERE got IS NOT NULL GROUP BY ALL),
c{x} AS (SELECT t.text_id, s.system, t.n_gold, coalesce(q.n_pred, 0) AS n_pred, coalesce(m.tp, 0) AS tp, coalesce(m.matched, 0) AS matched
  FROM (SELECT text_id, count(*) AS n_gold FROM {gold} GROUP BY text_id) t CROSS JOIN systems s LEFT JOIN (SELECT text_id, system, count(*) AS n_pred FROM o{x} GROUP BY ALL) q USING (text_id, system) LEFT JOIN m{x} m USING (text_id, system)),
smart{x} AS (SELECT text_id, system, tp, n_pred - matched AS fp, n_gold - matched AS fn, CASE WHEN tp + n_pred - matched > 0 THEN tp / (tp + n_pred - matched) ELSE 0.0 END AS p, CASE WHEN tp + n_gold - matched > 0 THEN tp / (tp + n_gold - matched) ELSE 0.0 END AS r FROM c{x}),
scores{x} AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM smart{x})"""


_SMART_SQL = f"""{TRIPLES_SQL}, {_greedy_sql()},
scored AS (SELECT s.* FROM scores s WHERE EXISTS (SELECT 1 FROM p WHERE p.text_id = s.text_id AND p.system = s.system))"""


def _smart(spark: SparkSession, sf: str) -> DataFrame:
    """The greedy match by the tiers that SQL has too; ``triples_fuzzy_greedy`` adds the sequence ratio."""
    gold, pred, systems = _triples(spark, sf)
    own = matching.on_schema(pred, gold)
    return matching.match_counts(gold, own, matching.greedy_matches(gold, own, arrow.native_similarity), systems)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of texts that the system gave anything for."""
    return _smart(spark, sf).join(views.pred_triples(spark, sf).select("text_id", "system").distinct(), ["text_id", "system"], "left_semi")


@query(f"{_SMART_SQL} SELECT text_id, system, tp, fp, fn, p, r, f1 FROM scores")
def triples_smart_prf(spark: SparkSession, sf: str) -> DataFrame:
    return _smart(spark, sf)


@query()
def triples_fuzzy_greedy(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred, systems = _triples(spark, sf)
    own = matching.on_schema(pred, gold)
    return matching.match_counts(gold, own, matching.greedy_matches(gold, own), systems)


@query(f"{_SMART_SQL} SELECT system, round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(f1), 6) AS f1, count(*) AS n FROM scored GROUP BY system")
def macro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_scores(_scored(spark, sf), "system").select("system", _round("p"), _round("r"), _round("f1"), "n")


@query(f"{_SMART_SQL} SELECT s.system, count(*) AS n_total, count(f1) AS n_scored, round(sum(coalesce(f1, 0.0)) / count(*), 6) AS f1_all FROM items CROSS JOIN systems s LEFT JOIN scored c ON c.text_id = items.text_id AND c.system = s.system GROUP BY s.system")
def f1_all_items(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.f1_over_all(views.items(spark, sf), _scored(spark, sf), views.systems(spark)).select("system", "n_total", "n_scored", _round("f1_all"))


@query(f"{_SMART_SQL} SELECT system, domain, round(avg(f1), 6) AS f1, count(*) AS n FROM scored JOIN items USING (text_id) GROUP BY ROLLUP (system, domain)")
def scores_by_domain_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.by_domain(_scored(spark, sf), views.items(spark, sf)).select("system", "domain", _round("f1"), "n")


_LINK = "regexp_replace(lower(rel), '[ _]', '', 'g') IN ('sameas', 'owl:sameas')"
_EL_SQL = f"""{_SMART_SQL}, full_ AS (SELECT text_id, system, round(f1, 4) AS f1_full FROM scores),
cg AS (SELECT text_id, count(*) AS n_gold, count(*) FILTER (WHERE {_LINK}) AS n_gold_sameas FROM g GROUP BY text_id),
co AS (SELECT text_id, system, count(*) AS n_pred, count(*) FILTER (WHERE {_LINK}) AS n_pred_sameas FROM p GROUP BY ALL)"""


@query(f"{_EL_SQL} SELECT cg.text_id, s.system, n_gold, n_gold_sameas, coalesce(n_pred, 0) AS n_pred, coalesce(n_pred_sameas, 0) AS n_pred_sameas FROM cg CROSS JOIN systems s LEFT JOIN co ON co.text_id = cg.text_id AND co.system = s.system")
def el_counts(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred, systems = _triples(spark, sf)
    link = text.is_same_as(F.col("rel"))
    g = gold.groupBy("text_id").agg(F.count("*").alias("n_gold"), F.count_if(link).alias("n_gold_sameas"))
    p = pred.groupBy("text_id", "system").agg(F.count("*").alias("n_pred"), F.count_if(link).alias("n_pred_sameas"))
    return g.crossJoin(F.broadcast(systems)).join(p, ["text_id", "system"], "left").fillna(0)


def _el_sql() -> str:
    """The scores twice: with all triples, and without same-as triples."""
    sets = f"g2 AS (SELECT * FROM g WHERE NOT {_LINK}), p2 AS (SELECT * FROM p WHERE NOT {_LINK})"
    return f"{TRIPLES_SQL}, {_greedy_sql()}, {sets}, {_greedy_sql('_2', 'g2', 'p2')} SELECT f.text_id, f.system, round_even(f.f1, 4) AS f1_full, round_even(coalesce(w.f1, 0.0), 4) AS f1_no_sameas FROM scores f LEFT JOIN scores_2 w USING (text_id, system)"


@query(_el_sql())
def el_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred, systems = _triples(spark, sf)

    def matcher(g: DataFrame, p: DataFrame) -> DataFrame:
        return matching.greedy_matches(g, p, arrow.native_similarity)

    own = matching.on_schema(pred, gold)
    return metrics.link_sensitivity(gold, own, systems, matcher).select("text_id", "system", "f1_full", "f1_no_sameas")


_CONCEPTS = ["building", "household", "nation_1"]
_RATES_BODY = f"""texts AS (SELECT text_id, lower(string_agg(c_name || ' of ' || n_name, '; ' ORDER BY c)) AS context FROM base GROUP BY text_id),
rated AS (SELECT text_id, system, lower(trim(rel)) IN ('lives in', 'has segment', 'same as') AS known,
  contains(context, lower(trim(sub))) {"".join(f"OR contains('{c}', lower(trim(sub))) OR contains(lower(trim(sub)), '{c}') " for c in _CONCEPTS)} AS s,
  contains(context, lower(trim(obj))) {"".join(f"OR contains('{c}', lower(trim(obj))) OR contains(lower(trim(obj)), '{c}') " for c in _CONCEPTS)} AS o FROM pred JOIN texts USING (text_id)),
rates AS (SELECT text_id, system, count(*) AS n, count(*) FILTER (WHERE known) / count(*) AS oc, count(*) FILTER (WHERE NOT s) / count(*) AS sh, count(*) FILTER (WHERE NOT known) / count(*) AS rh, count(*) FILTER (WHERE NOT o) / count(*) AS oh FROM rated GROUP BY ALL)"""
_HALLUCINATION_SQL = f"{TRIPLES_SQL}, {_RATES_BODY} SELECT * FROM rates"


def _contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.base(spark, sf).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("c", F.concat("c_name", F.lit(" of "), "n_name").alias("x")))).alias("rows"))
    return rows.select("text_id", F.array_join("rows.x", "; ").alias("text"))


@query(_HALLUCINATION_SQL)
def hallucination_rates(spark: SparkSession, sf: str) -> DataFrame:
    relations = spark.createDataFrame([("lives in",), ("has segment",), ("same as",)], "relation string")
    return metrics.hallucination_rates(_contexts(spark, sf), views.pred_triples(spark, sf), relations, _CONCEPTS)


@query()
def hallucination_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    relations = spark.createDataFrame([("lives in",), ("has segment",), ("same as",)], "relation string")
    concepts = [arrow.stem_text(c) for c in _CONCEPTS]
    return metrics.hallucination_rates(_contexts(spark, sf), views.pred_triples(spark, sf), relations, concepts, form=arrow.stemmed)


_BOOT_SQL = f"""{_SMART_SQL}, vals AS (SELECT system, row_number() OVER (PARTITION BY system ORDER BY text_id) - 1 AS slot, f1 AS value FROM scored),
sizes AS (SELECT system, count(*) AS n, avg(value) AS mean FROM vals GROUP BY system),
draws AS (SELECT system, n, it, CAST('0x' || substr(md5('20260507|' || system || '|' || CAST(it AS VARCHAR) || '|' || CAST(k AS VARCHAR)), 1, 12) AS BIGINT) % n AS slot FROM sizes, range(10000) a(it), LATERAL (SELECT unnest(range(n)) AS k)),
means AS (SELECT system, it, round(avg(value), 12) AS m FROM draws JOIN vals USING (system, slot) GROUP BY system, it),
placed AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY m, it) - 1 AS pos FROM means)
SELECT system, n, round(mean, 6) AS mean, round((SELECT m FROM placed p WHERE p.system = z.system AND pos = 250), 6) AS ci_lo, round((SELECT m FROM placed p WHERE p.system = z.system AND pos = 9750), 6) AS ci_hi FROM sizes z"""


def _values(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("system").orderBy("text_id")) - 1
    return _scored(spark, sf).select("system", place.cast("long").alias("slot"), F.col("f1").alias("value"))


@query(_BOOT_SQL)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap_by_hash(_values(spark, sf)).select("system", "n", _round("mean"), _round("ci_lo"), _round("ci_hi"))


@query()
def bootstrap_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap_grouped(_values(spark, sf))


# -- graphs ---------------------------------------------------------------------------------------------------------

_LABELS_SQL = f"""labels AS (SELECT graph_id, s AS node, coalesce(arg_max(o, seq) FILTER (WHERE lang = 'en'), arg_min(o, seq) FILTER (WHERE lang IS NULL)) AS label FROM grdf WHERE p = '{RDFS_LABEL}' AND (lang IS NULL OR lang = 'en') GROUP BY graph_id, s)"""
_BLANKS_SQL = f"""parts AS (SELECT graph_id, s AS node, CASE WHEN p = '{RDF_TYPE}' THEN {local_sql("o")} ELSE {local_sql("p")} || '=' || CASE WHEN o_kind = 'bnode' THEN '_' WHEN contains(o, 'http') THEN {local_sql("o")} ELSE o END END AS part FROM grdf WHERE s_kind = 'bnode' AND p <> '{RDFS_LABEL}'),
blanks AS (SELECT graph_id, node, string_agg(part, ' ' ORDER BY part) AS label FROM parts GROUP BY ALL)"""
_FALLBACK = "CASE WHEN contains({0}, 'http') OR contains({0}, '://') THEN regexp_extract({0}, '[^/#]*$', 0) ELSE regexp_extract({0}, '[^:]*$', 0) END"


@query(f"{RDF_SQL}, {_BLANKS_SQL} SELECT * FROM blanks")
def bnode_labels(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.blank_labels(views.gold_rdf(spark, sf))


@query(f"""{RDF_SQL}, {_LABELS_SQL}, {_BLANKS_SQL}, known AS (SELECT * FROM labels UNION ALL SELECT * FROM blanks),
named AS (SELECT t.graph_id, t.seq, coalesce(a.label, trim(replace({_FALLBACK.format("t.s")}, '_', ' '))) AS sub, coalesce(b.label, trim(replace({_FALLBACK.format("t.p")}, '_', ' '))) AS rel, coalesce(c.label, trim(replace({_FALLBACK.format("t.o")}, '_', ' '))) AS obj
  FROM grdf t LEFT JOIN known a ON a.graph_id = t.graph_id AND a.node = t.s LEFT JOIN known b ON b.graph_id = t.graph_id AND b.node = t.p LEFT JOIN known c ON c.graph_id = t.graph_id AND c.node = t.o
  WHERE t.p NOT IN ('{RDF_TYPE}', '{RDFS_LABEL}'))
SELECT * FROM named""")
def label_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return graphs.label_triples(views.gold_rdf(spark, sf))


_ENTITIES = """{1}_named AS (SELECT graph_id, {0}s AS node, arg_max(o, seq) AS label FROM {1} WHERE p = '""" + RDFS_LABEL + """' GROUP BY ALL),
{1}_ents AS (SELECT DISTINCT t.graph_id, {2} coalesce(n.label, regexp_replace(regexp_extract(t.s, '[^/#]*$', 0), '[_-]', ' ', 'g')) AS label FROM {1} t LEFT JOIN {1}_named n ON n.graph_id = t.graph_id AND n.node = t.s {3} WHERE t.s_kind = 'uri')"""
_GENTS = _ENTITIES.format("", "grdf", "", "")
_PENTS = _ENTITIES.format("system, ", "prdf", "t.system,", "AND n.system = t.system")


def _per_system(spark: SparkSession, f, pred: DataFrame, *columns: str) -> DataFrame:
    """A per-graph operator over the predictions of each system, graphs kept apart by a joint id."""
    joint = pred.withColumn("graph_id", F.concat_ws("|", "graph_id", "system"))
    split = F.split("graph_id", r"\|")
    return f(joint).withColumns({"system": split[1], "graph_id": split[0]}).select("graph_id", "system", *columns)


_RECALL_BODY = f"""{_GENTS}, {_PENTS}, found AS (SELECT g.graph_id, s.system, EXISTS (SELECT 1 FROM prdf_ents p WHERE p.graph_id = g.graph_id AND p.system = s.system AND {_like_sql("lower(g.label)", "lower(p.label)")}) AS hit FROM grdf_ents g, systems s),
er AS (SELECT graph_id AS text_id, system, count(*) FILTER (WHERE hit) AS matched, count(*) AS total, count(*) FILTER (WHERE hit) / count(*) AS recall FROM found GROUP BY graph_id, system)"""


@query(f"{RDF_SQL}, {_RECALL_BODY} SELECT * FROM er")
def entity_recall(spark: SparkSession, sf: str) -> DataFrame:
    g, p = _entities(spark, sf)
    return matching.entity_recall(g, p, views.systems(spark), ratio=False)


@query()
def entity_recall_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """All tiers, the sequence ratio among them."""
    return matching.entity_recall(*_entities(spark, sf), views.systems(spark))


def _entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = graphs.labelled_entities(views.gold_rdf(spark, sf)).select(F.col("graph_id").alias("text_id"), "label")
    p = _per_system(spark, graphs.labelled_entities, views.pred_rdf(spark, sf), "label").withColumnRenamed("graph_id", "text_id")
    return g, p


_TYPES = """{1}_tnamed AS (SELECT graph_id, {0}s AS node, arg_max(o, [first, seq]) AS label FROM (SELECT *, min(seq) OVER (PARTITION BY graph_id, {0}o, lang) AS first FROM {1} WHERE p = '""" + RDFS_LABEL + """') GROUP BY ALL),
{1}_types AS (SELECT t.graph_id, {2} coalesce(n.label, regexp_replace(regexp_extract(t.s, '[^/#]*$', 0), '[_-]', ' ', 'g')) AS label, list_sort(list(DISTINCT regexp_extract(t.o, '[^/#]*$', 0))) AS types, min([first, t.seq]) AS seq
  FROM (SELECT *, min(seq) OVER (PARTITION BY graph_id, {0}o) AS first FROM {1} WHERE p = '""" + RDF_TYPE + """') t LEFT JOIN {1}_tnamed n ON n.graph_id = t.graph_id AND n.node = t.s {3} WHERE t.s_kind = 'uri' GROUP BY ALL)"""
_TYPES_BODY = f"""{_TYPES.format("", "grdf", "", "")}, {_TYPES.format("system, ", "prdf", "t.system,", "AND n.system = t.system")},
type_ranked AS (SELECT g.graph_id, p.system, g.label, g.types AS gt, p.types AS pt, row_number() OVER (PARTITION BY g.graph_id, p.system, g.label ORDER BY CASE WHEN g.label = p.label THEN 0 WHEN lower(g.label) = lower(p.label) THEN 1 ELSE 2 END, p.seq, p.label) AS n FROM grdf_types g JOIN prdf_types p ON p.graph_id = g.graph_id AND {_like_sql("lower(g.label)", "lower(p.label)")}),
own AS (SELECT g.graph_id, s.system, CASE WHEN pt IS NULL THEN 0 ELSE len(list_intersect(g.types, pt)) END AS tp, CASE WHEN pt IS NULL THEN 0 ELSE len(list_filter(pt, lambda x: NOT list_contains(g.types, x))) END AS fp, len(g.types) - CASE WHEN pt IS NULL THEN 0 ELSE len(list_intersect(g.types, pt)) END AS fn FROM grdf_types g CROSS JOIN systems s LEFT JOIN type_ranked r ON r.graph_id = g.graph_id AND r.system = s.system AND r.label = g.label AND r.n = 1),
sums AS (SELECT graph_id AS text_id, system, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM own GROUP BY ALL),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM sums),
tf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"""
_TYPES_SQL = f"{RDF_SQL}, {_TYPES_BODY} SELECT * FROM tf"


@query(_TYPES_SQL)
def type_f1(spark: SparkSession, sf: str) -> DataFrame:
    return matching.type_scores(*_types(spark, sf), views.systems(spark), ratio=False)


@query()
def type_f1_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """All tiers, the sequence ratio among them."""
    return matching.type_scores(*_types(spark, sf), views.systems(spark))


def _types(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    g = graphs.type_sets(views.gold_rdf(spark, sf)).withColumnRenamed("graph_id", "text_id")
    p = _per_system(spark, graphs.type_sets, views.pred_rdf(spark, sf), "label", "types", "at").withColumnRenamed("graph_id", "text_id")
    return g, p


_NAMES = f"p NOT IN ('{RDF_TYPE}', '{RDFS_LABEL}', '{SAME_AS}')"


_COVER_BODY = f"""gp AS (SELECT DISTINCT graph_id, {local_sql("p")} AS predicate FROM grdf WHERE {_NAMES}), pp AS (SELECT DISTINCT graph_id, system, {local_sql("p")} AS predicate FROM prdf WHERE {_NAMES}),
cov AS (SELECT t.graph_id AS text_id, s.system, (SELECT count(*) FROM gp JOIN pp USING (graph_id, predicate) WHERE gp.graph_id = t.graph_id AND pp.system = s.system) AS matched, (SELECT count(*) FROM gp WHERE gp.graph_id = t.graph_id) AS ng, (SELECT count(*) FROM pp WHERE pp.graph_id = t.graph_id AND pp.system = s.system) AS np FROM (SELECT DISTINCT graph_id FROM gp) t, systems s),
pc AS (SELECT text_id, system, matched, ng - matched AS missing, np - matched AS extra, CASE WHEN ng > 0 THEN matched / ng ELSE 0.0 END AS coverage FROM cov)"""


@query(f"{RDF_SQL}, {_COVER_BODY} SELECT * FROM pc")
def predicate_coverage(spark: SparkSession, sf: str) -> DataFrame:
    g = graphs.predicate_names(views.gold_rdf(spark, sf)).withColumnRenamed("graph_id", "text_id")
    p = _per_system(spark, graphs.predicate_names, views.pred_rdf(spark, sf), "predicate").withColumnRenamed("graph_id", "text_id")
    return matching.predicate_coverage(g, p, views.systems(spark))


# -- failure modes --------------------------------------------------------------------------------------------------

_GRID = "(SELECT DISTINCT graph_id FROM grdf) t CROSS JOIN systems s"
_FM1_SQL = f"""ge AS (SELECT graph_id, count(DISTINCT s) AS nodes, list(DISTINCT {local_sql("o")}) AS types FROM grdf WHERE p = '{RDF_TYPE}' AND {local_sql("o")} IN ({_IN(fm.EVENT_CLASSES)}) GROUP BY graph_id),
pe AS (SELECT graph_id, system, count(DISTINCT s) AS nodes, list(DISTINCT {local_sql("o")}) AS types FROM prdf WHERE p = '{RDF_TYPE}' AND {local_sql("o")} IN ({_IN(fm.EVENT_CLASSES)}) GROUP BY ALL),
fm1 AS (SELECT t.graph_id, s.system, coalesce(ge.nodes, 0) AS gold_events, coalesce(pe.nodes, 0) AS pred_events, CASE WHEN ge.types IS NULL THEN 0.0 ELSE coalesce(len(list_intersect(ge.types, pe.types)), 0) / len(ge.types) END AS recall FROM {_GRID} LEFT JOIN ge ON ge.graph_id = t.graph_id LEFT JOIN pe ON pe.graph_id = t.graph_id AND pe.system = s.system)"""


def _rdf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.gold_rdf(spark, sf), views.pred_rdf(spark, sf), views.systems(spark)


@query(f"{RDF_SQL}, {_FM1_SQL} SELECT * FROM fm1")
def fm1_event_recall(spark: SparkSession, sf: str) -> DataFrame:
    return fm.event_recall(*_rdf(spark, sf))


@query(f"{TURTLE_SQL} SELECT defect, CAST(sum(len(regexp_extract_all(text || ' owl:sameAs ' || name, 'owl:sameAs'))) AS BIGINT) AS statements FROM tdocs GROUP BY defect")
def fm3_statements(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.turtle_docs(spark, sf).withColumn("text", F.concat("text", F.lit(" owl:sameAs "), "name"))
    return fm.same_as_statements(docs, "defect")


@query(f"{TURTLE_SQL} SELECT 'V' || CAST(graph_id % 3 AS VARCHAR) AS system, count(*) FILTER (WHERE text <> '') AS scorable, count(*) FILTER (WHERE defect NOT IN ('empty', 'undeclared', 'truncated')) AS strict, CAST(count(*) FILTER (WHERE text <> '') AS VARCHAR) || ' / ' || CAST(count(*) FILTER (WHERE defect NOT IN ('empty', 'undeclared', 'truncated')) AS VARCHAR) AS shown FROM tdocs GROUP BY ALL")
def fm4_parse_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _cleaned(spark, sf).withColumn("system", F.concat(F.lit("V"), (F.col("graph_id") % 3).cast("string")))
    status = turtle.turtle_status(docs).join(docs.select("graph_id", "system"), "graph_id")
    return fm.parse_counts(docs, status)


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return views.turtle_docs(spark, sf).withColumn("text", text.clean_turtle(F.col("text")))


def _pairs_sql(source: str, name: str, key: str = "") -> str:
    on = f" AND {{0}}.system = t.system" if key else ""
    return f"""{name}_l AS (SELECT graph_id, {key}s AS node, arg_min(o, seq) AS label FROM {source} WHERE p = '{RDFS_LABEL}' GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT t.graph_id, {"t.system, " if key else ""}{lower_label_sql("t.s_kind", "t.s", "a.label")} AS sl, {lower_label_sql("t.o_kind", "t.o", "b.label")} AS ol, list_sort(list(DISTINCT {local_sql("t.p")})) AS preds
  FROM {source} t LEFT JOIN {name}_l a ON a.graph_id = t.graph_id AND a.node = t.s{on.format("a")} LEFT JOIN {name}_l b ON b.graph_id = t.graph_id AND b.node = t.o{on.format("b")}
  WHERE starts_with(t.p, '{CRM}') OR starts_with(t.p, '{text.DOMAIN}') GROUP BY ALL) WHERE sl <> '' AND ol <> '')"""


_FM5_SQL = f"""{_pairs_sql("grdf", "gpairs")}, {_pairs_sql("prdf", "ppairs", "system, ")},
swaps AS (SELECT p.graph_id, p.system, len(list_intersect(g.preds, p.preds)) = 0 AS swapped, p.sl || ' | ' || p.ol || ' | ' || array_to_string(g.preds, ',') || ' | ' || array_to_string(p.preds, ',') AS shown FROM ppairs p JOIN gpairs g USING (graph_id, sl, ol)),
fm5a AS (SELECT t.graph_id, s.system, count(w.swapped) AS matched, count(*) FILTER (WHERE w.swapped) AS substituted, coalesce(array_to_string(list_slice(list_sort(list(w.shown) FILTER (WHERE w.swapped)), 1, 5), '; '), '') AS examples, CASE WHEN count(w.swapped) > 0 THEN count(*) FILTER (WHERE w.swapped) / count(w.swapped) ELSE 0.0 END AS rate
  FROM {_GRID} LEFT JOIN swaps w ON w.graph_id = t.graph_id AND w.system = s.system GROUP BY t.graph_id, s.system)"""


@query(f"{RDF_SQL}, {_FM5_SQL} SELECT * FROM fm5a")
def fm5_pair_substitution(spark: SparkSession, sf: str) -> DataFrame:
    return fm.pair_substitution(*_rdf(spark, sf))


_FM5B_SQL = f"""gc AS (SELECT graph_id, list(DISTINCT {local_sql("p")}) AS n FROM grdf WHERE starts_with(p, '{CRM}') GROUP BY graph_id), pc AS (SELECT graph_id, system, list(DISTINCT {local_sql("p")}) AS n FROM prdf WHERE starts_with(p, '{CRM}') GROUP BY ALL),
fm5b AS (SELECT t.graph_id, s.system, coalesce(len(pc.n), 0) AS n_pred, coalesce(len(list_filter(pc.n, lambda x: NOT list_contains(coalesce(gc.n, []), x))), 0) AS n_divergent FROM {_GRID} LEFT JOIN gc ON gc.graph_id = t.graph_id LEFT JOIN pc ON pc.graph_id = t.graph_id AND pc.system = s.system)"""


@query(f"{RDF_SQL}, {_FM5B_SQL} SELECT *, CASE WHEN n_pred > 0 THEN n_divergent / n_pred ELSE 0.0 END AS divergence FROM fm5b")
def fm5_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return fm.predicate_divergence(*_rdf(spark, sf))


_ODD = f"NOT starts_with(p.p, '{CRM}') AND NOT starts_with(p.p, '{text.DOMAIN}') AND p.p NOT IN ('{RDF_TYPE}', '{RDFS_LABEL}', '{SAME_AS}')"
_FM6_SQL = f"""fm6 AS (SELECT t.graph_id, s.system, count(p.p) AS total, count(*) FILTER (WHERE {_ODD}) AS injected, coalesce(array_to_string(list_sort(list(DISTINCT {local_sql("p.p")}) FILTER (WHERE {_ODD})), ','), '') AS names FROM {_GRID} LEFT JOIN prdf p ON p.graph_id = t.graph_id AND p.system = s.system GROUP BY t.graph_id, s.system)"""


@query(f"{RDF_SQL}, {_FM6_SQL} SELECT *, CASE WHEN total > 0 THEN injected / total ELSE 0.0 END AS rate FROM fm6")
def fm6_injection(spark: SparkSession, sf: str) -> DataFrame:
    return fm.vocabulary_injection(*_rdf(spark, sf))


@query(f"{RDF_SQL}, {_FM6_SQL.replace(_ODD, _ODD + ' AND NOT contains(p.p, ' + chr(39) + 'home' + chr(39) + ')')} SELECT *, CASE WHEN total > 0 THEN injected / total ELSE 0.0 END AS rate FROM fm6")
def fm6_imported_terms(spark: SparkSession, sf: str) -> DataFrame:
    """With a table of imported terms, which are allowed."""
    terms = views.table(spark, sf, "region").select(F.concat(F.lit("http://schema.org/"), F.when(F.col("r_regionkey") == 0, "homeLocation").otherwise(F.col("r_name"))).alias("uri"))
    return fm.vocabulary_injection(*_rdf(spark, sf), terms)


_FM7_SQL = f"""spans AS (SELECT DISTINCT graph_id, system, s AS node FROM prdf WHERE p = '{RDF_TYPE}' AND {local_sql("o")} IN ({_IN(fm.TIME_SPANS)})),
att AS (SELECT graph_id, system, unnest([s, o]) AS node FROM prdf WHERE p IN ({_IN(fm.TIME_SPAN_EDGES)})),
fm7 AS (SELECT t.graph_id, s.system, count(x.node) AS total, count(*) FILTER (WHERE x.node IS NOT NULL AND a.node IS NULL) AS detached FROM {_GRID} LEFT JOIN spans x ON x.graph_id = t.graph_id AND x.system = s.system LEFT JOIN (SELECT DISTINCT * FROM att) a ON a.graph_id = x.graph_id AND a.system = x.system AND a.node = x.node GROUP BY t.graph_id, s.system)"""


@query(f"{RDF_SQL}, {_FM7_SQL} SELECT *, CASE WHEN total > 0 THEN detached / total ELSE 0.0 END AS rate FROM fm7")
def fm7_detachment(spark: SparkSession, sf: str) -> DataFrame:
    return fm.time_span_detachment(*_rdf(spark, sf))


_SUMMARY_BODY = f"""{_FM1_SQL}, {_FM5_SQL}, {_FM5B_SQL}, {_FM6_SQL}, {_FM7_SQL}, {PRED_DOCS_SQL}, {_prefix_ctes("pdocs")},
fm2 AS (SELECT d.text_id AS graph_id, d.system, any_value(d.defect) NOT IN ('empty', 'undeclared', 'truncated') AS parsed, count(*) FILTER (WHERE class = 'fabricated') AS fabricated, count(*) FILTER (WHERE class = 'invalid') AS invalid FROM pdocs d LEFT JOIN classed c USING (graph_id) GROUP BY d.text_id, d.system),
allrows AS (SELECT fm1.graph_id, fm1.system, parsed, fabricated, invalid, recall, fm5a.rate AS sub, CASE WHEN n_pred > 0 THEN n_divergent / n_pred ELSE 0.0 END AS div, CASE WHEN fm6.total > 0 THEN injected / fm6.total ELSE 0.0 END AS inj, CASE WHEN fm7.total > 0 THEN detached / fm7.total ELSE 0.0 END AS det
  FROM fm1 JOIN fm5a USING (graph_id, system) JOIN fm5b USING (graph_id, system) JOIN fm6 USING (graph_id, system) JOIN fm7 USING (graph_id, system) JOIN fm2 USING (graph_id, system)),
summary AS (SELECT system, count(*) AS n_total, count(*) FILTER (WHERE parsed) AS n_parsed, round_even(avg(recall), 4) AS event_recall_all, round_even(avg(recall) FILTER (WHERE parsed), 4) AS event_recall_parsed,
  CAST(sum(fabricated) AS BIGINT) AS fabricated_total, CAST(sum(invalid) AS BIGINT) AS invalid_total, round_even(avg(fabricated), 4) AS fabricated_mean, round_even(avg(sub) FILTER (WHERE parsed), 4) AS substitution_parsed,
  round_even(avg(div) FILTER (WHERE parsed), 4) AS divergence_parsed, round_even(avg(inj) FILTER (WHERE parsed), 4) AS injection_parsed, round_even(avg(det) FILTER (WHERE parsed), 4) AS detachment_parsed FROM allrows GROUP BY system)"""
_SUMMARY_SQL = f"{RDF_SQL}, {_SUMMARY_BODY}"


def _fm_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The per-text values of all failure modes; both graphs are made once for all of them."""
    keys = ["graph_id", "system"]
    rdf = checkpointed(views.gold_rdf(spark, sf)), checkpointed(views.pred_rdf(spark, sf)), views.systems(spark)
    docs = checkpointed(views.pred_docs(spark, sf))
    names = docs.select("graph_id", F.col("text_id").alias("_text"), "system")
    parsed = turtle.turtle_status(docs.where("text <> ''").withColumn("text", text.clean_turtle(F.col("text")))).select("graph_id", F.col("valid").alias("parsed"))
    own = names.join(fm.namespace_counts(docs), "graph_id").join(parsed, "graph_id", "left").fillna(False, ["parsed"])
    rows = own.select(F.col("_text").alias("graph_id"), "system", "parsed", "fabricated", "invalid").join(fm.event_recall(*rdf).select(*keys, F.col("recall").alias("event_recall")), keys)
    for f, c, to in ((fm.pair_substitution, "rate", "substitution"), (fm.predicate_divergence, "divergence", "divergence"), (fm.vocabulary_injection, "rate", "injection"), (fm.time_span_detachment, "rate", "detachment")):
        rows = rows.join(f(*rdf).select(*keys, F.col(c).alias(to)), keys)
    return rows


@query(f"{_SUMMARY_SQL} SELECT * FROM summary")
def fm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fm.summarize(_fm_rows(spark, sf))


# -- tables ---------------------------------------------------------------------------------------------------------

_HEADLINE_BODY = f"""{_RATES_BODY}, {_RECALL_BODY}, {_TYPES_BODY}, {_COVER_BODY},
whole AS (SELECT c.system, c.f1, coalesce(rates.oc, 0.0) AS oc, coalesce(rates.rh, 0.0) AS rh, coalesce(er.recall, 0.0) AS er, coalesce(tf.f1, 0.0) AS tf, coalesce(pc.coverage, 0.0) AS pc
  FROM scored c LEFT JOIN rates USING (text_id, system) LEFT JOIN er USING (text_id, system) LEFT JOIN tf USING (text_id, system) LEFT JOIN pc USING (text_id, system)),
headline AS (SELECT system, round_even(avg(f1), 3) AS f1_p, round_even(sum(f1) / (SELECT count(*) FROM items), 3) AS f1_all, round_even(avg(oc), 3) AS oc, round_even(avg(rh), 3) AS rh, round_even(avg(er), 3) AS entity_recall, round_even(avg(tf), 3) AS type_f1, round_even(avg(pc), 3) AS predicate_coverage,
  CAST(count(*) AS VARCHAR) || ' / ' || CAST((SELECT count(*) FROM items) AS VARCHAR) AS parsed FROM whole GROUP BY system)"""
_HEADLINE_SQL = f"{BOTH_SQL}, {_SMART_SQL.removeprefix(TRIPLES_SQL + ', ')}, {_HEADLINE_BODY}"


@query(f"{_HEADLINE_SQL} SELECT * FROM headline")
def table_headline(spark: SparkSession, sf: str) -> DataFrame:
    keys, systems = ["text_id", "system"], views.systems(spark)
    relations = spark.createDataFrame([("lives in",), ("has segment",), ("same as",)], "relation string")
    scored = checkpointed(_scored(spark, sf).select(*keys, "f1"))
    rates = metrics.hallucination_rates(_contexts(spark, sf), views.pred_triples(spark, sf), relations, _CONCEPTS).select(*keys, "oc", "rh")
    recall = matching.entity_recall(*_entities(spark, sf), systems, ratio=False).select(*keys, F.col("recall").alias("entity_recall"))
    types = matching.type_scores(*_types(spark, sf), systems, ratio=False).select(*keys, F.col("f1").alias("type_f1"))
    rows = scored.join(rates, keys, "left").join(recall, keys, "left").join(types, keys, "left").join(predicate_coverage(spark, sf).select(*keys, F.col("coverage").alias("predicate_coverage")), keys, "left").fillna(0.0)
    macro = metrics.macro_scores(rows.withColumnRenamed("f1", "f1_p"), "system", metrics=("f1_p", "oc", "rh", "entity_recall", "type_f1", "predicate_coverage"))
    return report.headline_table(macro.join(metrics.f1_over_all(views.items(spark, sf), scored, systems), "system"))


def _failure_cells(spark: SparkSession, sf: str) -> DataFrame:
    docs, systems = views.pred_docs(spark, sf), views.systems(spark)
    cleaned = docs.where("text <> ''").withColumn("text", text.clean_turtle(F.col("text")))
    status = turtle.turtle_status(cleaned).join(docs.select("graph_id", "system"), "graph_id")
    links = views.pred_rdf(spark, sf).where(F.col("p") == SAME_AS).groupBy("system").agg(F.count("*").alias("n"))
    return report.failure_mode_cells(fm_summary(spark, sf), fm.same_as_statements(docs, "system").withColumnRenamed("statements", "n"), fm.parse_counts(docs, status), systems.join(links, "system", "left").fillna(0))


_SHOWN_SQL = " UNION ALL ".join(f"SELECT '{name}' AS metric, system, CAST({c if places is None else f'round_even({c}, {places})'} AS VARCHAR) AS value FROM summary" for name, c, places in report.FAILURE_METRICS)
_CELLS_BODY = f"""cells AS ({_SHOWN_SQL}
  UNION ALL SELECT 'FM3 sameAs statements', system, CAST(CAST(sum(len(regexp_extract_all(text, 'owl:sameAs'))) AS BIGINT) AS VARCHAR) FROM pdocs GROUP BY system
  UNION ALL SELECT 'FM4 parsed (scored / strict)', system, CAST(count(*) FILTER (WHERE defect <> 'empty') AS VARCHAR) || ' / ' || CAST(count(*) FILTER (WHERE defect NOT IN ('empty', 'undeclared', 'truncated')) AS VARCHAR) FROM pdocs GROUP BY system
  UNION ALL SELECT 'FM3 sameAs triples', s.system, CAST((SELECT count(*) FROM prdf WHERE prdf.system = s.system AND p = '{SAME_AS}') AS VARCHAR) FROM systems s)"""


@query(f"""{_SUMMARY_SQL}, {_CELLS_BODY} SELECT metric, max(value) FILTER (WHERE system = 'V1') AS "V1", max(value) FILTER (WHERE system = 'V2') AS "V2", max(value) FILTER (WHERE system = 'V4') AS "V4" FROM cells GROUP BY metric""")
def table_failure_modes(spark: SparkSession, sf: str) -> DataFrame:
    return report.metric_table(_failure_cells(spark, sf), ["V1", "V2", "V4"])


@query(f"""{_SUMMARY_SQL}, {_CELLS_BODY}, printed AS (SELECT 'T5 ' || metric || ' ' || system AS cell, value AS found, CASE WHEN contains(metric, 'FM6') THEN CAST(CAST(value AS DOUBLE) + 0.0005 AS VARCHAR) WHEN contains(metric, 'FM7') THEN CAST(CAST(value AS DOUBLE) + 0.5 AS VARCHAR) WHEN contains(metric, 'FM4') THEN replace(value, ' ', '') WHEN contains(metric, 'malformed') THEN CAST(CAST(value AS BIGINT) + 1 AS VARCHAR) ELSE value END AS expected FROM cells)
SELECT cell, CASE WHEN CASE WHEN try_cast(found AS DOUBLE) IS NOT NULL AND try_cast(expected AS DOUBLE) IS NOT NULL
  THEN CASE WHEN contains(found, '.') OR contains(expected, '.') THEN abs(try_cast(found AS DOUBLE) - try_cast(expected AS DOUBLE)) <= 0.001 ELSE found = expected END
  ELSE replace(found, ' ', '') = replace(expected, ' ', '') END THEN 'PASS' ELSE 'FAIL' END AS match FROM printed""")
def verify_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The failure modes' cells against printed ones, some of which are off by more than their last place."""
    cells = checkpointed(_failure_cells(spark, sf).select(F.concat_ws(" ", F.lit("T5"), "metric", "system").alias("cell"), "value"))
    number, of = F.expr("try_cast(value AS DOUBLE)"), lambda x: F.col("cell").contains(x)
    printed = F.when(of("FM6"), (number + 0.0005).cast("string")).when(of("FM7"), (number + 0.5).cast("string")).when(of("FM4"), F.replace("value", F.lit(" "), F.lit(""))).when(of("malformed"), (number + 1).cast("long").cast("string")).otherwise(F.col("value"))
    return report.verify_cells(cells, cells.select("cell", printed.alias("value"))).select("cell", "match")


# -- ontologies and shapes ------------------------------------------------------------------------------------------

_OWL, _RDFS, _XSD = ontology.OWL, ontology.RDFS, "http://www.w3.org/2001/XMLSchema#"
_EX = views.EX


def onto_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and nations as classes, parts as properties between nations."""
    uri = lambda prefix, c: F.concat(F.lit(_EX + prefix), c.cast("string"))
    t = lambda k, s, p, o, kind="uri", lang=None: F.struct(F.lit(k).cast("long").alias("k"), F.lit("uri").alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), F.lit(kind).alias("o_kind"), o.alias("o"), (lang if lang is not None else F.lit(None)).cast("string").alias("lang"))
    r, n, p = F.col("r_regionkey"), F.col("n_nationkey"), F.col("p_partkey")
    regions = views.table(spark, sf, "region").select((r * 16).cast("long").alias("at"), F.explode(F.array(t(0, uri("R", r), RDF_TYPE, F.lit(_OWL + "Class")), t(1, uri("R", r), RDFS_LABEL, F.col("r_name"), "literal", F.lit("en")))).alias("x"))
    above = F.when(n >= 5, uri("N", n % 5)).otherwise(uri("R", F.col("n_regionkey")))
    nations = views.table(spark, sf, "nation").select((1000 + n * 16).cast("long").alias("at"), F.explode(F.array(t(0, uri("N", n), RDF_TYPE, F.lit(_OWL + "Class")), t(1, uri("N", n), RDFS_LABEL, F.col("n_name"), "literal", F.when(n % 2 == 0, "en")), t(2, uri("N", n), _RDFS + "subClassOf", above))).alias("x"))
    even = p % 2 == 0
    kind = F.when(even, _OWL + "ObjectProperty").otherwise(_OWL + "DatatypeProperty")
    reach = F.when(even, uri("N", (p + 1) % 25)).otherwise(F.lit(_XSD + "integer"))
    parts = views.table(spark, sf, "part").select((5000 + p * 16).cast("long").alias("at"), F.explode(F.array(t(0, uri("P", p), RDF_TYPE, kind), t(1, uri("P", p), RDFS_LABEL, F.concat("p_name", F.lit(" "), p.cast("string")), "literal"), t(2, uri("P", p), _RDFS + "domain", uri("N", p % 25)), t(3, uri("P", p), _RDFS + "range", reach))).alias("x"))
    out = regions.unionByName(nations).unionByName(parts)
    return out.select((F.col("at") + F.col("x.k")).alias("seq"), "x.s_kind", "x.s", "x.p", "x.o_kind", "x.o", "x.lang", F.lit(None).cast("string").alias("datatype"))


_U = lambda prefix, c: f"'{_EX}{prefix}' || CAST({c} AS VARCHAR)"
_ONTO_SQL = f"""WITH RECURSIVE onto AS (
  SELECT r_regionkey * 16 AS seq, {_U("R", "r_regionkey")} AS s, '{RDF_TYPE}' AS p, '{_OWL}Class' AS o, NULL AS lang FROM region
  UNION ALL SELECT r_regionkey * 16 + 1, {_U("R", "r_regionkey")}, '{RDFS_LABEL}', r_name, 'en' FROM region
  UNION ALL SELECT 1000 + n_nationkey * 16, {_U("N", "n_nationkey")}, '{RDF_TYPE}', '{_OWL}Class', NULL FROM nation
  UNION ALL SELECT 1001 + n_nationkey * 16, {_U("N", "n_nationkey")}, '{RDFS_LABEL}', n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'en' END FROM nation
  UNION ALL SELECT 1002 + n_nationkey * 16, {_U("N", "n_nationkey")}, '{_RDFS}subClassOf', CASE WHEN n_nationkey >= 5 THEN {_U("N", "n_nationkey % 5")} ELSE {_U("R", "n_regionkey")} END, NULL FROM nation
  UNION ALL SELECT 5000 + p_partkey * 16, {_U("P", "p_partkey")}, '{RDF_TYPE}', CASE WHEN p_partkey % 2 = 0 THEN '{_OWL}ObjectProperty' ELSE '{_OWL}DatatypeProperty' END, NULL FROM part
  UNION ALL SELECT 5001 + p_partkey * 16, {_U("P", "p_partkey")}, '{RDFS_LABEL}', p_name || ' ' || CAST(p_partkey AS VARCHAR), NULL FROM part
  UNION ALL SELECT 5002 + p_partkey * 16, {_U("P", "p_partkey")}, '{_RDFS}domain', {_U("N", "p_partkey % 25")}, NULL FROM part
  UNION ALL SELECT 5003 + p_partkey * 16, {_U("P", "p_partkey")}, '{_RDFS}range', CASE WHEN p_partkey % 2 = 0 THEN {_U("N", "(p_partkey + 1) % 25")} ELSE '{_XSD}integer' END, NULL FROM part
)"""
_PROPS = ", ".join(f"'{x}'" for x in ontology.PROPERTY_TYPES)


@query(f"{_ONTO_SQL} SELECT DISTINCT 'concept' AS kind, lower(o) AS name FROM onto WHERE p = '{RDFS_LABEL}' UNION SELECT DISTINCT 'relation', lower(l.o) FROM onto l JOIN onto t ON t.s = l.s AND t.p = '{RDF_TYPE}' AND t.o IN ({_PROPS}) WHERE l.p = '{RDFS_LABEL}'")
def ontology_meta(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.ontology_meta(onto_triples(spark, sf))


@query(f"""{_ONTO_SQL}, lab AS (SELECT s, o AS label FROM onto WHERE p = '{RDFS_LABEL}'),
shown AS (SELECT s, label || ' (' || {local_sql("s")} || ')' AS x FROM lab), ends AS (SELECT s, p, string_agg(DISTINCT {local_sql("o")}, ', ') AS e FROM onto WHERE p IN ('{_RDFS}domain', '{_RDFS}range') GROUP BY s, p)
SELECT DISTINCT 'namespaces' AS section, regexp_extract(s, '^(.*[#/])', 1) AS line FROM onto
UNION ALL SELECT 'concepts', 'Concept ''' || x || '''' FROM shown JOIN onto t USING (s) WHERE t.p = '{RDF_TYPE}' AND t.o = '{_OWL}Class'
UNION ALL SELECT 'relations', 'Relation ''' || x || ''' : ' || d.e || ' -> ' || r.e FROM shown JOIN ends d ON d.s = shown.s AND d.p = '{_RDFS}domain' JOIN ends r ON r.s = shown.s AND r.p = '{_RDFS}range'""")
def ontology_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.ontology_summary(onto_triples(spark, sf))


@query(f"""{_ONTO_SQL}, cls AS (SELECT DISTINCT s AS uri FROM onto WHERE p = '{RDF_TYPE}' AND o = '{_OWL}Class'), lab AS (SELECT s AS uri, o AS label FROM onto WHERE p = '{RDFS_LABEL}')
SELECT uri, uri AS identifier FROM cls UNION SELECT uri, 'ex:' || {local_sql("uri")} FROM cls UNION SELECT uri, label FROM cls JOIN lab USING (uri) UNION SELECT uri, label || ' (ex:' || {local_sql("uri")} || ')' FROM cls JOIN lab USING (uri)""")
def class_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.class_identifiers(onto_triples(spark, sf), spark.createDataFrame([("owl", _OWL), ("ex", _EX)], "prefix string, uri string"))


_SHAPES_SQL = f"""{_ONTO_SQL}, shapes AS (
  SELECT s AS target_class, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS class, CAST(NULL AS VARCHAR) AS datatype FROM onto WHERE p = '{RDF_TYPE}' AND o = '{_OWL}Class'
  UNION SELECT d.o, d.s, r.o, NULL FROM onto t JOIN onto d ON d.s = t.s AND d.p = '{_RDFS}domain' JOIN onto r ON r.s = t.s AND r.p = '{_RDFS}range' WHERE t.p = '{RDF_TYPE}' AND t.o = '{_OWL}ObjectProperty'
  UNION SELECT d.o, d.s, NULL, r.o FROM onto t JOIN onto d ON d.s = t.s AND d.p = '{_RDFS}domain' JOIN onto r ON r.s = t.s AND r.p = '{_RDFS}range' WHERE t.p = '{RDF_TYPE}' AND t.o = '{_OWL}DatatypeProperty')"""


@query(f"{_SHAPES_SQL} SELECT * FROM shapes")
def shapes_from_schema(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.shapes_from_schema(onto_triples(spark, sf)).select("target_class", "path", "class", "datatype")


@query(f"""{_ONTO_SQL}, own AS (SELECT s, label, lower(label) AS x FROM (SELECT DISTINCT t.s, l.o AS label FROM onto t JOIN onto l ON l.s = t.s AND l.p = '{RDFS_LABEL}' WHERE t.p = '{RDF_TYPE}' AND t.o = '{_OWL}Class')),
props AS (SELECT d.o AS s, list(l.o ORDER BY l.o) AS names FROM onto d JOIN onto l ON l.s = d.s AND l.p = '{RDFS_LABEL}' WHERE d.p = '{_RDFS}domain' GROUP BY d.o)
SELECT own.s AS target_class, 'Shape for ' || label AS label, coalesce(names, []) AS names FROM own LEFT JOIN props USING (s)""")
def shapes_as_turtle(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the node shapes and names of their property shapes, as read back from the Turtle text."""
    onto = onto_triples(spark, sf)
    lines = ontology.shapes_turtle(ontology.shapes_from_schema(onto), onto).select(F.xxhash64("target_class").alias("graph_id"), F.col("turtle").alias("text"))
    triples = checkpointed(turtle.parse_turtle(lines))
    of = lambda p, to: triples.where(F.col("p") == p).select("graph_id", F.col("o").alias(to))
    names = of(ontology.SH + "name", "name").groupBy("graph_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return of(ontology.SH + "targetClass", "target_class").join(of(RDFS_LABEL, "label"), "graph_id").join(names, "graph_id", "left").select("target_class", "label", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


_UP_SQL = f"""{_ONTO_SQL}, up(sub, sup) AS (SELECT s, o FROM onto WHERE p = '{_RDFS}subClassOf' UNION SELECT s, s FROM onto WHERE p = '{_RDFS}subClassOf' UNION SELECT o, o FROM onto WHERE p = '{_RDFS}subClassOf' UNION SELECT up.sub, e.o FROM up JOIN onto e ON e.s = up.sup AND e.p = '{_RDFS}subClassOf')"""


@query(f"{_UP_SQL} SELECT DISTINCT sub, sup FROM up")
def subclass_closure(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.closure(_subclasses(spark, sf))


def _subclasses(spark: SparkSession, sf: str) -> DataFrame:
    return onto_triples(spark, sf).where(F.col("p") == _RDFS + "subClassOf").select(F.col("s").alias("sub"), F.col("o").alias("sup"))


def restriction_triples(spark: SparkSession, sf: str) -> DataFrame:
    """For each nation a class with a restriction of one of five kinds."""
    n = F.col("n_nationkey")
    uri = lambda prefix, c: F.concat(F.lit(_EX + prefix), c.cast("string"))
    blank, own = F.concat(F.lit("_:r"), n.cast("string")), uri("N", n)
    t = lambda k, s_kind, s, p, o_kind, o: F.struct((n * 8 + k).cast("long").alias("seq"), F.lit(s_kind).alias("s_kind"), s.alias("s"), p.alias("p"), F.lit(o_kind).alias("o_kind"), o.alias("o"))
    kind = n % 5
    names = F.when(kind == 0, "minCardinality").when(kind == 1, "maxCardinality").when(kind == 2, "cardinality").when(kind == 3, "someValuesFrom").otherwise(F.lit("allValuesFrom"))
    value = F.when(kind <= 2, (n % 3).cast("string")).otherwise(uri("N", n - 1))
    rows = F.array(t(0, "uri", own, F.lit(RDF_TYPE), "uri", F.lit(_OWL + "Class")), t(1, "uri", own, F.lit(_RDFS + "subClassOf"), "bnode", blank), t(2, "bnode", blank, F.lit(_OWL + "onProperty"), "uri", uri("P", n)), t(3, "bnode", blank, F.concat(F.lit(_OWL), names), "literal", value))
    return views.table(spark, sf, "nation").select(F.explode(rows).alias("x")).select("x.*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))


@query(f"""WITH r AS (SELECT {_U("N", "n_nationkey")} AS target_class, {_U("P", "n_nationkey")} AS path, n_nationkey % 5 AS kind, NULLIF(n_nationkey % 3, 0) AS n, {_U("N", "n_nationkey - 1")} AS other FROM nation)
SELECT target_class, NULL AS path, NULL AS class, 0 AS min_count, 0 AS max_count FROM r
UNION ALL SELECT target_class, path, CASE WHEN kind > 2 THEN other END, CAST(CASE WHEN kind IN (0, 2) THEN n WHEN kind = 3 THEN 1 ELSE 0 END AS INT), CAST(CASE WHEN kind IN (1, 2) THEN n ELSE 0 END AS INT) FROM r WHERE kind > 2 OR n IS NOT NULL""")
def shapes_from_restrictions(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.shapes_from_schema(restriction_triples(spark, sf)).select("target_class", "path", "class", F.coalesce("min_count", F.lit(0)).alias("min_count"), F.coalesce("max_count", F.lit(0)).alias("max_count"))


@query(f"SELECT 'declared' AS way, '{_EX}onto#' AS namespace UNION ALL SELECT 'prefix', '{_EX}'")
def ontology_namespace(spark: SparkSession, sf: str) -> DataFrame:
    onto = onto_triples(spark, sf)
    declared = onto.limit(0).unionByName(spark.createDataFrame([(0, "uri", _EX + "onto", RDF_TYPE, "uri", _OWL + "Ontology", None, None)], onto.schema))
    prefixes = spark.createDataFrame([("owl", _OWL), ("xsd", _XSD), ("ex", _EX), ("z", "http://z/")], "prefix string, uri string")
    way = lambda name, d: d.select(F.lit(name).alias("way"), "namespace")
    return way("declared", ontology.ontology_namespace(onto.unionByName(declared), prefixes)).unionByName(way("prefix", ontology.ontology_namespace(onto, prefixes)))


@query(f"{_SHAPES_SQL} SELECT 'basic' AS source, 1 AS n, 0 AS classes UNION ALL SELECT 'ontology', count(*), count(DISTINCT target_class) FROM shapes UNION ALL SELECT 'cached', count(*), count(DISTINCT target_class) FROM shapes")
def shapes_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Without anything the template, with an ontology its shapes, which are then read from where they were written."""
    onto, cached = onto_triples(spark, sf), f"{checkpoint_dir(spark).rstrip('/')}/shapes-{uuid.uuid4().hex}"
    found = [("basic", ontology.resolve_shapes(spark, None, None)), ("ontology", ontology.resolve_shapes(spark, cached, onto)), ("cached", ontology.resolve_shapes(spark, cached, None))]
    counted = [d.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("target_class").startswith(_EX), F.col("target_class"))).alias("classes")).select(F.lit(s).alias("source"), "n", "classes") for s, d in found]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def instance_data(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as members of their nation, with a value of the property that has its number."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    uri = lambda prefix, x: F.concat(F.lit(_EX + prefix), x.cast("string"))
    t = lambda p, o, kind, datatype: F.struct(p.alias("p"), kind.alias("o_kind"), o.alias("o"), datatype.cast("string").alias("datatype"))
    typed = t(F.lit(RDF_TYPE), uri("N", n), F.lit("uri"), F.lit(None))
    value = t(uri("P", n), F.when(n % 2 == 0, uri("c", c + 1)).otherwise((c * 3).cast("string")), F.when(n % 2 == 0, "uri").otherwise("literal"), F.when((n % 2 == 1) & (c % 3 != 0), _XSD + "integer"))
    twice = t(uri("P", n), uri("c", c + 2), F.lit("uri"), F.lit(None))
    rows = F.when(c % 7 == 0, F.array(typed)).when(c % 5 == 0, F.array(typed, value, twice)).otherwise(F.array(typed, value))
    return views.table(spark, sf, "customer").select(F.lit("g").alias("graph_id"), uri("c", c).alias("s"), F.explode(rows).alias("x")).select("graph_id", "s", "x.*", F.lit(None).cast("string").alias("lang"))


_DATA_SQL = f"""data AS (
  SELECT {_U("c", "c_custkey")} AS s, '{RDF_TYPE}' AS p, 'uri' AS o_kind, {_U("N", "c_nationkey")} AS o, NULL AS datatype FROM customer
  UNION ALL SELECT {_U("c", "c_custkey")}, {_U("P", "c_nationkey")}, CASE WHEN c_nationkey % 2 = 0 THEN 'uri' ELSE 'literal' END, CASE WHEN c_nationkey % 2 = 0 THEN {_U("c", "c_custkey + 1")} ELSE CAST(c_custkey * 3 AS VARCHAR) END, CASE WHEN c_nationkey % 2 = 1 AND c_custkey % 3 <> 0 THEN '{_XSD}integer' END FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT {_U("c", "c_custkey")}, {_U("P", "c_nationkey")}, 'uri', {_U("c", "c_custkey + 2")}, NULL FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 = 0
), types AS (SELECT DISTINCT d.s AS node, u.sup AS class FROM data d JOIN up u ON u.sub = d.o WHERE d.p = '{RDF_TYPE}' UNION SELECT DISTINCT s, o FROM data WHERE p = '{RDF_TYPE}')"""
_ALL_SQL = f"{_UP_SQL}, {_SHAPES_SQL.removeprefix(_ONTO_SQL + ', ')}, {_DATA_SQL}"


def _checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    data = instance_data(spark, sf)
    return data, ontology.shapes_from_schema(onto_triples(spark, sf)), ontology.inferred_types(data, ontology.closure(_subclasses(spark, sf)))


@query(f"{_ALL_SQL} SELECT DISTINCT 'g' AS graph_id, t.node AS focus_node, d.p AS path, d.o AS value, 'value is not a ' || {local_sql('h.class')} AS message FROM types t JOIN shapes h ON h.target_class = t.class AND h.class IS NOT NULL JOIN data d ON d.s = t.node AND d.p = h.path WHERE NOT EXISTS (SELECT 1 FROM types v WHERE v.node = d.o AND v.class = h.class)")
def shacl_class_violations(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.class_violations(*_checked(spark, sf))


@query(f"{_ALL_SQL} SELECT DISTINCT 'g' AS graph_id, t.node AS focus_node, d.p AS path, d.o AS value, 'value is not of ' || {local_sql('h.datatype')} AS message FROM types t JOIN shapes h ON h.target_class = t.class AND h.datatype IS NOT NULL JOIN data d ON d.s = t.node AND d.p = h.path WHERE d.o_kind <> 'literal' OR coalesce(d.datatype, '{_XSD}string') <> h.datatype")
def shacl_datatype(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.datatype_violations(*_checked(spark, sf))


@query(f"""{_ALL_SQL}, prop AS (SELECT s AS sub, s AS sup FROM onto WHERE p = '{RDF_TYPE}' AND o IN ({_PROPS}) UNION SELECT {_U("P", "p_partkey")}, {_U("P", "p_partkey - 1")} FROM part WHERE p_partkey % 2 = 1),
up_props(sub, sup) AS (SELECT sub, sup FROM prop UNION SELECT u.sub, p.sup FROM up_props u JOIN prop p ON p.sub = u.sup),
more AS (SELECT d.s, u.sup AS p, d.o_kind, d.o FROM data d JOIN up_props u ON u.sub = d.p), entailed AS (
  SELECT s AS node, o AS class FROM data WHERE p = '{RDF_TYPE}' UNION SELECT m.s, d.o FROM more m JOIN onto d ON d.s = m.p AND d.p = '{_RDFS}domain' UNION SELECT m.o, r.o FROM more m JOIN onto r ON r.s = m.p AND r.p = '{_RDFS}range' WHERE m.o_kind = 'uri')
SELECT DISTINCT 'g' AS graph_id, node, class FROM (SELECT node, class FROM entailed UNION ALL SELECT e.node, u.sup FROM entailed e JOIN up u ON u.sub = e.class)""")
def rdfs_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types that follow by subclasses, subproperties, domains and ranges."""
    p = F.col("p_partkey")
    uri = lambda c: F.concat(F.lit(_EX + "P"), c.cast("string"))
    onto = onto_triples(spark, sf)
    own = [f.name for f in onto.schema]
    below = views.table(spark, sf, "part").where(p % 2 == 1).select(p.cast("long").alias("seq"), F.lit("uri").alias("s_kind"), uri(p).alias("s"), F.lit(_RDFS + "subPropertyOf").alias("p"), F.lit("uri").alias("o_kind"), uri(p - 1).alias("o"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("datatype"))
    return ontology.rdfs_types(instance_data(spark, sf), onto.select(*own).unionByName(below.select(*own)))


@query(f"{_ALL_SQL}, n AS (SELECT t.node, h.path, count(d.o) AS n FROM types t JOIN shapes h ON h.target_class = t.class AND h.path IS NOT NULL LEFT JOIN data d ON d.s = t.node AND d.p = h.path GROUP BY t.node, h.path) SELECT 'g' AS graph_id, node AS focus_node, path, CAST(NULL AS VARCHAR) AS value, CASE WHEN n < 1 THEN 'fewer than 1 values' ELSE 'more than 1 values' END AS message FROM n WHERE n <> 1")
def shacl_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    data, shapes, types = _checked(spark, sf)
    return ontology.count_violations(data, shapes.where("path is not null").withColumns({"min_count": F.lit(1), "max_count": F.lit(1)}), types)


def result_graph(spark: SparkSession, sf: str) -> DataFrame:
    """A validation's result graph: a node for each order, without some of its parts."""
    o = F.col("o_orderkey")
    node = F.concat(F.lit("_:r"), o.cast("string"))
    t = lambda p, value, when=F.lit(True): F.when(when, F.struct(F.lit(p).alias("p"), value.alias("o")))
    rows = F.array(t(RDF_TYPE, F.lit(ontology.SH + "ValidationResult")), t(ontology.SH + "focusNode", F.concat(F.lit(_EX + "o"), o.cast("string"))), t(ontology.SH + "resultPath", F.col("o_orderstatus"), o % 2 == 0), t(ontology.SH + "value", F.col("o_orderpriority"), o % 3 == 0), t(ontology.SH + "resultMessage", F.concat(F.lit("bad "), "o_orderstatus"), o % 5 != 0), t(ontology.SH + "resultSeverity", F.lit(ontology.SH + "Warning"), o % 4 == 0))
    return views.table(spark, sf, "orders").select(F.lit("g").alias("graph_id"), node.alias("s"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("graph_id", "s", "x.p", "x.o")


@query(f"SELECT 'g' AS graph_id, {_U('o', 'o_orderkey')} AS focus_node, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS path, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS value, CASE WHEN o_orderkey % 5 <> 0 THEN 'bad ' || o_orderstatus ELSE 'Constraint violated' END AS message, CASE WHEN o_orderkey % 4 = 0 THEN 'Warning' ELSE 'Violation' END AS severity FROM orders")
def violation_report(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.violation_report(result_graph(spark, sf))


@query(f"{TURTLE_SQL} SELECT graph_id, CASE WHEN defect IN ('undeclared', 'truncated') THEN 2 WHEN defect = 'empty' THEN 3 ELSE 1 END AS iterations, defect <> 'empty' AS passed, CASE WHEN defect = 'empty' THEN 1 ELSE 0 END AS total_violations FROM tdocs")
def repair_loop(spark: SparkSession, sf: str) -> DataFrame:
    docs = _cleaned(spark, sf).select("graph_id", "text")
    none = spark.createDataFrame([], "graph_id long, focus_node string")

    def check(d: DataFrame) -> DataFrame:
        return ontology.validation_status(d, turtle.turtle_status(d), none).select("graph_id", F.col("total_violations").cast("int").alias("total_violations"))

    def repair(d: DataFrame) -> DataFrame:
        return d.withColumn("text", F.regexp_replace("text", r"\nex:a [^\n]*$", "\n"))

    return ontology.repair_loop(docs, check, repair)


# -- candidates, pages, answers, Turtle -----------------------------------------------------------------------------


@query("SELECT entity, CAST(rank AS INT) AS rank, candidate, score FROM (SELECT n_name AS entity, c_name AS candidate, c_acctbal AS score, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_name) AS rank FROM customer JOIN nation ON n_nationkey = c_nationkey) WHERE rank <= 5")
def topk_candidates(spark: SparkSession, sf: str) -> DataFrame:
    nation = views.table(spark, sf, "nation").select("n_nationkey", "n_name")  # 25 rows
    hits = views.table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("entity"), F.col("c_name").alias("candidate"), F.col("c_acctbal").alias("score"))
    return pipeline.top_candidates(hits)


@query("""SELECT page_id, CAST(pos AS INT) AS "at", regexp_extract(item, '<a href="([^"]*)"', 1) AS link, trim(regexp_extract(item, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM (
  SELECT page_id, unnest(items) AS item, unnest(range(len(items))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages))""")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    found = views.table(spark, sf, "pages").select("page_id", F.posexplode(arrow.html_links()("html")).alias("at", "x"))
    return found.select("page_id", "at", "x.link", "x.title")


_ANSWERS = {
    "named_entities": ("'[{\"entity\": \"E' || {id} || '\", \"class\": \"' || event_type || '\"}, {\"entity\": \"F\"}]'", "'E' || {id} || '/' || event_type || ';F/'"),
    "coreferences": ("'[[\"E' || {id} || '\", \"it\"], [\"' || event_type || '\"]]'", "'E' || {id} || ',it;' || event_type"),
    "relations": ("'[{\"head\": \"E' || {id} || '\", \"relation\": \"is\", \"tail\": \"' || event_type || '\", \"more\": 1}]'", "'E' || {id} || ' is ' || event_type"),
    "linked_entities": ("'{\"E' || {id} || '\": {\"aat\": [\"1\", \"2\"], \"wikidata\": []}}'", "'E' || {id} || ':1,2:'"),
}
_ITEMS = {
    "named_entities": "array_join(transform(parsed, x -> concat(x.entity, '/', coalesce(x.class, ''))), ';')",
    "coreferences": "array_join(transform(parsed, x -> array_join(x, ',')), ';')",
    "relations": "array_join(transform(parsed, x -> concat_ws(' ', x.head, x.relation, x.tail)), ';')",
    "linked_entities": "array_join(transform(map_entries(parsed), x -> concat(x.key, ':', array_join(x.value.aat, ','), ':', array_join(x.value.wikidata, ','))), ';')",
}
_KINDS = list(pipeline.CONTRACTS)


@query(" UNION ALL ".join(f"SELECT event_id, '{k}' AS contract, CASE WHEN event_id % 7 <> 0 THEN {_ANSWERS[k][1].replace('{id}', 'CAST(event_id AS VARCHAR)')} END AS items FROM events WHERE event_id % {len(_KINDS)} = {i}" for i, k in enumerate(_KINDS)))
def json_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to the four contracts, in fences and bare; every seventh is cut short and isn't such an answer."""
    rows, parts = views.table(spark, sf, "events").select("event_id", "event_type"), []
    for i, kind in enumerate(_KINDS):
        raw = F.expr(_ANSWERS[kind][0].replace("{id}", "CAST(event_id AS STRING)"))
        cut = F.when(F.col("event_id") % 7 == 0, F.substring(raw, 1, 9)).otherwise(raw)
        fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
        own = pipeline.parse_answers(rows.where(F.col("event_id") % len(_KINDS) == i).withColumn("answer", fenced), kind)
        whole = F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.expr(_ITEMS[kind])) if kind == "linked_entities" else F.expr(_ITEMS[kind])
        parts.append(own.select("event_id", F.lit(kind).alias("contract"), whole.cast("string").alias("items")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {views.BASE_SQL}, ents AS (SELECT c AS doc_id, c_name || ' of ' || n_name AS text, unnest([c_name, CASE WHEN c % 3 = 0 THEN 'Atlantis' ELSE n_name END]) AS entity FROM base),
rels AS (SELECT c AS doc_id, c_name AS head, CASE WHEN c % 4 = 0 THEN 'Nowhere' ELSE n_name END AS tail FROM base)
SELECT DISTINCT doc_id, 'entity not in text' AS breach, entity AS item FROM ents WHERE NOT contains(text, entity)
UNION SELECT doc_id, 'head unknown', head FROM rels r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = r.doc_id AND e.entity = r.head)
UNION SELECT doc_id, 'tail unknown', tail FROM rels r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = r.doc_id AND e.entity = r.tail)""")
def contract_breaches(spark: SparkSession, sf: str) -> DataFrame:
    base = views.base(spark, sf).withColumnRenamed("c", "doc_id")
    place = F.when(F.col("doc_id") % 3 == 0, "Atlantis").otherwise(F.col("n_name"))
    entities = base.select("doc_id", F.concat_ws(" of ", "c_name", "n_name").alias("text"), F.explode(F.array("c_name", place)).alias("entity"))
    relations = base.select("doc_id", F.col("c_name").alias("head"), F.lit("lives in").alias("relation"), F.when(F.col("doc_id") % 4 == 0, "Nowhere").otherwise(F.col("n_name")).alias("tail"))
    return pipeline.contract_breaches(entities, relations)


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS valid FROM orders")
def validator_verdict(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, "The graph is VALID.").when(k == 1, F.concat(F.lit("INVALID: "), "o_orderstatus")).otherwise(F.lit("no answer"))
    return views.table(spark, sf, "orders").select("o_orderkey", pipeline.verdict(said).alias("valid"))


@query("""SELECT s_suppkey, 0 AS "at", '/e/' || CAST(s_suppkey AS VARCHAR) AS link, s_name AS title, 'from nation ' || CAST(s_nationkey AS VARCHAR) AS description FROM supplier
UNION ALL SELECT s_suppkey, 1, '/f', 'Other & more', '' FROM supplier WHERE s_suppkey % 2 = 0""")
def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results inside a page's container; lists before and after it, and items without a link, are none."""
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    other = F.when(F.col("s_suppkey") % 2 == 0, '<li><a href="/f">Other &amp; more</a></li>').otherwise(F.lit("<li>no link</li>"))
    page = F.concat(F.lit('<ul><li><a href="/menu">Menu</a></li></ul><div class="wide search-results"><div><ul><li><a href="/e/'), key, F.lit('">'), name, F.lit("</a> <p>from nation "), F.col("s_nationkey").cast("string"), F.lit("</p></li>"), other, F.lit('</ul></div></div><div><li><a href="/foot">Foot</a></li></div>'))
    found = views.table(spark, sf, "supplier").select("s_suppkey", F.posexplode(arrow.html_links("search-results")(page)).alias("at", "x"))
    return found.select("s_suppkey", "at", "x.link", "x.title", "x.description")


@query("""SELECT c_custkey, CAST(i AS INT) AS "at", CASE i WHEN 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'total' END AS key, CASE i WHEN 0 THEN c_name || ' <' || c_mktsegment || '>' ELSE '' END AS name FROM customer, range(2) r(i)""")
def html_table(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the table of a given class, not of the one before it."""
    rows = F.concat(F.lit('<table><tr><th>x</th></tr><tr><td>no</td></tr></table><table class="table table-striped"><thead><tr><th>Key</th><th> Name </th></tr></thead><tr><td>'), F.col("c_custkey").cast("string"), F.lit("</td><td><b>"), "c_name", F.lit("</b> &lt;"), "c_mktsegment", F.lit("&gt;</td></tr><tr><td>total</td><td></td></tr></table>"))
    found = views.table(spark, sf, "customer").select("c_custkey", F.posexplode(arrow.html_table()(rows)).alias("at", "x"))
    return found.select("c_custkey", "at", F.col("x")["Key"].alias("key"), F.col("x")["Name"].alias("name"))


@query(f"""{TURTLE_SQL} SELECT graph_id, prefix, namespace FROM tdocs, (VALUES ('ex', '{views.EX}'), ('rdfs', 'http://www.w3.org/2000/01/rdf-schema#'), ('ns1', 'http://example.org/x/')) v(prefix, namespace) WHERE defect IN ('ok', 'fenced', 'dup_prefix', 'invalid_ns')""")
def bound_namespaces(spark: SparkSession, sf: str) -> DataFrame:
    docs = _cleaned(spark, sf)
    return graphs.bound_namespaces(turtle.parse_turtle(docs), text.used_prefixes(docs))


_PARSED = f"""SELECT graph_id, 0 AS seq, '{_EX}p' || CAST(graph_id AS VARCHAR) AS s, '{RDF_TYPE}' AS p, '{_EX}Part' AS o, CAST(NULL AS VARCHAR) AS lang FROM tdocs WHERE {{0}}
UNION ALL SELECT graph_id, 1, '{_EX}p' || CAST(graph_id AS VARCHAR), '{RDFS_LABEL}', name, 'en' FROM tdocs WHERE {{0}}
UNION ALL SELECT graph_id, 2, '{_EX}p' || CAST(graph_id AS VARCHAR), 'http://example.org/x/number', CAST(graph_id AS VARCHAR), NULL FROM tdocs WHERE {{0}}
UNION ALL SELECT graph_id, 0, 'http://example.org/ns', 'http://example.org/q', CAST(graph_id AS VARCHAR), NULL FROM tdocs WHERE defect = 'no_prefix'"""


@query(f"{TURTLE_SQL} " + _PARSED.format("defect NOT IN ('empty', 'no_prefix', 'undeclared', 'truncated')"))
def turtle_parse_strict(spark: SparkSession, sf: str) -> DataFrame:
    return turtle.parse_turtle(_cleaned(spark, sf), turtle.STRICT).select("graph_id", F.col("seq").cast("int").alias("seq"), "s", "p", "o", "lang")


@query(f"{TURTLE_SQL} " + _PARSED.format("defect NOT IN ('empty', 'no_prefix')"))
def turtle_parse_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return turtle.parse_turtle(_cleaned(spark, sf), turtle.PREFIX).select("graph_id", F.col("seq").cast("int").alias("seq"), "s", "p", "o", "lang")


@query(f"{TURTLE_SQL} SELECT graph_id, defect NOT IN ('undeclared', 'truncated') AS valid, CAST(CASE WHEN defect IN ('undeclared', 'truncated', 'empty') THEN 0 WHEN defect = 'no_prefix' THEN 1 ELSE 3 END AS BIGINT) AS triple_count FROM tdocs")
def turtle_validate(spark: SparkSession, sf: str) -> DataFrame:
    return turtle.turtle_status(_cleaned(spark, sf)).select("graph_id", "valid", "triple_count")


from . import flows  # noqa: E402, F401 - its queries are registered as it is read
