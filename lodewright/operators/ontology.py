"""Ontologies as triple tables: names, summaries, closures, shapes and the violations of data against shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.functions.lineage import checkpointed
from lodewright.functions.text import RDF_TYPE, RDFS_LABEL, local_name, namespace, severity_name
from lodewright.sources.turtle import parse_turtle

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
STANDARD = [RDF, RDFS, OWL, "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/XML/1998/namespace"]
PROPERTY_TYPES = [RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty"]
CONCEPT_TYPES = [OWL + "Class", RDFS + "Class"]
SHAPES = "target_class string, path string, class string, datatype string, min_count int, max_count int"


def ontology_meta(onto: DataFrame) -> DataFrame:
    """(kind, name): lower-case labels of all nodes (concept), and of properties (relation); one hash join."""
    labels = onto.where(F.col("p") == RDFS_LABEL).select("s", F.lower("o").alias("name"))
    properties = onto.where((F.col("p") == RDF_TYPE) & F.col("o").isin(PROPERTY_TYPES)).select("s").distinct()
    concepts = labels.select(F.lit("concept").alias("kind"), "name")
    return concepts.unionByName(labels.join(properties, "s", "left_semi").select(F.lit("relation").alias("kind"), "name")).distinct()


def best_labels(onto: DataFrame) -> DataFrame:
    """(s, label): in English, else without a language, else the first."""
    rank = F.struct(F.when(F.col("lang") == "en", 0).when(F.col("lang").isNull(), 1).otherwise(2).alias("r"), F.col("seq"))
    return onto.where(F.col("p") == RDFS_LABEL).groupBy("s").agg(F.min_by("o", rank).alias("label"))


def class_identifiers(onto: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(uri, identifier): of each class its address, its short name, each label, and its best label with the short name.

    The short name has the prefix that ``prefixes`` (prefix, uri) bind to its namespace; without one it is the local name.
    """
    classes = onto.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + "Class") & (F.col("s_kind") == "uri")).select(F.col("s").alias("uri")).distinct()
    named = classes.select("uri", namespace(F.col("uri")).alias("namespace"), local_name(F.col("uri")).alias("local"))
    if prefixes is None:
        short = named.select("uri", F.col("local").alias("identifier"))
    else:
        bound = prefixes.groupBy(F.col("uri").alias("namespace")).agg(F.min("prefix").alias("prefix"))
        short = named.join(bound, "namespace", "left").select("uri", F.when(F.col("prefix").isNull(), F.col("local")).otherwise(F.concat_ws(":", "prefix", "local")).alias("identifier"))
    labels = onto.where((F.col("p") == RDFS_LABEL) & (F.col("o_kind") == "literal")).select(F.col("s").alias("uri"), F.col("o").alias("identifier")).join(classes, "uri", "left_semi")
    full = short.join(best_labels(onto).withColumnRenamed("s", "uri"), "uri").select("uri", F.concat("label", F.lit(" ("), "identifier", F.lit(")")).alias("identifier"))
    return classes.select("uri", F.col("uri").alias("identifier")).unionByName(short).unionByName(labels).unionByName(full).distinct()


def ontology_summary(onto: DataFrame) -> DataFrame:
    """(section, line): sorted namespaces, concepts and relations with domains and ranges."""
    named = best_labels(onto)
    shown = F.concat(F.coalesce("label", local_name(F.col("s"))), F.lit(" ("), local_name(F.col("s")), F.lit(")"))
    of = lambda kinds: onto.where((F.col("p") == RDF_TYPE) & F.col("o").isin(kinds) & (F.col("s_kind") == "uri")).select("s").distinct()
    spaces = onto.where("s_kind = 'uri'").select(F.lit("namespaces").alias("section"), namespace(F.col("s")).alias("line")).where(F.col("line") != "").distinct()
    concepts = of(CONCEPT_TYPES).join(named, "s", "left").select(F.lit("concepts").alias("section"), F.concat(F.lit("Concept '"), shown, F.lit("'")).alias("line"))
    ends = lambda p, to: onto.where(F.col("p") == RDFS + p).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set(local_name(F.col("o")))), ", ").alias(to))
    relations = of(PROPERTY_TYPES).join(named, "s", "left").join(ends("domain", "d"), "s", "left").join(ends("range", "r"), "s", "left")
    line = F.concat(F.lit("Relation '"), shown, F.lit("' : "), F.coalesce("d", F.lit("any")), F.lit(" -> "), F.coalesce("r", F.lit("any")))
    return spaces.unionByName(concepts).unionByName(relations.select(F.lit("relations").alias("section"), line.alias("line")))


def summary_text(summary: DataFrame) -> DataFrame:
    """(section, text): each section's lines, sorted, as one text."""
    return summary.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))


def ontology_namespace(onto: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(namespace): the owl:Ontology's address with a hash, else the first prefix that isn't standard."""
    own = onto.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + "Ontology")).orderBy("seq").limit(1).select(F.when(F.col("s").rlike("[#/]$"), F.col("s")).otherwise(F.concat("s", F.lit("#"))).alias("namespace"), F.lit(0).alias("rank"))
    if prefixes is None:
        return own.select("namespace")
    other = prefixes.where(~F.col("uri").isin(STANDARD)).orderBy("prefix").limit(1).select(F.col("uri").alias("namespace"), F.lit(1).alias("rank"))
    return own.unionByName(other).orderBy("rank").limit(1).select("namespace")


def closure(edges: DataFrame) -> DataFrame:
    """(sub, sup): the reflexive and transitive closure of (sub, sup) edges of any depth; cycles are allowed.

    Paths double in length with each step, and every pair is kept once, until no new one comes up.
    """
    edges = edges.select("sub", "sup").distinct()
    nodes = edges.select("sub").unionByName(edges.select(F.col("sup").alias("sub"))).distinct()
    found = checkpointed(edges.unionByName(nodes.select("sub", F.col("sub").alias("sup"))).distinct())
    size = found.count()
    while True:
        longer = found.join(found.select(F.col("sub").alias("sup"), F.col("sup").alias("above")).hint("merge"), "sup").select("sub", F.col("above").alias("sup"))
        found, before = checkpointed(longer.distinct()), size  # each pair is its own path with a loop, so none is lost
        size = found.count()
        if size == before:
            return found


def shapes_from_schema(onto: DataFrame) -> DataFrame:
    """SHAPES of an ontology: classes, properties by domain and range, and restrictions.

    Several ranges give several shapes, all of which hold. A restriction's cardinality of 0 gives none.
    """
    typed = onto.where(F.col("p") == RDF_TYPE).select("s", "o", "s_kind")
    named = lambda kind: typed.where((F.col("o") == OWL + kind) & (F.col("s_kind") == "uri")).select("s").distinct()
    value = lambda p, to: onto.where(F.col("p") == p).select("s", F.col("o").alias(to), F.col("o_kind").alias(f"{to}_kind"))
    null = lambda kind: F.lit(None).cast(kind)
    classes = named("Class").select(F.col("s").alias("target_class"), null("string").alias("path"), null("string").alias("class"), null("string").alias("datatype"), null("int").alias("min_count"), null("int").alias("max_count"))

    def properties(kind: str, to: str) -> DataFrame:
        domain = value(RDFS + "domain", "domain").where("domain_kind = 'uri'")
        ranges = value(RDFS + "range", "range").where("range_kind = 'uri'")
        both = named(kind).join(domain.hint("merge"), "s").join(ranges.hint("merge"), "s", "left")  # as large as the ontology
        of = F.col("range")
        return both.select(F.col("domain").alias("target_class"), F.col("s").alias("path"), (of if to == "class" else null("string")).alias("class"), (of if to == "datatype" else null("string")).alias("datatype"), null("int").alias("min_count"), null("int").alias("max_count"))

    own = onto.where(F.col("p") == RDFS + "subClassOf").where("o_kind = 'bnode' and s_kind = 'uri'").select(F.col("s").alias("target_class"), F.col("o").alias("r"))
    at = lambda p: F.max(F.when(F.col("p") == OWL + p, F.col("o")))
    parts = onto.where("s_kind = 'bnode'").groupBy(F.col("s").alias("r")).agg(at("onProperty").alias("path"), *(at(p).alias(p) for p in ("minCardinality", "maxCardinality", "cardinality", "someValuesFrom", "allValuesFrom")))
    count = lambda p: F.when(F.expr(f"try_cast(`{p}` AS INT)") > 0, F.expr(f"try_cast(`{p}` AS INT)"))
    least = F.coalesce(count("cardinality"), count("minCardinality"), F.when(F.col("someValuesFrom").isNotNull(), 1))
    restrictions = own.join(parts, "r").where("path is not null").select("target_class", "path", F.coalesce("allValuesFrom", "someValuesFrom").alias("class"), null("string").alias("datatype"), least.cast("int").alias("min_count"), F.coalesce(count("cardinality"), count("maxCardinality")).cast("int").alias("max_count"))
    some = F.coalesce("class", "datatype", F.col("min_count").cast("string"), F.col("max_count").cast("string")).isNotNull()
    return classes.unionByName(properties("ObjectProperty", "class")).unionByName(properties("DatatypeProperty", "datatype")).unionByName(restrictions.where(some)).distinct()


def basic_shapes(spark: SparkSession) -> DataFrame:
    """The template for when there is no ontology: whatever has a type needs one."""
    return spark.createDataFrame([(RDFS + "Resource", RDF_TYPE, None, None, 1, None)], SHAPES)


def shapes_turtle(shapes: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """(target_class, turtle): each class's node shape as a line of Turtle without prefixes; labels and names are the ontology's."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    quoted = lambda c: F.concat(F.lit('"'), swap(swap(swap(c, "\\", "\\\\"), '"', '\\"'), "\n", "\\n"), F.lit('"'))
    sh = lambda p, value: F.concat(F.lit(f"<{SH}{p}> "), value)
    labels = best_labels(onto) if onto is not None else shapes.select(F.col("target_class").alias("s"), F.lit(None).cast("string").alias("label")).limit(0)
    rows = shapes.join(labels.withColumnsRenamed({"s": "path", "label": "name"}), "path", "left")
    parts = F.concat_ws(" ; ", sh("path", iri(F.col("path"))), sh("class", iri(F.col("class"))), sh("datatype", iri(F.col("datatype"))), sh("minCount", F.col("min_count").cast("string")), sh("maxCount", F.col("max_count").cast("string")), sh("name", quoted(F.col("name"))))
    properties = F.array_sort(F.collect_set(F.when(F.col("path").isNotNull(), F.concat(F.lit(f"<{SH}property> [ "), parts, F.lit(" ]")))))
    own = rows.groupBy("target_class").agg(properties.alias("properties")).join(labels.withColumnRenamed("s", "target_class"), "target_class", "left")
    about = F.concat(iri(F.concat("target_class", F.lit("Shape"))), F.lit(f" a <{SH}NodeShape>"))
    label = F.concat(F.lit(f"<{RDFS}label> "), quoted(F.concat(F.lit("Shape for "), F.coalesce("label", local_name(F.col("target_class"))))))
    return own.select("target_class", F.concat(F.concat_ws(" ; ", about, sh("targetClass", iri(F.col("target_class"))), label, F.concat_ws(" ; ", F.when(F.size("properties") > 0, F.col("properties")))), F.lit(" .")).alias("turtle"))


def shapes_from_triples(triples: DataFrame) -> DataFrame:
    """SHAPES of a shapes graph (graph_id and triples): target classes and the constraints of their property shapes."""
    of = lambda p, to: triples.where(F.col("p") == SH + p).select("graph_id", "s", F.col("o").alias(to))
    targets = of("targetClass", "target_class")
    at = lambda p: F.max(F.when(F.col("p") == SH + p, F.col("o"))).alias(p)
    constraints = triples.groupBy("graph_id", F.col("s").alias("property")).agg(*(at(p) for p in ("path", "class", "datatype", "minCount", "maxCount"))).where("path is not null")
    rows = targets.join(of("property", "property"), ["graph_id", "s"]).join(constraints, ["graph_id", "property"])
    null = F.lit(None).cast("string")
    whole = rows.select("target_class", "path", "class", "datatype", F.col("minCount").cast("int").alias("min_count"), F.col("maxCount").cast("int").alias("max_count"))
    return whole.unionByName(targets.select("target_class", null.alias("path"), null.alias("class"), null.alias("datatype"), null.cast("int").alias("min_count"), null.cast("int").alias("max_count"))).distinct()


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """SHAPES of Turtle that ``shapes_turtle`` made, a class a line."""
    lines = spark.read.text(path).select(F.xxhash64("value").alias("graph_id"), F.col("value").alias("text"))
    return shapes_from_triples(parse_turtle(lines))


def resolve_shapes(spark: SparkSession, cached: str | None, onto: DataFrame | None) -> DataFrame:
    """Shapes from written Turtle, else made from the ontology and written there, else the basic template."""
    if cached:
        try:
            return read_shapes(spark, cached)
        except AnalysisException as e:  # not there yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if onto is None:
        return basic_shapes(spark)
    shapes = shapes_from_schema(onto)
    if not cached:
        return shapes
    shapes_turtle(shapes, onto).select("turtle").write.mode("overwrite").text(cached)
    return read_shapes(spark, cached)


def inferred_types(data: DataFrame, subclasses: DataFrame | None = None) -> DataFrame:
    """(graph_id, node, class): stated types and what follows by ``subclasses`` (sub, sup; a closure)."""
    stated = data.where(F.col("p") == RDF_TYPE).select("graph_id", F.col("s").alias("node"), F.col("o").alias("class"))
    if subclasses is None:
        return stated.distinct()
    above = stated.join(subclasses.select(F.col("sub").alias("class"), "sup"), "class").select("graph_id", "node", F.col("sup").alias("class"))
    return stated.unionByName(above).distinct()


def rdfs_types(data: DataFrame, schema: DataFrame) -> DataFrame:
    """(graph_id, node, class): types by RDFS: stated, by domains and ranges of properties and of those above them, and by subclasses.

    ``schema``: triples (s, p, o, o_kind) with subClassOf, subPropertyOf, domain and range. It may be large, and Spark's
    guess of its size far too low, so that it is merged and never sent to the driver.
    """
    edges = lambda p: schema.where((F.col("p") == RDFS + p) & (F.col("o_kind") == "uri")).select(F.col("s").alias("sub"), F.col("o").alias("sup"))
    ends = lambda p: edges(p).select(F.col("sub").alias("p"), F.col("sup").alias("class"))
    above = closure(edges("subPropertyOf")).select(F.col("sub").alias("p"), "sup")
    own = data.select("graph_id", "s", "p", "o_kind", "o")
    wider = own.unionByName(own.join(above.hint("merge"), "p").select("graph_id", "s", F.col("sup").alias("p"), "o_kind", "o"))
    by_domain = wider.join(ends("domain").hint("merge"), "p").select("graph_id", F.col("s").alias("node"), "class")
    by_range = wider.where("o_kind <> 'literal'").join(ends("range").hint("merge"), "p").select("graph_id", F.col("o").alias("node"), "class")
    stated = data.where(F.col("p") == RDF_TYPE).select("graph_id", F.col("s").alias("node"), F.col("o").alias("class"))
    types = stated.unionByName(by_domain).unionByName(by_range).distinct()
    parents = closure(edges("subClassOf")).select(F.col("sub").alias("class"), "sup")
    return types.unionByName(types.join(parents.hint("merge"), "class").select("graph_id", "node", F.col("sup").alias("class"))).distinct()


def _constrained(values: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    """Values (graph_id, node, path, ...) with the shapes of their path for each class of their node.

    A node's classes come first, so that a class's shapes meet only the paths that its nodes have. All three tables
    grow with the data: they are merged, as Spark's guess of their sizes may be far too low for what it broadcasts.
    """
    of = values.join(types.withColumnRenamed("class", "target_class").hint("merge"), ["graph_id", "node"])
    return of.join(shapes.where("path is not null").hint("merge"), ["target_class", "path"])


def class_violations(data: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    """Values of a path that haven't its class: (graph_id, focus_node, path, value, message)."""
    wanted = shapes.where("class is not null").select("target_class", "path", F.col("class").alias("wanted"))
    values = _constrained(data.select("graph_id", F.col("s").alias("node"), F.col("p").alias("path"), F.col("o").alias("value")), wanted, types)
    have = types.select("graph_id", F.col("node").alias("value"), F.col("class").alias("wanted"))
    bad = values.join(have.hint("merge"), ["graph_id", "value", "wanted"], "left_anti")
    return bad.select("graph_id", F.col("node").alias("focus_node"), "path", "value", F.concat(F.lit("value is not a "), local_name(F.col("wanted"))).alias("message")).distinct()


def datatype_violations(data: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    """Values of a path that aren't literals of its datatype."""
    wanted = shapes.where("datatype is not null").select("target_class", "path", F.col("datatype").alias("wanted"))
    values = _constrained(data.select("graph_id", F.col("s").alias("node"), F.col("p").alias("path"), F.col("o").alias("value"), "o_kind", F.coalesce("datatype", F.when(F.col("lang").isNull(), "http://www.w3.org/2001/XMLSchema#string")).alias("has")), wanted, types)
    bad = values.where((F.col("o_kind") != "literal") | ~F.col("has").eqNullSafe(F.col("wanted")))
    return bad.select("graph_id", F.col("node").alias("focus_node"), "path", "value", F.concat(F.lit("value is not of "), local_name(F.col("wanted"))).alias("message")).distinct()


#: A task of ``_absent`` takes about so many nodes by so many paths.
TILE = 2048


def _count_message(n: Column) -> Column:
    few, many = n < F.col("min_count"), n > F.col("max_count")
    return F.when(few, F.concat(F.lit("fewer than "), F.col("min_count").cast("string"), F.lit(" values"))).when(many, F.concat(F.lit("more than "), F.col("max_count").cast("string"), F.lit(" values")))


def _absent(types: DataFrame, shapes: DataFrame, held: DataFrame) -> DataFrame:
    """(graph_id, node, path, message) for paths that a node has no value of; ``held``: (graph_id, node, path) that it has.

    The paths are made distinct once for each set of classes, and not for each node; nodes meet them in tiles, so that
    no row of the result, which may be far larger than the data, is shuffled.
    """
    classes = types.withColumnRenamed("class", "target_class").join(shapes.select("target_class").distinct().hint("merge"), "target_class", "left_semi")
    sets = classes.groupBy("graph_id", "node").agg(F.array_sort(F.collect_set("target_class")).alias("classes"))
    have = held.groupBy("graph_id", "node").agg(F.collect_set("path").alias("have"))
    nodes = checkpointed(sets.join(have.hint("merge"), ["graph_id", "node"], "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>"))))
    kinds = nodes.groupBy("classes").agg(F.count("*").alias("nodes"))
    paths = kinds.select("classes", F.explode("classes").alias("target_class")).join(shapes.hint("merge"), "target_class").select("classes", "path", _count_message(F.lit(0)).alias("message")).where("message is not null").distinct()
    paths = checkpointed(paths)
    parts = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    sizes = checkpointed(kinds.join(paths.groupBy("classes").agg(F.count("*").alias("paths")), "classes").select("classes", parts("nodes").alias("down"), parts("paths").alias("across")))
    tasks = min(10_000, sizes.agg(F.sum(F.col("down").cast("long") * F.col("across"))).first()[0] or 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n).cast("long")).cast("int")
    tile = ["classes", "i", "j"]
    left = nodes.join(sizes, "classes").select("classes", place("down", "graph_id", "node").alias("i"), each("across").alias("j"), "graph_id", "node", "have")
    blocks = paths.join(sizes, "classes").select("classes", "down", place("across", "path").alias("j"), F.struct("path", "message").alias("x")).groupBy("classes", "down", "j").agg(F.collect_list("x").alias("xs"))
    right = blocks.select("classes", each("down").alias("i"), "j", "xs")
    met = left.repartition(tasks, *tile).join(right.repartition(tasks, *tile).hint("merge"), tile)
    return met.select("graph_id", "node", "have", F.explode("xs").alias("x")).where(~F.array_contains("have", F.col("x.path"))).select("graph_id", "node", "x.path", "x.message")


def count_violations(data: DataFrame, shapes: DataFrame, types: DataFrame) -> DataFrame:
    """Nodes with too few or too many values of a path."""
    bounds = shapes.where("path is not null and (min_count is not null or max_count is not null)").select("target_class", "path", "min_count", "max_count").distinct()
    counts = data.groupBy("graph_id", F.col("s").alias("node"), F.col("p").alias("path")).agg(F.count("*").alias("n"))
    held = _constrained(counts, bounds, types)
    wrong = held.select("graph_id", "node", "path", _count_message(F.col("n")).alias("message")).where("message is not null").distinct()
    both = wrong.unionByName(_absent(types, bounds, held.select("graph_id", "node", "path")))
    return both.select("graph_id", F.col("node").alias("focus_node"), "path", F.lit(None).cast("string").alias("value"), "message")


def violations(data: DataFrame, shapes: DataFrame, subclasses: DataFrame | None = None, schema: DataFrame | None = None) -> DataFrame:
    """All violations, with severity; a graph conforms if it has none. With a ``schema`` types follow by all of RDFS."""
    types = inferred_types(data, subclasses) if schema is None else rdfs_types(data, schema)
    all_ = class_violations(data, shapes, types).unionByName(datatype_violations(data, shapes, types)).unionByName(count_violations(data, shapes, types))
    return all_.withColumn("severity", F.lit("Violation"))


def validation_status(docs: DataFrame, status: DataFrame, found: DataFrame) -> DataFrame:
    """(graph_id, conforms, total_violations): an empty text is one violation, an unreadable one is one critical violation."""
    n = found.groupBy("graph_id").agg(F.count("*").alias("n"))
    both = docs.select("graph_id", (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).alias("empty")).join(status.select("graph_id", "valid"), "graph_id", "left").join(n, "graph_id", "left")
    total = F.when(F.col("empty") | ~F.coalesce("valid", F.lit(False)), 1).otherwise(F.coalesce("n", F.lit(0)))
    return both.select("graph_id", (total == 0).alias("conforms"), total.cast("long").alias("total_violations"))


def violation_report(results: DataFrame) -> DataFrame:
    """(graph_id, focus_node, path, value, message, severity) of a result graph of validation: one pattern, four options."""
    nodes = results.where((F.col("p") == RDF_TYPE) & (F.col("o") == SH + "ValidationResult")).select("graph_id", "s")
    out = nodes
    for p, to in (("focusNode", "focus_node"), ("resultPath", "path"), ("value", "value"), ("resultMessage", "message"), ("resultSeverity", "severity")):
        out = out.join(results.where(F.col("p") == SH + p).select("graph_id", "s", F.col("o").alias(to)), ["graph_id", "s"], "inner" if to == "focus_node" else "left")
    return out.select("graph_id", "focus_node", "path", "value", F.coalesce("message", F.lit("Constraint violated")).alias("message"), severity_name(F.col("severity")).alias("severity"))


def repair_loop(docs: DataFrame, check: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """(graph_id, iterations, passed, total_violations): checks, and repairs what fails, at most ``rounds`` times.

    check: docs -> (graph_id, total_violations); repair: failing docs -> docs. The last round doesn't repair.
    What has passed takes no further part.
    """
    pending, done = docs, None
    for i in range(1, rounds + 1):
        state = checkpointed(check(pending))
        last = i == rounds
        ended = state.where("total_violations = 0" if not last else "true").select("graph_id", F.lit(i).alias("iterations"), (F.col("total_violations") == 0).alias("passed"), "total_violations")
        done = ended if done is None else done.unionByName(ended)
        if not last:
            pending = repair(pending.join(state.where("total_violations > 0").select("graph_id"), "graph_id", "left_semi"))
    return done
