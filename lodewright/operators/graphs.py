"""Labels, entities, types and predicates of RDF triple tables.

A triple table: graph_id, seq, s_kind, s, p, o_kind, o, lang, datatype; kinds are uri, bnode, literal. Blank
nodes are known within their graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.functions.text import CRM, DOMAIN, RDF_TYPE, RDFS_LABEL, SAME_AS, local_name, namespace

LABEL_LIKE = [RDF_TYPE, RDFS_LABEL]


def english_labels(triples: DataFrame, key: str = "graph_id") -> DataFrame:
    """(key, node, label): the last label in English, else the first without a language; others don't count."""
    own = triples.where((F.col("p") == RDFS_LABEL) & (F.col("lang").isNull() | (F.col("lang") == "en")))
    english = F.col("lang").isNotNull()
    rank = F.struct(english.alias("english"), F.when(english, F.col("seq")).otherwise(-F.col("seq")).alias("at"))
    return own.groupBy(key, F.col("s").alias("node")).agg(F.max_by("o", rank).alias("label"))


def suffix(uri: Column) -> Column:
    """After the last hash, else slash, else colon; null if there is none."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).when(uri.contains("/"), F.substring_index(uri, "/", -1)).when(uri.contains(":"), F.substring_index(uri, ":", -1))


def suffix_labels(ontology: DataFrame) -> DataFrame:
    """(suffix, label) of an ontology's labels; English over untagged, the last English, the first untagged."""
    named = ontology.withColumn("s", suffix(F.col("s"))).where("s is not null").withColumn("graph_id", F.lit("ontology"))
    return english_labels(named).select(F.col("node").alias("suffix"), "label")


def blank_labels(triples: DataFrame) -> DataFrame:
    """(graph_id, node, label): a blank subject's sorted parts, its types by name and others as predicate=object."""
    own = triples.where((F.col("s_kind") == "bnode") & (F.col("p") != RDFS_LABEL))
    plain = F.when(F.col("o_kind") == "bnode", "_").otherwise(F.col("o"))
    value = F.when(plain.contains("http"), local_name(plain)).otherwise(plain)
    part = F.when(F.col("p") == RDF_TYPE, local_name(F.col("o"))).otherwise(F.concat(local_name(F.col("p")), F.lit("="), value))
    parts = own.groupBy("graph_id", F.col("s").alias("node")).agg(F.array_join(F.array_sort(F.collect_list(part)), " ").alias("label"))
    bare = triples.where("s_kind = 'bnode'").select("graph_id", F.col("s").alias("node")).distinct()
    return bare.join(parts, ["graph_id", "node"], "left").withColumn("label", F.coalesce("label", F.lit("_blank")))


def fallback_name(node: Column) -> Column:
    """What a node without a label is called by: text after the last colon, or of an address its last part."""
    bare = F.replace(node, F.lit(">"), F.lit(""))
    return F.when(node.contains("http") | node.contains("://"), F.substring_index(F.substring_index(bare, "/", -1), "#", -1)).otherwise(F.substring_index(node, ":", -1))


def label_triples(triples: DataFrame, ontology: DataFrame | None = None, keep: Column | None = None) -> DataFrame:
    """(graph_id, seq, sub, rel, obj): each triple but types and labels, its nodes as labels.

    A node's label is its own in the graph or the ontology, a blank node's parts, the ontology's by suffix, or its
    last part without underscores. Literals go the same way. ``ontology`` is joined on its nodes; it may be large.
    """
    own = english_labels(triples).withColumn("rank", F.lit(1))
    blank = blank_labels(triples).join(own, ["graph_id", "node"], "left_anti")
    # One table of nodes in use, resolved once, then joined back three times.
    used = triples.where(~F.col("p").isin(LABEL_LIKE)).select("graph_id", F.explode(F.array("s", "p", "o")).alias("node")).distinct()
    local = own.drop("rank").unionByName(blank)
    named = used.join(local, ["graph_id", "node"], "left")
    name = F.regexp_replace(fallback_name(F.col("node")), "_", " ")
    if ontology is not None:
        whole = english_labels(ontology.withColumn("graph_id", F.lit("o"))).select("node", F.col("label").alias("o_label"))
        by_suffix = suffix_labels(ontology).select(F.col("suffix").alias("_suffix"), F.col("label").alias("s_label"))
        named = named.join(whole, "node", "left").join(by_suffix, fallback_name(F.col("node")) == F.col("_suffix"), "left")
        # The ontology's label of a node overrides the graph's own.
        named = named.withColumn("label", F.coalesce("o_label", "label", "s_label"))
    resolved = named.select("graph_id", "node", F.coalesce("label", F.trim(name)).alias("label"))
    out = triples.where(~F.col("p").isin(LABEL_LIKE)).select("graph_id", "seq", "s", "p", "o")
    for column, to in (("s", "sub"), ("p", "rel"), ("o", "obj")):
        out = out.join(resolved.select("graph_id", F.col("node").alias(column), F.col("label").alias(to)), ["graph_id", column], "left")
    return out.select("graph_id", "seq", "sub", "rel", "obj")


def lower_label(kind: Column, node: Column, label: Column) -> Column:
    """Of literals their text, of blank nodes nothing, of others their first label or last part; in lower case."""
    return F.when(kind == "literal", F.lower(F.trim(node))).when(kind == "bnode", "").otherwise(F.lower(F.trim(F.coalesce(label, F.regexp_replace(local_name(node), "_", " ")))))


def _readable(uri: Column) -> Column:
    return F.regexp_replace(local_name(uri), "[_-]", " ")


def labelled_entities(triples: DataFrame) -> DataFrame:
    """(graph_id, label, uri, seq): URI subjects by each of their labels, or else by last part; the last URI of a label.

    A last part that is itself some label in the graph doesn't count.
    """
    subjects = triples.where("s_kind = 'uri'").groupBy("graph_id", F.col("s").alias("uri")).agg(F.min("seq").alias("seq"))
    labels = triples.where((F.col("p") == RDFS_LABEL) & (F.col("s_kind") == "uri")).select("graph_id", F.col("s").alias("uri"), F.trim("o").alias("label"), "seq").where("label <> ''")
    bare = subjects.join(labels.select("graph_id", "uri").distinct(), ["graph_id", "uri"], "left_anti").withColumn("local", local_name(F.col("uri")))
    free = bare.where("local <> ''").join(labels.select("graph_id", F.col("label").alias("local")).distinct(), ["graph_id", "local"], "left_anti")
    both = labels.unionByName(free.select("graph_id", "uri", _readable(F.col("uri")).alias("label"), "seq"))
    return both.groupBy("graph_id", "label").agg(F.max_by("uri", "seq").alias("uri"), F.min("seq").alias("seq"))


def _by_object(triples: DataFrame) -> DataFrame:
    """Adds at: the order of a predicate's triples by their object's first place, then by their own."""
    first = F.min("seq").over(Window.partitionBy("graph_id", "p", "o_kind", "o", "lang", "datatype"))
    return triples.withColumn("_first", first).withColumn("at", F.struct("_first", "seq")).drop("_first")


def type_sets(triples: DataFrame) -> DataFrame:
    """(graph_id, label, types, at): the type names of each label, sorted; a URI goes by its last label, or its last part.

    Labels and types are taken object by object, in the order in which the objects come first; at orders labels so.
    """
    named = _by_object(triples.where((F.col("p") == RDFS_LABEL) & (F.col("s_kind") == "uri"))).groupBy("graph_id", F.col("s").alias("node")).agg(F.trim(F.max_by("o", "at")).alias("label"))
    typed = _by_object(triples.where(F.col("p") == RDF_TYPE)).where((F.col("s_kind") == "uri") & (F.col("o_kind") == "uri")).select("graph_id", F.col("s").alias("node"), local_name(F.col("o")).alias("type"), "at")
    both = typed.join(named, ["graph_id", "node"], "left")
    label = F.coalesce("label", _readable(F.col("node")))
    return both.withColumn("label", label).where("label <> ''").groupBy("graph_id", "label").agg(F.array_sort(F.collect_set("type")).alias("types"), F.min("at").alias("at"))


def predicate_names(triples: DataFrame) -> DataFrame:
    """(graph_id, predicate): distinct names but those of types, labels and same-as."""
    return triples.where(~F.col("p").isin([*LABEL_LIKE, SAME_AS])).select("graph_id", local_name(F.col("p")).alias("predicate")).distinct()


def is_crm(uri: Column) -> Column:
    return uri.startswith(CRM) | uri.startswith(DOMAIN)


def crm_predicates(triples: DataFrame) -> DataFrame:
    """(graph_id, predicate): distinct names of predicates of the reference ontology."""
    return triples.where(is_crm(F.col("p"))).select("graph_id", local_name(F.col("p")).alias("predicate")).distinct()


def used_namespaces(triples: DataFrame) -> DataFrame:
    """(graph_id, namespace): of subjects, predicates, objects and datatypes that are URIs."""
    uris = F.array(F.when(F.col("s_kind") == "uri", F.col("s")), F.col("p"), F.when(F.col("o_kind") == "uri", F.col("o")), F.col("datatype"))
    return triples.select("graph_id", F.explode(uris).alias("uri")).where("uri is not null").select("graph_id", namespace(F.col("uri")).alias("namespace")).where("namespace <> ''").distinct()


def bound_namespaces(triples: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(graph_id, prefix, namespace): declared prefixes whose namespace is in use."""
    return prefixes.select("graph_id", "prefix", F.col("uri").alias("namespace")).join(used_namespaces(triples), ["graph_id", "namespace"], "left_semi")
