"""Graphs from files of any Hadoop path, by their extension: Turtle, RDF/XML and JSON-LD."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import count
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .turtle import RDF, STRICT, TRIPLE_SCHEMA, XSD, read

XML = "{http://www.w3.org/XML/1998/namespace}"
Triple = tuple[str, str, str, str, str, str | None, str | None]  # s_kind, s, p, o_kind, o, lang, datatype


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1)


class _RdfXml:
    """The triples of an RDF/XML text, after the W3C's grammar: node elements hold property elements hold node elements."""

    def __init__(self, base: str):
        self.out: list[Triple] = []
        self.base, self.blanks, self.named = base, count(), {}

    def blank(self, name: str | None = None) -> tuple[str, str]:
        if name is None:
            return "bnode", f"_:x{next(self.blanks)}"
        if name not in self.named:
            self.named[name] = self.blank()
        return self.named[name]

    def uri(self, value: str, base: str) -> tuple[str, str]:
        return "uri", urljoin(base, value) if base else value

    def add(self, s: tuple[str, str], p: str, o: tuple[str, str], lang: str | None = None, datatype: str | None = None) -> None:
        self.out.append((*s, p, *o, lang, datatype))

    def subject(self, e: ElementTree.Element, base: str) -> tuple[str, str]:
        get = lambda name: e.get(f"{{{RDF}}}{name}")
        if get("about") is not None:
            return self.uri(get("about"), base)
        if get("ID") is not None:
            return self.uri("#" + get("ID"), base)
        return self.blank(get("nodeID"))

    def node(self, e: ElementTree.Element, base: str, lang: str | None) -> tuple[str, str]:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        s = self.subject(e, base)
        if _iri(e.tag) != RDF + "Description":
            self.add(s, RDF + "type", ("uri", _iri(e.tag)))
        self.attributes(s, e, base, lang)
        items = count(1)
        for child in e:
            self.property(s, child, base, lang, items)
        return s

    def attributes(self, s: tuple[str, str], e: ElementTree.Element, base: str, lang: str | None) -> None:
        """Properties that stand as attributes."""
        for name, value in e.attrib.items():
            p = _iri(name) if name.startswith("{") else ""
            if p == RDF + "type":
                self.add(s, p, self.uri(value, base))
            elif p and not p.startswith(RDF) and not name.startswith(XML):
                self.add(s, p, ("literal", value), lang)

    def property(self, s: tuple[str, str], e: ElementTree.Element, base: str, lang: str | None, items: Iterator[int]) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        get = lambda name: e.get(f"{{{RDF}}}{name}")
        p = _iri(e.tag)
        p = f"{RDF}_{next(items)}" if p == RDF + "li" else p
        kind = get("parseType")
        if kind == "Literal":
            inner = (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
            self.add(s, p, ("literal", inner), None, RDF + "XMLLiteral")
        elif kind == "Resource":
            o, more = self.blank(), count(1)
            self.add(s, p, o)
            for child in e:
                self.property(o, child, base, lang, more)
        elif kind == "Collection":
            nodes = [self.node(c, base, lang) for c in e]
            cells = [self.blank() for _ in nodes]
            for cell, n, rest in zip(cells, nodes, [*cells[1:], ("uri", RDF + "nil")], strict=False):
                self.add(cell, RDF + "first", n)
                self.add(cell, RDF + "rest", rest)
            self.add(s, p, cells[0] if cells else ("uri", RDF + "nil"))
        elif len(e):
            self.add(s, p, self.node(e[0], base, lang))
        elif get("resource") is not None or get("nodeID") is not None or any(k.startswith("{") and not k.startswith((XML, f"{{{RDF}}}")) for k in e.attrib):
            o = self.uri(get("resource"), base) if get("resource") is not None else self.blank(get("nodeID"))
            self.add(s, p, o)
            self.attributes(o, e, base, lang)
        else:
            datatype = get("datatype")
            self.add(s, p, ("literal", e.text or ""), None if datatype else lang, datatype)


def read_rdfxml(text: str, base: str = "") -> list[Triple]:
    root, reader = ElementTree.fromstring(text.lstrip("﻿")), _RdfXml(base)
    base, lang = root.get(XML + "base", base), root.get(XML + "lang")
    for node in root if _iri(root.tag) == RDF + "RDF" else [root]:
        reader.node(node, base, lang)
    return reader.out


class _JsonLd:
    """The triples of a JSON-LD text whose contexts stand in it: terms, prefixes, vocabulary, base, coercions, lists, reverse."""

    def __init__(self) -> None:
        self.out: list[Triple] = []
        self.blanks = count()

    def context(self, now: dict, found: object) -> dict:
        now = dict(now)
        for part in found if isinstance(found, list) else [found]:
            if part is None:
                now = {}
            elif isinstance(part, dict):
                now |= part
            else:
                raise ValueError(f"the context {part!r} isn't in the text")
        return now

    def iri(self, name: str, ctx: dict, term: bool = False) -> str:
        if term and name in ctx:
            how = ctx[name]
            to = how.get("@id", how.get("@reverse", name)) if isinstance(how, dict) else how
            return to if to == name or to.startswith("@") else self.iri(to, ctx)
        prefix, colon, rest = name.partition(":")
        if colon and not rest.startswith("//") and prefix in ctx and prefix != "_":
            return self.iri(prefix, ctx, True) + rest
        if colon:
            return name
        if term:
            return ctx.get("@vocab", "") + name
        return urljoin(ctx.get("@base", ""), name)

    def named(self, iri: str) -> tuple[str, str]:
        return ("bnode" if iri.startswith("_:") else "uri"), iri

    def value(self, v: object, ctx: dict, how: dict) -> tuple[tuple[str, str], str | None, str | None] | None:
        if isinstance(v, dict) and "@value" in v:
            datatype = self.iri(v["@type"], ctx, True) if "@type" in v else None
            return *self.literal(v["@value"], datatype), v.get("@language")
        if isinstance(v, dict) and "@list" in v:
            return self.list(v["@list"], ctx, how), None, None
        if isinstance(v, dict):
            return self.node(v, ctx), None, None
        if isinstance(v, str) and how.get("@type") == "@id":
            return self.named(self.iri(v, ctx)), None, None
        if isinstance(v, str) and how.get("@type") == "@vocab":
            return self.named(self.iri(v, ctx, True)), None, None
        if v is None:
            return None
        datatype = self.iri(how["@type"], ctx, True) if how.get("@type") else None
        lang = how.get("@language", ctx.get("@language")) if isinstance(v, str) and not datatype else None
        return *self.literal(v, datatype), lang

    def literal(self, v: object, datatype: str | None) -> tuple[tuple[str, str], str | None]:
        if isinstance(v, bool):
            return ("literal", str(v).lower()), datatype or XSD + "boolean"
        if isinstance(v, int):
            return ("literal", str(v)), datatype or XSD + "integer"
        if isinstance(v, float):
            digits, power = f"{v:.15E}".split("E")
            return ("literal", f"{digits.rstrip('0')}{'0' * digits.rstrip('0').endswith('.')}E{int(power)}"), datatype or XSD + "double"
        return ("literal", str(v)), datatype

    def list(self, items: list, ctx: dict, how: dict) -> tuple[str, str]:
        found = [x for x in (self.value(i, ctx, how) for i in items) if x]
        cells = [("bnode", f"_:j{next(self.blanks)}") for _ in found]
        for cell, (o, datatype, lang), rest in zip(cells, found, [*cells[1:], ("uri", RDF + "nil")], strict=False):
            self.out.append((*cell, RDF + "first", *o, lang, datatype))
            self.out.append((*cell, RDF + "rest", *rest, None, None))
        return cells[0] if cells else ("uri", RDF + "nil")

    def node(self, n: dict, ctx: dict) -> tuple[str, str]:
        ctx = self.context(ctx, n["@context"]) if "@context" in n else ctx
        keys = {self.iri(k, ctx, True) if not k.startswith("@") else k: k for k in n}
        s = self.named(self.iri(n[keys["@id"]], ctx)) if "@id" in keys else ("bnode", f"_:j{next(self.blanks)}")
        for key, raw in keys.items():
            many = n[raw] if isinstance(n[raw], list) else [n[raw]]
            how = ctx[raw] if isinstance(ctx.get(raw), dict) else {}
            if key == "@type":
                self.out += [(*s, RDF + "type", *self.named(self.iri(t, ctx, True)), None, None) for t in many]
            elif key == "@graph":
                for item in many:
                    self.node(item, ctx)
            elif "@reverse" in how:
                for item in many:
                    o = self.value(item, ctx, how)
                    self.out.append((*o[0], self.iri(how["@reverse"], ctx, True), *s, None, None))
            elif not key.startswith("@") and ":" in key:
                found = [(self.list(many, ctx, how), None, None)] if how.get("@container") == "@list" else [self.value(v, ctx, how) for v in many]
                self.out += [(*s, key, *o, lang, datatype) for o, datatype, lang in filter(None, found)]
        return s


def read_jsonld(text: str) -> list[Triple]:
    reader, found = _JsonLd(), json.loads(text)
    for node in found if isinstance(found, list) else [found]:
        if set(node) - {"@context", "@graph"} or "@graph" not in node:
            reader.node(node, {})
        else:
            ctx = reader.context({}, node.get("@context", {}))
            for item in node["@graph"] if isinstance(node["@graph"], list) else [node["@graph"]]:
                reader.node(item, ctx)
    return reader.out


def _rows(triples: list[Triple]) -> list[tuple]:
    return [(i, *t) for i, t in enumerate(dict.fromkeys(triples))]


READERS: dict[str, Callable[[str], list[tuple]]] = {
    "owl": lambda text: _rows(read_rdfxml(text)),
    "rdf": lambda text: _rows(read_rdfxml(text)),
    "xml": lambda text: _rows(read_rdfxml(text)),
    "jsonld": lambda text: _rows(read_jsonld(text)),
}


def parse_files(files: DataFrame, mode: str = STRICT) -> DataFrame:
    """(graph_id, TRIPLE_SCHEMA) of files (name, extension, text). Other extensions than those of READERS are read as Turtle.

    RDF/XML and JSON-LD that can't be read raise; Turtle follows ``mode``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TRIPLE_SCHEMA.split(", ")]
        for batch in batches:
            rows = [(name, *row) for name, kind, text in batch.itertuples(index=False) for row in (READERS[kind](text) if kind in READERS else read(text, mode)[0])]
            yield pd.DataFrame(rows, columns=["graph_id", *names])

    return files.select("name", "extension", "text").mapInPandas(run, f"graph_id string, {TRIPLE_SCHEMA}")


def read_graphs(spark: SparkSession, path: str, pattern: str = "*", mode: str = STRICT) -> DataFrame:
    """(graph_id, TRIPLE_SCHEMA): the graphs of all files under a path of any file system that Spark reads; a file's name is its graph."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return parse_files(files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"), F.col("value").alias("text")), mode)
