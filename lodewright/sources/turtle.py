"""A Turtle reader: triples of a text, all or none (STRICT), or those before the first error (PREFIX)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STRICT, PREFIX = "STRICT", "PREFIX"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TRIPLE_SCHEMA = "seq long, s_kind string, s string, p string, o_kind string, o string, lang string, datatype string"
STATUS_SCHEMA = "valid boolean, triple_count long, error string"


class TurtleError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    kind: str
    value: str
    lang: str | None = None
    datatype: str | None = None


_LEXEMES = re.compile(
    r"""(?P<space>(?:[ \t\r\n]+|\#[^\n]*)+)
      | (?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]{4,8}[^<>"{}|^`\\\x00-\x20]*)*>)
      | (?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
      | (?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
      | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      | (?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)(?![\w:]))
      | (?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
      | (?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
      | (?P<word>[A-Za-z]+)
      | (?P<mark>\^\^|[.;,()\[\]])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise TurtleError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S) if "\\" in text else text


@dataclass
class Reader:
    """Yields (subject, predicate, object) as they are read; a blank node's own triples come before those that use it."""

    text: str
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str = ""
    _blank: int = 0

    def __post_init__(self) -> None:
        self._tokens = self._lex()
        self._kind, self._value = None, ""
        self._ready: list[tuple[Term, str, Term]] = []

    def _lex(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _LEXEMES.match(self.text, at)
            if m is None:
                raise TurtleError(f"unexpected {self.text[at : at + 20]!r} at {at}")
            at = m.end()
            if m.lastgroup != "space":
                yield m.lastgroup, m[0]
        yield "end", ""

    def _next(self) -> None:
        self._kind, self._value = next(self._tokens)

    def _take(self, value: str) -> None:
        if self._value != value or self._kind == "string":
            raise TurtleError(f"{value!r} expected, not {self._value[:40]!r}")
        self._next()

    def _resolve(self, iri: str) -> str:
        iri = _unescape(iri)
        if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
            from urllib.parse import urljoin

            return urljoin(self.base, iri)
        return iri

    def _expand(self, name: str) -> str:
        prefix, _, local = name.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"prefix {prefix}: is not declared")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _new_blank(self) -> Term:
        self._blank += 1
        return Term("bnode", f"_:genid{self._blank}")

    def triples(self) -> Iterator[tuple[Term, str, Term]]:
        self._next()
        while self._kind != "end":
            word = self._value.lower() if self._kind in ("at", "word") else ""
            if word in ("@prefix", "prefix", "@base", "base"):
                self._directive(word)
            else:
                yield from self._statement()

    def _directive(self, word: str) -> None:
        self._next()
        if word.endswith("prefix"):
            name = self._value
            if self._kind != "name" or not name.endswith(":") or name.count(":") != 1:
                raise TurtleError(f"a prefix expected, not {name[:40]!r}")
            self._next()
        if self._kind != "iri":
            raise TurtleError(f"an IRI expected, not {self._value[:40]!r}")
        iri = self._resolve(self._value[1:-1])
        if word.endswith("prefix"):
            self.prefixes[name[:-1]] = iri
        else:
            self.base = iri
        self._next()
        if word[0] == "@":
            self._take(".")
        elif self._value == "." and self._kind == "mark":
            self._next()

    def _statement(self) -> Iterator[tuple[Term, str, Term]]:
        bracket = self._value == "[" and self._kind == "mark"
        subject = yield from self._term(subject=True)
        if not (bracket and self._value == "."):
            yield from self._predicates(subject)
        self._take(".")

    def _predicates(self, subject: Term) -> Iterator[tuple[Term, str, Term]]:
        while True:
            if self._kind == "word" and self._value == "a":
                predicate = RDF + "type"
                self._next()
            else:
                term = yield from self._term()
                if term.kind != "uri":
                    raise TurtleError("a predicate must be an IRI")
                predicate = term.value
            objects = []  # an error in a list of objects loses the whole list, but not what stands inside its objects
            while True:
                objects.append((yield from self._term()))
                if self._value != "," or self._kind != "mark":
                    break
                self._next()
            for value in objects:
                yield subject, predicate, value
            if self._value != ";" or self._kind != "mark":
                return
            while self._value == ";" and self._kind == "mark":
                self._next()
            if self._kind == "mark" and self._value in ".]" or self._kind == "end":
                return

    def _term(self, subject: bool = False) -> Iterator[tuple[Term, str, Term]]:
        kind, value = self._kind, self._value
        if kind == "iri":
            self._next()
            return Term("uri", self._resolve(value[1:-1]))
        if kind == "name":
            self._next()
            return Term("uri", self._expand(value))
        if kind == "blank":
            self._next()
            return Term("bnode", value)
        if kind == "mark" and value == "[":
            node = self._new_blank()
            self._next()
            if self._value != "]" or self._kind != "mark":
                yield from self._predicates(node)
            self._take("]")
            return node
        if kind == "mark" and value == "(":
            return (yield from self._collection())
        if subject:
            raise TurtleError(f"a subject expected, not {value[:40]!r}")
        return self._literal()

    def _collection(self) -> Iterator[tuple[Term, str, Term]]:
        self._next()
        nodes: list[Term] = []
        while self._value != ")" or self._kind != "mark":
            if self._kind == "end":
                raise TurtleError("a collection isn't closed")
            node = self._new_blank()
            if nodes:
                yield nodes[-1], RDF + "rest", node
            nodes.append(node)
            yield node, RDF + "first", (yield from self._term())
        self._next()
        if not nodes:
            return Term("uri", RDF + "nil")
        yield nodes[-1], RDF + "rest", Term("uri", RDF + "nil")
        return nodes[0]

    def _literal(self) -> Term:
        kind, value = self._kind, self._value
        if kind in ("string", "long"):
            cut = 3 if kind == "long" else 1
            text = _unescape(value[cut:-cut])
            self._next()
            if self._kind == "at":
                lang = self._value[1:].lower()
                self._next()
                return Term("literal", text, lang)
            if self._value == "^^" and self._kind == "mark":
                self._next()
                if self._kind not in ("iri", "name"):
                    raise TurtleError("a datatype must be an IRI")
                datatype = self._resolve(self._value[1:-1]) if self._kind == "iri" else self._expand(self._value)
                self._next()
                return Term("literal", text, None, datatype)
            return Term("literal", text)
        if kind == "number":
            self._next()
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return Term("literal", value, None, XSD + name)
        if kind == "word" and value in ("true", "false"):
            self._next()
            return Term("literal", value, None, XSD + "boolean")
        raise TurtleError(f"a term expected, not {value[:40]!r}")


def read(text: str | None, mode: str = STRICT) -> tuple[list[tuple], str | None]:
    """Rows of TRIPLE_SCHEMA, a graph's distinct triples in order of their first reading, and the error if there is one."""
    seen: dict[tuple, int] = {}
    error = None
    try:
        for s, p, o in Reader(text or "").triples():
            seen.setdefault((s.kind, s.value, p, o.kind, o.value, o.lang, o.datatype), len(seen))
    except (TurtleError, RecursionError) as e:
        error = str(e) or type(e).__name__
        if mode == STRICT:
            seen = {}
    return [(seq, *key) for key, seq in seen.items()], error


def parse_turtle(docs: DataFrame, mode: str = STRICT, key: str = "graph_id", text: str = "text") -> DataFrame:
    """(key, TRIPLE_SCHEMA): the triples of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in TRIPLE_SCHEMA.split(", ")]
        for batch in batches:
            rows = [(k, *row) for k, x in zip(batch[key], batch[text], strict=True) for row in read(x, mode)[0]]
            yield pd.DataFrame(rows, columns=[key, *names])

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {TRIPLE_SCHEMA}")


def turtle_status(docs: DataFrame, key: str = "graph_id", text: str = "text") -> DataFrame:
    """(key, valid, triple_count, error): whether each text parses, whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(x) for x in batch[text]]
            yield pd.DataFrame({key: batch[key], "valid": [e is None for _, e in found], "triple_count": [len(r) for r, _ in found], "error": [e for _, e in found]})

    return docs.select(key, text).mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, {STATUS_SCHEMA}")


def distinct_triples(triples: DataFrame, key: str = "graph_id") -> DataFrame:
    """A graph is a set: repeated triples keep their first place."""
    same = [key, "s_kind", "s", "p", "o_kind", "o", "lang", "datatype"]
    first = Window.partitionBy(*same).orderBy("seq")
    return triples.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def register_turtle(spark: SparkSession) -> None:
    """SQL: ``SELECT * FROM docs, LATERAL parse_turtle(text, 'STRICT')``; and ``spark.read.format("turtle")``."""

    @F.udtf(returnType=TRIPLE_SCHEMA)
    class ParseTurtle:
        def eval(self, text: str, mode: str):
            yield from read(text, mode)[0]

    spark.udtf.register("parse_turtle", ParseTurtle)
    spark.dataSource.register(TurtleSource)


@dataclass
class _File(InputPartition):
    path: str


class TurtleSource(DataSource):
    """Turtle files of a local or mounted folder: graph_id (the file's name) and its triples; option ``mode``."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return f"graph_id string, {TRIPLE_SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return _TurtleReader(self.options)


class _TurtleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options["path"], options.get("mode", STRICT)

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.path.removeprefix("file://"))
        return [_File(str(p)) for p in (sorted(top.rglob("*.ttl")) if top.is_dir() else [top])]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pathlib import Path

        at = Path(partition.path)
        for row in read(at.read_text(encoding="utf-8"), self.mode)[0]:
            yield (at.stem, *row)
