"""Turtle and TriG: prefixes, base, `a`, lists, blank-node property lists, collections, named graphs, literals, numbers and booleans.

N3 is read as far as it is Turtle. Graph names are left out, as elsewhere.
Other syntaxes are in `markup`. With the package rdflib installed it reads all
of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TYPE = RDF + "type"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r'(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
    r"|(?P<tag>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<kind>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[A-Za-z0-9_-]+)"
    r"|(?P<name>[A-Za-z][\w-]*)?:(?P<local>[\w%-]*(?:\.[\w%-]+)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\](){}])",
    re.S,
)


def triples_of(text: str, syntax: str = "turtle") -> Iterator[tuple[str, str, str]]:
    """Triples with IRIs bare and literals in quotes with their tag or datatype."""
    try:
        import rdflib
    except ImportError:
        rdflib = None
    if rdflib is not None:
        g = rdflib.Dataset(default_union=True) if syntax in ("trig", "trix", "json-ld") else rdflib.Graph()
        g.parse(data=text, format=syntax)
        for s, p, o, *_ in g:
            yield str(s), str(p), o.n3() if isinstance(o, rdflib.Literal) else str(o)
        return
    if syntax in ("turtle", "n3", "trig"):
        yield from _Turtle(text).statements()
    elif syntax in ("xml", "json-ld"):
        from triloom.sources import markup

        yield from markup.xml_triples(text) if syntax == "xml" else markup.json_triples(text)
    else:
        raise ImportError(f"reading {syntax} needs the package rdflib")


class BlankNodes:
    """Fresh blank nodes of one text; their names differ from text to text."""

    def __init__(self, text: str) -> None:
        self.stem, self.n = f"_:g{zlib.crc32(text.encode('utf-8', 'replace')):08x}n", 0

    def fresh(self) -> str:
        self.n += 1
        return f"{self.stem}{self.n}"


class _Turtle:
    """Recursive descent over the tokens of one text; `out` holds the triples that a statement has given so far."""

    def __init__(self, text: str) -> None:
        self.tokens, self.i = [*_tokens(text), ("end", "", len(text))], 0
        self.prefixes: dict[str, str] = {}
        self.base, self.nodes, self.out = "", BlankNodes(text), []

    def peek(self) -> str:
        return self.tokens[self.i][1] if self.tokens[self.i][0] in ("mark", "word") else ""

    def take(self, mark: str) -> bool:
        found = self.peek() == mark
        self.i += found
        return found

    def need(self, mark: str) -> None:
        if not self.take(mark):
            _, value, at = self.tokens[self.i]
            raise ValueError(f"{mark!r} expected instead of {value!r} at character {at}")

    def statements(self) -> Iterator[tuple[str, str, str]]:
        depth = 0
        while self.tokens[self.i][0] != "end":
            kind, value, _ = self.tokens[self.i]
            word = value.lower()
            if kind in ("tag", "word") and word in ("@prefix", "prefix", "@base", "base"):
                self._directive(word)
            elif kind == "word" and word == "graph":
                self.i += 1
                self.term()
                self.need("{")
                depth += 1
            elif self.take("{"):
                depth += 1
            elif self.take("}"):
                depth -= 1
                self.take(".")
            else:
                self._triples(depth)
            yield from self.out
            self.out = []

    def _directive(self, word: str) -> None:
        _, value, at = self.tokens[self.i + 1]
        if word.endswith("base"):
            self.base, self.i = value[1:-1], self.i + 2
        else:
            if not value.endswith(":"):
                raise ValueError(f"{value!r} at character {at} isn't a prefix")
            self.i += 2
            self.prefixes[value[:-1]] = self.term()
        self.take(".")

    def _triples(self, depth: int) -> None:
        alone = self.peek() == "["
        s = self.term()
        if depth == 0 and self.take("{"):  # a named graph
            self.i -= 1
            return
        if not (alone and self.peek() in (".", "}")):
            self._predicates(s)
        if not (depth and self.peek() == "}"):
            self.need(".")

    def _predicates(self, s: str) -> None:
        while True:
            p = _TYPE if self.take("a") else self.term()
            while True:
                self.out.append((s, p, self.term()))
                if not self.take(","):
                    break
            while self.take(";"):
                pass
            if self.peek() in (".", "]", "}") or self.tokens[self.i][0] == "end":
                return

    def term(self) -> str:
        kind, value, at = self.tokens[self.i]
        self.i += 1
        if kind == "iri":
            inner = value[1:-1]
            return inner if re.match(r"[A-Za-z][\w+.-]*:", inner) else self.base + inner
        if kind == "local":
            name, _, local = value.partition(":")
            if name not in self.prefixes:
                raise ValueError(f"unknown prefix {name!r} at character {at}")
            return self.prefixes[name] + local
        if kind == "blank":
            return value
        if kind == "number":
            shape = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return f'"{value}"^^<{_XSD}{shape}>'
        if kind == "word" and value in ("true", "false"):
            return f'"{value}"^^<{_XSD}boolean>'
        if kind == "text":
            body = value[3:-3] if value.startswith('"""') else value[1:-1]
            quoted = '"' + body.replace("\r", "\\r").replace("\n", "\\n") + '"'
            following = self.tokens[self.i][0]
            if following == "tag":
                self.i += 1
                return quoted + self.tokens[self.i - 1][1]
            if following == "kind":
                self.i += 1
                return f"{quoted}^^<{self.term()}>"
            return quoted
        if kind == "mark" and value == "[":
            node = self.nodes.fresh()
            if not self.take("]"):
                self._predicates(node)
                self.need("]")
            return node
        if kind == "mark" and value == "(":
            items = []
            while not self.take(")"):
                items.append(self.term())
            return chain(items, self.nodes, self.out)
        raise ValueError(f"{value!r} at character {at} isn't a term")


def chain(items: list[str], nodes: BlankNodes, out: list[tuple[str, str, str]]) -> str:
    """The first node of a collection, whose triples are added to `out`."""
    places = [nodes.fresh() for _ in items] + [RDF + "nil"]
    for i, x in enumerate(items):
        out += [(places[i], RDF + "first", x), (places[i], RDF + "rest", places[i + 1])]
    return places[0]


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    pos = 0
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if m is None:
            raise ValueError(f"can't read {text[pos : pos + 20]!r} at character {pos}")
        pos = m.end()
        if m.lastgroup != "space":
            yield ("local" if m["local"] is not None else m.lastgroup), m[0], m.start()
