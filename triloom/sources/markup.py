"""RDF/XML, and JSON-LD whose context is in the document."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from urllib.parse import urljoin
from xml.etree import ElementTree

from triloom.sources.turtle import RDF, BlankNodes, chain

_XML = "{http://www.w3.org/XML/1998/namespace}"
_IN = "{" + RDF + "}"
_XSD = "http://www.w3.org/2001/XMLSchema#"
_SYNTAX = {_IN + n for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "RDF")}


def literal(text: str, language: str | None = None, datatype: str | None = None) -> str:
    body = text.replace("\\", "\\\\").replace('"', '\\"').replace("\r", "\\r").replace("\n", "\\n")
    return f'"{body}"' + (f"@{language}" if language else f"^^<{datatype}>" if datatype else "")


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Xml:
    def __init__(self, text: str) -> None:
        self.nodes, self.out = BlankNodes(text), []

    def node(self, e: ElementTree.Element, base: str, language: str | None) -> str:
        base, language = e.get(_XML + "base", base), e.get(_XML + "lang", language)
        if _IN + "about" in e.attrib:
            s = urljoin(base, e.attrib[_IN + "about"])
        elif _IN + "ID" in e.attrib:
            s = f"{base}#{e.attrib[_IN + 'ID']}"
        else:
            s = "_:" + e.attrib[_IN + "nodeID"] if _IN + "nodeID" in e.attrib else self.nodes.fresh()
        if e.tag != _IN + "Description":
            self.out.append((s, RDF + "type", _name(e.tag)))
        self._attributes(s, e, base, language)
        self._properties(s, e, base, language)
        return s

    def _attributes(self, s: str, e: ElementTree.Element, base: str, language: str | None) -> bool:
        own = {k: v for k, v in e.attrib.items() if k not in _SYNTAX and not k.startswith(_XML)}
        for k, v in own.items():
            self.out.append((s, _name(k), urljoin(base, v) if k == _IN + "type" else literal(v, language)))
        return bool(own)

    def _properties(self, s: str, e: ElementTree.Element, base: str, language: str | None) -> None:
        item = 0
        for x in e:
            item += x.tag == _IN + "li"
            p = f"{RDF}_{item}" if x.tag == _IN + "li" else _name(x.tag)
            self.out.append((s, p, self._object(x, x.get(_XML + "base", base), x.get(_XML + "lang", language))))

    def _object(self, x: ElementTree.Element, base: str, language: str | None) -> str:
        how = x.get(_IN + "parseType")
        if how == "Literal":
            inner = (x.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in x)
            return literal(inner, None, RDF + "XMLLiteral")
        if how == "Resource":
            node = self.nodes.fresh()
            self._properties(node, x, base, language)
            return node
        if how == "Collection":
            return chain([self.node(c, base, language) for c in x], self.nodes, self.out)
        if _IN + "resource" in x.attrib or _IN + "nodeID" in x.attrib:
            node = urljoin(base, x.attrib[_IN + "resource"]) if _IN + "resource" in x.attrib else "_:" + x.attrib[_IN + "nodeID"]
            self._attributes(node, x, base, language)
            return node
        if len(x):
            return self.node(x[0], base, language)
        if any(k not in _SYNTAX and not k.startswith(_XML) for k in x.attrib):
            node = self.nodes.fresh()
            self._attributes(node, x, base, language)
            return node
        datatype = x.get(_IN + "datatype")
        return literal(x.text or "", None if datatype else language, datatype)


def xml_triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of an RDF/XML document. One that isn't well-formed is an error."""
    root, reader = ElementTree.fromstring(text.encode()), _Xml(text)
    base = root.get(_XML + "base", "")
    for e in root if root.tag == _IN + "RDF" else [root]:
        reader.node(e, base, root.get(_XML + "lang"))
        yield from reader.out
        reader.out = []


class _Json:
    def __init__(self, text: str) -> None:
        self.nodes, self.out = BlankNodes(text), []

    def context(self, given: Any, above: dict) -> dict:
        if given is None:
            return {"terms": {}}
        if isinstance(given, list):
            for g in given:
                above = self.context(g, above)
            return above
        if isinstance(given, str):
            raise ValueError(f"the context {given} isn't in the document")
        c = {**above, "terms": dict(above["terms"])}
        for k, v in given.items():
            if k.startswith("@"):
                c[k] = v
            else:
                c["terms"][k] = {"@id": v} if isinstance(v, str) or v is None else v
        return c

    def iri(self, name: str, c: dict, vocabulary: bool) -> str:
        own = c["terms"].get(name) if vocabulary else None
        if own is not None and own.get("@id") not in (None, name):
            return self.iri(own["@id"], c, True)
        head, colon, rest = name.partition(":")
        if colon and head in c["terms"] and not rest.startswith("//"):
            return self.iri(c["terms"][head]["@id"], c, True) + rest
        if colon or name.startswith("@"):
            return name
        return c.get("@vocab", "") + name if vocabulary else urljoin(c.get("@base", ""), name)

    def node(self, x: dict, c: dict) -> str:
        c = self.context(x["@context"], c) if "@context" in x else c
        keys = {k: self.iri(k, c, True) for k in x if k != "@context"}
        by = {v: x[k] for k, v in keys.items() if v.startswith("@")}
        s = self.iri(by["@id"], c, False) if "@id" in by else self.nodes.fresh()
        for t in _each(by.get("@type")):
            self.out.append((s, RDF + "type", self.iri(t, c, True)))
        for n in _each(by.get("@graph")):
            self.node(n, c)
        for k, p in keys.items():
            if not p.startswith("@") and ":" in p:  # a key that stands for no IRI says nothing
                rule = c["terms"].get(k, {})
                values = x[k]
                if rule.get("@container") == "@list":
                    values = {"@list": values}
                for v in _each(values):
                    if v is not None:
                        self.out.append((s, p, self.value(v, rule, c)))
        return s

    def value(self, v: Any, rule: dict, c: dict) -> str:
        if isinstance(v, dict):
            if "@value" in v:
                t = v.get("@type")
                return _scalar(v["@value"], v.get("@language"), t and self.iri(t, c, True))
            if "@list" in v:
                return chain([self.value(i, rule, c) for i in _each(v["@list"])], self.nodes, self.out)
            return self.node(v, c)
        kind = rule.get("@type")
        if isinstance(v, str) and kind in ("@id", "@vocab"):
            return self.iri(v, c, kind == "@vocab")
        datatype = None if kind in (None, "@none") else self.iri(kind, c, True)
        return _scalar(v, None if datatype else rule.get("@language", c.get("@language")), datatype)


def _each(v: Any) -> list:
    if isinstance(v, dict) and "@set" in v:
        v = v["@set"]
    return v if isinstance(v, list) else [] if v is None else [v]


def _scalar(v: Any, language: str | None, datatype: str | None) -> str:
    if isinstance(v, bool):
        return literal("true" if v else "false", None, datatype or _XSD + "boolean")
    if isinstance(v, (int, float)):
        return literal(str(v), None, datatype or _XSD + ("integer" if isinstance(v, int) else "double"))
    return literal(v, language, datatype)


def json_triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of a JSON-LD document. A context that is only named by its address is an error, `@reverse` and indexes are left out."""
    reader = _Json(text)
    for x in _each(json.loads(text)):
        reader.node(x, {"terms": {}})
        yield from reader.out
        reader.out = []
