"""Error-recovering recursive-descent grammar for delimited and N-Triples/N-Quads lines.

`Reader` takes lines one after another and gives typed records and located
errors. A quoted csv or tsv field may hold line breaks. Lines that follow an
open quote are held until it closes or a validated record start comes: a line
that parses whole as a record, or whose fields up to an opening quote are those
of one. A quote that such a line interrupts is broken at its opening, and
reading resumes there, so a broken quote swallows no record. What is a record
start follows from the line alone, so a text may be read from any place on.

Every error has a reason, a place and what was expected. Reasons, in the order
in which they are tested:
  quoting       a quote or angle bracket that isn't closed, or closed wrongly
  column_count  not the number of fields or terms asked for, or no closing dot
  value         a term that the position or its datatype doesn't allow
"""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

SEPARATORS = {"csv": ",", "tsv": "\t"}

# Terminals. IRI schemes, datatypes and literal forms are fixed values of the formats.
_IRI = re.compile(r"(?:https?://|urn:)[^\s\x00-\x20\x7f-\x9f�<>\"{}|\\^`]+")
_IRI_START = re.compile(r"https?://|urn:")
_BLANK_NODE = re.compile(r"_:[A-Za-z0-9]+")
_BAD_IN_LITERAL = re.compile(r"[\x00-\x1f\x7f-\x9f�]")
_BREAKS = re.compile(r"\r?\n")  # may stand in a quoted field that spans lines
_TAG = re.compile(r"[A-Za-z]{2,3}(?:-[A-Za-z0-9]+)*")
_WEIGHT = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", re.A)
_DATATYPES = {
    "integer": re.compile(r"[+-]?\d+", re.A),
    "decimal": re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", re.A),
    "double": re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN", re.A),
    "boolean": re.compile(r"true|false|1|0"),
    "date": re.compile(r"\d{4}-\d{2}-\d{2}", re.A),
}
_QUOTED = re.compile(r'"((?:[^"]|"")*+)"')
_QUOTED_IN_LINE = re.compile(r'"((?:[^"\n]|"")*+)"')
_NT_STRING = re.compile(r'"((?:[^"\\\n]|\\[^\n])*+)"')
_NT_BRACKET = re.compile(r"<([^<>\n]*+)>")
_NT_SPACE = re.compile(r"[ \t]*+")
_NT_WORD = re.compile(r'[^ \t"<\n]++')
_NT_TAG = re.compile(r'@[^ \t"<.\n]*+')
_NT_TRAIL = re.compile(r"[ \t]*+(?:#[^\n]*+)?")
_NT_COMMENT = re.compile(r"\s*#")
_OPEN = re.compile(r'"(?:[^"]|"")*+')
MAX_RECORD = 64 << 20  # characters: a quote still open after so many is broken


class Broken(Exception):
    """A syntax error at a place of the buffer."""

    def __init__(self, reason: str, at: int, expected: str) -> None:
        super().__init__(reason, at, expected)
        self.reason, self.at, self.expected = reason, at, expected
        self.fields: list[str] = []
        self.places: list[int] = []


class Triple(NamedTuple):
    subject: str
    predicate: str
    object: str
    weights: float | None
    graph: str | None


class Outcome(NamedTuple):
    """What a record gave: kind is record, error or none. It begins at line_no and has n_lines; an error lies in err_line at column."""

    kind: str
    line_no: int
    column: int | None
    reason: str | None
    expected: str | None
    triple: Triple | None
    n_lines: int = 1
    err_line: int | None = None


# --- delimited records -------------------------------------------------------


def _field(s: str, pos: int, end: int, sep: str, multiline: bool) -> tuple[str, int]:
    if pos < end and s[pos] == '"':
        m = (_QUOTED if multiline else _QUOTED_IN_LINE).match(s, pos, end)
        if m is None:
            raise Broken("quoting", pos, "a closing quote")
        if m.end() < end and s[m.end()] not in (sep, "\n") and not (s[m.end()] == "\r" and s[m.end() + 1 : m.end() + 2] in ("\n", "")):
            raise Broken("quoting", m.end(), "a separator after the closing quote")
        return m[1].replace('""', '"'), m.end()
    stop, line = s.find(sep, pos, end), s.find("\n", pos, end)
    stop = min(x for x in (stop, line, end) if x >= 0)
    quote = s.find('"', pos, stop)
    if quote >= 0:
        raise Broken("quoting", quote, "no quote inside a bare field")
    return s[pos:stop], stop


def _fields(s: str, pos: int, end: int, sep: str, multiline: bool) -> tuple[list[str], list[int]]:
    """The fields up to `end`, and where they begin. A broken one carries those before it."""
    fields: list[str] = []
    at: list[int] = []
    while True:
        at.append(pos)
        try:
            text, pos = _field(s, pos, end, sep, multiline)
        except Broken as e:
            e.fields, e.places = fields, at
            raise
        fields.append(text)
        if pos < end and s[pos] == sep:
            pos += 1
        else:
            break
    if pos != end:
        raise Broken("column_count", pos, "the line's end")
    return fields, at


def _subject_and_predicate(fields: list[str], at: list[int]) -> None:
    if not (_IRI.fullmatch(fields[0]) or _BLANK_NODE.fullmatch(fields[0])):
        raise Broken("value", at[0], "an IRI or a blank node as subject")
    if not _IRI.fullmatch(fields[1]):
        raise Broken("value", at[1], "an IRI as predicate")


def _typed(fields: list[str], at: list[int], n_cols: int | None, multiline: bool) -> Triple:
    if n_cols is not None and len(fields) != n_cols:
        raise Broken("column_count", at[min(len(at), max(1, n_cols)) - 1], f"{n_cols} fields instead of {len(fields)}")
    if not 3 <= len(fields) <= 4:
        raise Broken("column_count", at[min(len(at), 4) - 1], f"subject, predicate, object and perhaps weights instead of {len(fields)} fields")
    _subject_and_predicate(fields, at)
    obj = fields[2]
    if not (_IRI.fullmatch(obj) or (obj.strip() and not _IRI_START.match(obj) and not _BAD_IN_LITERAL.search(_BREAKS.sub("", obj) if multiline else obj))):
        raise Broken("value", at[2], "an IRI, a blank node or a literal as object")
    return Triple(fields[0], fields[1], obj, _weight(fields[3], at[3]) if len(fields) > 3 else None, None)


def _weight(text: str, at: int) -> float:
    if not _WEIGHT.fullmatch(text) or not math.isfinite(value := float(text)) or value < 0:
        raise Broken("value", at, "a finite weight of at least 0")
    return value


# --- terms with brackets and quotes ------------------------------------------


def _bracket(s: str, pos: int, end: int) -> tuple[str, int]:
    m = _NT_BRACKET.match(s, pos, end)
    if m is None:
        raise Broken("quoting", pos, "a closing > before another <")
    return m[1], m.end()


def _string(s: str, pos: int, end: int) -> tuple[tuple, int]:
    m = _NT_STRING.match(s, pos, end)
    if m is None:
        raise Broken("quoting", pos, "a closing quote")
    begin, pos, tag, datatype = pos, m.end(), None, None
    if pos < end:
        c = s[pos]
        if c == "@":
            t = _NT_TAG.match(s, pos, end)
            tag, pos = t[0][1:], t.end()
        elif s.startswith("^^<", pos, end):
            datatype, pos = _bracket(s, pos + 2, end)
        elif c not in " \t.":
            raise Broken("quoting", pos, "a blank, the dot, a tag or a datatype after the closing quote")
    return ("literal", m[1], tag, datatype, s[begin:pos]), pos


def _term(s: str, pos: int, end: int) -> tuple[tuple, int]:
    c = s[pos]
    if c == "<":
        text, pos = _bracket(s, pos, end)
        return ("iri", text), pos
    if c == '"':
        return _string(s, pos, end)
    m = _NT_WORD.match(s, pos, end)
    text, stop = m[0], m.end()
    while stop < end and s[stop] in '"<':  # stuck to a quote or bracket: it still has to be closed
        part, stop = _term(s, stop, end)
        text += s[m.end() : stop]
    if text.endswith(".") and len(text) > 1 and stop == m.end():  # the closing dot may touch the term
        text, stop = text[:-1], stop - 1
    return ("word", text), stop


def _terms(s: str, pos: int, end: int, most: int, least: int) -> tuple[Triple, int]:
    found, at, dot = [], [], False
    pos = _NT_SPACE.match(s, pos, end).end()
    begin, count = pos, None
    while pos < end:
        c = s[pos]
        if c == "." and (pos + 1 == end or s[pos + 1] in " \t#"):
            dot = True
            trail = _NT_TRAIL.match(s, pos + 1, end)
            if trail.end() == end:
                pos = end
                break
            count, dot = count or Broken("column_count", trail.end(), "nothing after the closing dot"), False
            pos = trail.end() if trail.end() > pos + 1 else pos + 1
            continue
        at.append(pos)
        term, pos = _term(s, pos, end)
        found.append(term)
        pos = _NT_SPACE.match(s, pos, end).end()
    if count is None and not dot:
        count = Broken("column_count", end, "the closing dot")
    if count is None and not least <= len(found) <= most:
        count = Broken("column_count", at[-1] if at else begin, f"{least} to {most} terms instead of {len(found)}")
    if count is not None:
        raise count
    subject = _resource(found[0], at[0], "an IRI or a blank node as subject")
    if found[1][0] != "iri" or not _IRI.fullmatch(found[1][1]):
        raise Broken("value", at[1], "an IRI as predicate")
    obj = _literal(found[2], at[2]) if found[2][0] == "literal" else _resource(found[2], at[2], "an IRI, a blank node or a literal as object")
    graph = _resource(found[3], at[3], "an IRI or a blank node as graph") if len(found) > 3 else None
    return Triple(subject, found[1][1], obj, None, graph), pos


def _resource(term: tuple, at: int, expected: str) -> str:
    if (_IRI if term[0] == "iri" else _BLANK_NODE).fullmatch(term[1]) and term[0] != "literal":
        return term[1]
    raise Broken("value", at, expected)


def _literal(term: tuple, at: int) -> str:
    _, text, tag, datatype, whole = term
    if _BAD_IN_LITERAL.search(text):
        raise Broken("value", at, "a literal without control characters")
    if tag is not None and not _TAG.fullmatch(tag):
        raise Broken("value", at, "a language tag")
    if datatype is not None:
        if not _IRI.fullmatch(datatype):
            raise Broken("value", at, "an IRI as datatype")
        name = datatype.rpartition("#")[2]
        form = _DATATYPES.get(name)
        if form is not None and not form.fullmatch(text):
            raise Broken("value", at, f"a text that is a {name}")
        if name == "date":
            try:
                datetime.date.fromisoformat(text)
            except ValueError:
                raise Broken("value", at, "a real day") from None
    return whole


# --- records, lines and texts ------------------------------------------------


def is_no_record(text: str, fmt: str) -> bool:
    """Blank lines, and in nt and nq comment lines."""
    return not text.strip() or (fmt in ("nt", "nq") and _NT_COMMENT.match(text) is not None)


def _record(s: str, fmt: str, n_cols: int | None, multiline: bool = False) -> Triple:
    """The record that the text is."""
    if fmt in SEPARATORS:
        return _typed(*_fields(s, 0, len(s), SEPARATORS[fmt], multiline), n_cols, multiline)
    triple, stop = _terms(s, 0, len(s), 4 if fmt == "nq" else 3, 3)
    if stop != len(s):
        raise Broken("column_count", stop, "the line's end")
    return triple


def _opened(e: Broken, s: str) -> bool:
    """Whether what broke is a field whose quote is open up to the line's end."""
    return e.reason == "quoting" and bool(e.places) and e.at == e.places[-1] and s.startswith('"', e.at) and _OPEN.match(s, e.at).end() == len(s)


def is_record_start(line: str, fmt: str, n_cols: int | None) -> bool:
    """Whether the line is a record, or begins one: subject, predicate and an object whose quote stays open."""
    try:
        _record(line, fmt, n_cols)
        return True
    except Broken as e:
        if not (_opened(e, line) and len(e.fields) == 2):
            return False
        try:
            _subject_and_predicate(e.fields, e.places)
        except Broken:
            return False
        return True


class Reader:
    """Reads lines of one format in order; see the module. Without `multiline` a record ends with its line."""

    def __init__(self, fmt: str, n_cols: int | None = None, multiline: bool = True, max_record: int = MAX_RECORD) -> None:
        if fmt not in ("csv", "tsv", "nt", "nq"):
            raise ValueError(f"unknown format {fmt!r}: csv, tsv, nt or nq")
        self.fmt, self.n_cols, self.max_record = fmt, n_cols, max_record
        self.multiline = multiline and fmt in SEPARATORS
        self.held: list[str] = []  # lines since an open quote
        self.size = 0
        self.first = 0
        self.error: Outcome | None = None  # what is wrong with the held lines, once they can't become a record

    def feed(self, line: str, line_no: int, start: bool = False) -> Iterator[Outcome]:
        """What the line completes. `start`: the line is known to begin a record (a row of a table does)."""
        line = line.removesuffix("\r")
        if self.held:
            if not start and not is_record_start(line, self.fmt, self.n_cols):
                yield from self._hold(line)
                return
            yield from self.finish()
        if is_no_record(line, self.fmt):
            yield Outcome("none", line_no, None, None, None, None)
            return
        try:
            yield Outcome("record", line_no, None, None, None, _record(line, self.fmt, self.n_cols))
        except Broken as e:
            error = Outcome("error", line_no, e.at + 1, e.reason, e.expected, None, 1, line_no)
            if self.multiline and e.reason == "quoting":
                self.held, self.size, self.first, self.error = [line], len(line), line_no, None if _opened(e, line) else error
            else:
                yield error

    def _hold(self, line: str) -> Iterator[Outcome]:
        """One more line after a quote: it may close it, or belongs to the error."""
        self.held.append(line)
        self.size += len(line) + 1
        if self.error is not None or line.count('"') % 2 == 0:
            if self.size > self.max_record:
                yield from self.finish()
            return
        text = "\n".join(self.held)
        try:
            triple = _record(text, self.fmt, self.n_cols, True)
            outcome = Outcome("record", self.first, None, None, None, triple, len(self.held))
        except Broken as e:
            outcome = self._located(e, text)
            if e.reason == "quoting":
                self.error = outcome
                return
        self.held = []
        yield outcome

    def _located(self, e: Broken, text: str) -> Outcome:
        return Outcome("error", self.first, e.at - text.rfind("\n", 0, e.at), e.reason, e.expected, None, len(self.held), self.first + text.count("\n", 0, e.at))

    def finish(self) -> Iterator[Outcome]:
        """The error of the held lines, at a record start or the text's end."""
        if not self.held:
            return
        error = self.error
        if error is None:
            try:
                _fields(self.held[0], 0, len(self.held[0]), SEPARATORS[self.fmt], False)
            except Broken as e:
                error = Outcome("error", self.first, e.at + 1, e.reason, e.expected, None, 1, self.first)
        n, self.held, self.error = len(self.held), [], None
        yield error._replace(n_lines=n)


def parse_rows(rows: Sequence[str | None], fmt: str | None, n_cols: int | None) -> list[Outcome]:
    """One outcome for each row of a table of lines. Each row begins a record, so a broken quote ends with its row.

    A null row is no record; an unknown or null format gives the reason
    `format`. A line break inside a row, other than its end, is no line's end.
    """
    if fmt not in ("csv", "tsv", "nt", "nq"):
        return [Outcome("none", 1, None, None, None, None) if r is None else Outcome("error", 1, 1, "format", "csv, tsv, nt or nq", None, 1, 1) for r in rows]
    reader, out = Reader(fmt, n_cols), []
    for i, r in enumerate(rows):
        out.extend(reader.feed((r or "").removesuffix("\n"), i, True))
    out.extend(reader.finish())
    return [o._replace(line_no=1, err_line=o.err_line and 1) for o in out]


def parse_line(raw: str | None, fmt: str | None, n_cols: int | None) -> Outcome:
    """One line that must be one record."""
    return parse_rows([raw], fmt, n_cols)[0]


def parse_text(s: str, fmt: str, n_cols: int | None = None, multiline: bool = True, first_line: int = 1) -> Iterator[Outcome]:
    """All records and errors of a text."""
    reader = Reader(fmt, n_cols, multiline)
    for i, line in enumerate(s.split("\n")):
        yield from (o for o in reader.feed(line, first_line + i) if o.kind != "none")
    yield from reader.finish()
