import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from triloom.sources.grammar import Reader, is_record_start, parse_line, parse_rows, parse_text

I = "http://x.example/"  # noqa: E741
S, P, O = f"{I}s", f"{I}p", f"{I}o"


def reason(raw, fmt, n=None):
    o = parse_line(raw, fmt, n)
    return o.reason if o.kind == "error" else o.kind


@pytest.mark.parametrize(
    ("raw", "n", "want"),
    [
        (f"{S},{P},{O}", 3, "record"),
        (f"{S},{P},{O}\r", 3, "record"),
        (f'{S},{P},"a, ""b"""', 3, "record"),
        (f"_:b1,{P},plain text", 3, "record"),
        (f"{S},{P},_:b 1", 3, "record"),
        (f"{S},{P},t,0.5", 4, "record"),
        (f'{S},{P},t,"2.5e-1"\r', 4, "record"),
        (f"{S},{P},t,-0.0", 4, "record"),
        ("", 3, "none"),
        (" \t ", 3, "none"),
        ("# no comment in csv", 3, "column_count"),
        (f'{S},{P},"open', 3, "quoting"),
        (f'{S},{P},"a" b', 3, "quoting"),
        (f'{S},{P},a"b', 3, "quoting"),
        (f'{S},{P},"a""', 3, "quoting"),
        (f'"{S},{P},"x",y,z', 3, "quoting"),
        (f"{S},{P}", 3, "column_count"),
        (f"{S},{P},a,b", 3, "column_count"),
        (f"{S},{P},a", 4, "column_count"),
        (f"name,{P},a", 3, "value"),
        (f"{S},_:b,a", 3, "value"),
        (f"{S},{P},  ", 3, "value"),
        (f"{S},{P},http://bad iri", 3, "value"),
        (f"{S},{P},http://", 3, "value"),
        (f"{S},{P},bell\x07", 3, "value"),
        (f"{S},{P},lost �", 3, "value"),
        (f"{S},{P},t,-1", 4, "value"),
        (f'{S},{P},t,"1,5"', 4, "value"),
        (f"{S},{P},t,NaN", 4, "value"),
        (f"{S},{P},t,1e999", 4, "value"),
        (f"{S},{P},t,", 4, "value"),
    ],
)
def test_csv(raw, n, want):
    assert reason(raw, "csv", n) == want
    if '"' not in raw or want == "record":
        assert reason(raw.replace(",", "\t"), "tsv", n) in (want, "value", "quoting", "record")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (f"<{S}> <{P}> <{O}> .", "record"),
        (f" _:b1\t<{P}>  _:b2.", "record"),
        (f'<{S}> <{P}> "a \\" b"@en-GB . # note "', "record"),
        (f'<{S}> <{P}> ""', "column_count"),
        (f'<{S}> <{P}> "".', "record"),
        (f'<{S}> <{P}> "5"^^<{I}t#integer> .', "record"),
        (f'<{S}> <{P}> "5a"^^<{I}t#integer> .', "value"),
        (f'<{S}> <{P}> "anything"^^<{I}t#other> .', "record"),
        (f'<{S}> <{P}> "2030-02-29"^^<{I}t#date> .', "value"),
        (f'<{S}> <{P}> "2028-02-29"^^<{I}t#date> .', "record"),
        (f'<{S}> <{P}> "TRUE"^^<{I}t#boolean> .', "value"),
        (f'<{S}> <{P}> "x"@e .', "value"),
        (f'<{S}> <{P}> "x"@en_GB .', "value"),
        (f'<{S}> <{P}> "open .', "quoting"),
        (f'<{S}> <{P}> "open\\" .', "quoting"),
        (f'<{S}> <{P}> "a"b .', "quoting"),
        (f'<{S}> <{P}> "a"^^x .', "quoting"),
        (f"<{S}> <{P} <{O}> .", "quoting"),
        (f"<{S}> <{P}> <{O} .", "quoting"),
        (f"<{S}> <{P}> <{O}>", "column_count"),
        (f"<{S}> <{P}> .", "column_count"),
        (f"<{S}> <{P}> <{O}> <{O}> .", "column_count"),
        (f"<{S}> <{P}> <{O}> . more", "column_count"),
        (f'"s" <{P}> <{O}> .', "value"),
        (f"<{S}> _:b <{O}> .", "value"),
        (f"<{S}> <{P}> bare .", "value"),
        (f"<{S}> <{P}> <relative> .", "value"),
        (f"<{S}> <{P}> <{I}a b> .", "value"),
        ("# comment", "none"),
        ("   # comment", "none"),
        ("\t", "none"),
    ],
)
def test_nt(raw, want):
    assert reason(raw, "nt") == want


def test_nq_takes_three_or_four_terms():
    assert reason(f"<{S}> <{P}> <{O}> .", "nq") == "record"
    assert parse_line(f"<{S}> <{P}> <{O}> _:g .", "nq", None).triple.graph == "_:g"
    assert reason(f'<{S}> <{P}> <{O}> "g" .', "nq") == "value"
    assert reason(f"<{S}> <{P}> <{O}> <{O}> <{O}> .", "nq") == "column_count"


def test_null_and_unknown_format():
    assert reason(None, "csv", 3) == "none"
    assert reason("x", None, 3) == "format"
    assert reason("x", "json", 3) == "format"


def test_errors_are_located():
    o = parse_line(f'{S},{P},"a" b', "csv", 3)
    assert o.column == len(f'{S},{P},"a"') + 1
    assert "separator" in o.expected


def test_very_long_line():
    assert reason(f'{S},{P},"{"x" * 2_000_000}"', "csv", 3) == "record"
    assert reason(f"<{S}> <{P}> \"{'x' * 2_000_000} .", "nt") == "quoting"


def test_text_goes_on_at_a_validated_record_start():
    text = f'{S},{P},"two\nlines"\n{S},{P},"broken\nstill broken\n{S},{P},good\r\n\nbad,{P},x\n{S},{P},last'
    got = [(o.kind, o.line_no, o.reason, o.triple and o.triple.object) for o in parse_text(text, "csv", 3)]
    assert got == [("record", 1, None, "two\nlines"), ("error", 3, "quoting", None), ("record", 5, None, "good"), ("error", 7, "value", None), ("record", 8, None, "last")]


def test_a_broken_quote_swallows_no_record():
    text = 'urn:a,urn:b,"broken\nurn:c,urn:d,x\nurn:e,urn:f,"\nurn:g,urn:h,i'
    got = [(o.kind, o.line_no, o.n_lines, o.column, o.triple and o.triple.object) for o in parse_text(text, "csv")]
    assert got == [("error", 1, 1, 13, None), ("record", 2, 1, None, "x"), ("error", 3, 1, 13, None), ("record", 4, 1, None, "i")]


def test_prose_is_no_record_start():
    text = f'{S},{P},"see\nhttp://x.example/a, and more\nend",0.5\n{S},{P},"open\n{S},{P},"two\nlines"'
    got = [(o.kind, o.line_no, o.n_lines, o.triple and (o.triple.object, o.triple.weights)) for o in parse_text(text, "csv")]
    assert got == [("record", 1, 3, ("see\nhttp://x.example/a, and more\nend", 0.5)), ("error", 4, 1, None), ("record", 5, 2, ("two\nlines", None))]
    assert is_record_start(f'{S},{P},"open ""', "csv", None)
    assert not is_record_start(f'{S},{P},"closed" x', "csv", None)
    assert not is_record_start(f'{S},not an IRI,"open', "csv", None)
    assert not is_record_start('http://x.example/a, and "more', "csv", None)


def test_errors_of_several_lines_are_located():
    text = f'{S},{P},"two\nlines" x\nrest\n\n{S},{P},"three\nlines\n",abc\n{S},{P},z'
    got = [(o.kind, o.line_no, o.n_lines, o.err_line, o.column, o.reason) for o in parse_text(text, "csv")]
    assert got == [("error", 1, 4, 2, 7, "quoting"), ("error", 5, 3, 7, 3, "value"), ("record", 8, 1, None, None, None)]


def test_columns_without_a_number_asked_for():
    assert reason(f"{S},{P},a,0.5", "csv") == "record"
    assert reason(f"{S},{P},a,0.5,x,y", "csv") == "column_count"
    assert reason(f"{S},{P}", "csv") == "column_count"


def test_rows_of_a_table_are_each_a_start():
    got = parse_rows([f'{S},{P},"open', 'close"', None, f"{S},{P},x\n"], "csv", 3)
    assert [(o.kind, o.reason) for o in got] == [("error", "quoting"), ("error", "quoting"), ("none", None), ("record", None)]
    assert reason(f'{S},{P},"a\nb"', "csv", 3) == "quoting"
    assert reason(f"{S},{P},a\nb", "csv", 3) == "column_count"


def test_a_quote_open_for_too_long_is_broken():
    r = Reader("csv", 3, max_record=100)
    got = [o for i, line in enumerate([f'{S},{P},"open', *["x" * 30] * 5, f"{S},{P},good"]) for o in r.feed(line, i + 1)]
    assert [(o.kind, o.line_no) for o in got if o.kind != "none"][0] == ("error", 1)
    assert got[-1].kind == "record"


def test_text_of_lines():
    text = f"# c\n<{S}> <{P}> <{O}> .\r\n<{S}> <{P} <{O}> .\n<{S}> <{P}> <{O}> ."
    assert [(o.kind, o.line_no) for o in parse_text(text, "nt")] == [("record", 2), ("error", 3), ("record", 4)]


@given(st.text(alphabet=st.characters(exclude_characters="\r\n", exclude_categories=["Cs"]), max_size=60))
def test_nothing_crashes(raw):
    for fmt in ("csv", "tsv", "nt", "nq"):
        o = parse_line(raw, fmt, 3)
        assert o.kind in ("record", "error", "none")
        assert [x.kind for x in parse_text(raw, fmt, 3)] == ([] if o.kind == "none" else [o.kind])


@given(st.text(alphabet=st.characters(min_codepoint=33, exclude_categories=["Cc", "Cs", "Cn"], exclude_characters="�"), min_size=1).filter(lambda x: x.strip() and not x.startswith(("http", "urn"))), st.floats(0, 1e300, allow_nan=False))
def test_csv_round_trip(text, weight):
    quoted = '"' + text.replace('"', '""') + '"'
    t = parse_line(f"{S},{P},{quoted},{weight!r}", "csv", 4).triple
    assert t.object == text
    assert math.isclose(t.weights, weight)
