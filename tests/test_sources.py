import pytest
from conftest import rows

from triloom.sources import sinks
from triloom.sources.readers import merge_splits, read_triples
from triloom.sources.turtle import triples_of

EDGES = [("s1", "p1", "o1"), ("s2", "p2", "o2")]
SCHEMA = "subject string, predicate string, object string"


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / f"kg.{fmt}")
    sinks.write_triples(spark.createDataFrame(EDGES, SCHEMA), path, fmt)
    assert rows(read_triples(spark, path)) == EDGES


def test_suffixes_and_maps(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        read_triples(spark, str(tmp_path / "kg.unknown"))
    p = tmp_path / "kg.csv"
    p.write_text("a;b;c;distance\nx;y;z;2.5\n")
    names = {"a": "subject", "b": "predicate", "c": "object", "distance": "weights"}
    assert rows(read_triples(spark, str(p), names, {"sep": ";"}, weighted=True)) == [("x", "y", "z", 2.5)]
    with pytest.raises(ValueError, match="weights"):
        read_triples(spark, str(p), {"a": "subject", "b": "predicate", "c": "object"}, {"sep": ";"}, weighted=True)
    with pytest.raises(ValueError, match="object"):
        read_triples(spark, str(p), {"a": "subject", "b": "predicate"}, {"sep": ";"})
    t = tmp_path / "kg.tsv"
    t.write_text("subject\tpredicate\tobject\nx\ty\tz\n")
    assert rows(read_triples(spark, str(t))) == [("x", "y", "z")]


def test_nt(spark, tmp_path):
    p = tmp_path / "kg.nt"
    p.write_text('<http://a> <http://b> "Hello World" .\n<http://c> <http://d> <http://e> .\n# note\n_:b <http://d> "5"^^<http://t#int> .\nbroken\n')
    both = [("http://a", "http://b", '"Hello World"'), ("http://c", "http://d", "http://e")]
    assert rows(read_triples(spark, str(p))) == [("_:b", "http://d", '"5"^^<http://t#int>'), *both]
    assert rows(read_triples(spark, str(p), mode="compat")) == both
    q = tmp_path / "kg.nq"
    q.write_text("<http://a> <http://b> <http://e> <http://g> .\n")
    assert rows(read_triples(spark, str(q))) == [("http://a", "http://b", "http://e")]
    assert rows(read_triples(spark, str(q), mode="compat")) == [("http://a", "http://b", "http://e> <http://g")]


def test_turtle(spark, tmp_path):
    p = tmp_path / "kg.ttl"
    p.write_text('@prefix x: <http://x/> .\nx:a a x:T ; x:p x:b , "l\'il"@en ; x:n 5, 2.5, true .\n_:c <http://q> """two\nlines""" .\n')
    got = rows(read_triples(spark, str(p)))
    assert ("http://x/a", "http://x/p", '"l\'il"@en') in got
    assert ("_:c", "http://q", '"two\\nlines"') in got
    assert ("http://x/a", "http://x/n", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>') in got
    assert len(got) == 7
    with pytest.raises(ValueError, match="prefix"):
        list(triples_of("y:a y:b y:c ."))
    with pytest.raises(ValueError, match="can't read"):
        list(triples_of("<http://a> <http://b> ~ ."))


def test_writing_lines_and_reading_them_again(spark, tmp_path):
    data = [("http://a", "http://b", "http://e"), ("_:n", "http://b", '"x"@en'), ("http://a", "http://b", 'say "hi"\\ now'), (None, "http://b", "x")]
    path = str(tmp_path / "out.nt")
    sinks.write_triples(spark.createDataFrame(data, SCHEMA), path, "nt")
    got = rows(read_triples(spark, path))
    assert got == [("_:n", "http://b", '"x"@en'), ("http://a", "http://b", '"say \\"hi\\"\\\\ now"'), ("http://a", "http://b", "http://e")]
    with pytest.raises(ValueError, match="format"):
        sinks.write_triples(spark.createDataFrame(data, SCHEMA), path, "xls")


def test_merge_and_summary(spark, tmp_path):
    for n in ("train", "valid", "test"):
        (tmp_path / f"{n}.txt").write_text(f"s{n}\tp\to\n")
    got = merge_splits(spark, [str(tmp_path / f"{n}.txt") for n in ("train", "valid", "test")])
    assert rows(got, "subject") == [("stest",), ("strain",), ("svalid",)]
    s = sinks.write_summary(spark.createDataFrame([("a", 1.0), ("a", 3.0)], "package string, runtime double"), str(tmp_path / "sum"), ["package"], "runtime")
    assert rows(s, "least", "most", "mean", "runs") == [(1.0, 3.0, 2.0, 2)]


R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def shape(triples):
    """Triples with blank nodes numbered in order of appearance."""
    seen: dict = {}
    name = lambda x: seen.setdefault(x, f"_:{len(seen)}") if x.startswith("_:") else x
    return [tuple(map(name, t)) for t in triples]


def test_turtle_nodes_collections_and_graphs():
    got = shape(triples_of('@prefix e: <http://e/> . e:s e:p [ e:q "x"@en ; e:r () ] , ( 1 e:a ) . [ e:q e:o ] . [] e:p e:z .'))
    xsd = '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'
    assert got == [
        ("_:0", "http://e/q", '"x"@en'), ("_:0", "http://e/r", R + "nil"), ("http://e/s", "http://e/p", "_:0"),
        ("_:1", R + "first", xsd), ("_:1", R + "rest", "_:2"), ("_:2", R + "first", "http://e/a"), ("_:2", R + "rest", R + "nil"), ("http://e/s", "http://e/p", "_:1"),
        ("_:3", "http://e/q", "http://e/o"), ("_:4", "http://e/p", "http://e/z"),
    ]
    trig = "PREFIX e: <http://e/> e:g { e:a e:p e:b . e:c e:p e:d } GRAPH e:h { e:x a e:y . } { e:k e:p e:l . } e:m e:p e:n ."
    assert [t[::2] for t in triples_of(trig, "trig")] == [("http://e/" + a, "http://e/" + b) for a, b in ("ab", "cd", "xy", "kl", "mn")]
    with pytest.raises(ValueError, match="expected"):
        list(triples_of("<http://e/a> <http://e/p> <http://e/b>"))


def test_rdf_xml(spark, tmp_path):
    doc = f"""<?xml version="1.0"?><r:RDF xmlns:r="{R}" xmlns:e="http://e/" xml:base="http://e/doc">
      <e:Person r:about="http://e/a" e:name="Ann"><e:knows r:resource="#b"/><e:age r:datatype="http://t/int">7</e:age><e:says xml:lang="fr">"oui"</e:says></e:Person>
      <r:Description r:ID="b"><e:in><e:Town/></e:in><e:at r:parseType="Resource"><e:x>1</e:x></e:at><e:list r:parseType="Collection"><r:Description r:about="http://e/i"/></e:list></r:Description></r:RDF>"""
    (tmp_path / "a.rdf").write_text(doc)
    got = [tuple(r) for r in read_triples(spark, str(tmp_path / "a.rdf")).collect()]
    assert got[:5] == [("http://e/a", R + "type", "http://e/Person"), ("http://e/a", "http://e/name", '"Ann"'), ("http://e/a", "http://e/knows", "http://e/doc#b"), ("http://e/a", "http://e/age", '"7"^^<http://t/int>'), ("http://e/a", "http://e/says", '"\\"oui\\""@fr')]
    b = shape(got[5:])
    assert b[:2] == [("_:0", R + "type", "http://e/Town"), ("http://e/doc#b", "http://e/in", "_:0")]
    assert ("_:1", "http://e/x", '"1"') in b
    assert [x[2] for x in b if x[1] == R + "first"] == ["http://e/i"]


def test_json_ld():
    doc = """{"@context": {"e": "http://e/", "name": "e:name", "knows": {"@id": "e:knows", "@type": "@id"}, "@base": "http://b/", "items": {"@id": "e:items", "@container": "@list"}},
      "@graph": [{"@id": "a", "@type": "e:Person", "name": ["Ann", {"@value": "Anne", "@language": "fr"}], "knows": ["c", "e:d"], "e:age": 7, "e:near": {"name": "x"}, "items": [1, true], "note": "no IRI", "e:none": null}]}"""
    got = shape(triples_of(doc, "json-ld"))
    x = "http://www.w3.org/2001/XMLSchema#"
    assert ("http://b/a", R + "type", "http://e/Person") in got
    assert [t[2] for t in got if t[1] == "http://e/name"] == ['"Ann"', '"Anne"@fr', '"x"']
    assert [t[2] for t in got if t[1] == "http://e/knows"] == ["http://b/c", "http://e/d"]
    assert ("http://b/a", "http://e/age", f'"7"^^<{x}integer>') in got
    assert [t[2] for t in got if t[1] == R + "first"] == [f'"1"^^<{x}integer>', f'"true"^^<{x}boolean>']
    assert not [t for t in got if "note" in t[1] or "none" in t[1]]
    with pytest.raises(ValueError, match="context"):
        list(triples_of('{"@context": "http://far/away", "a": 1}', "json-ld"))
