import json

import pytest

from lodestone.plans.graph import FactGraph
from lodestone.sources import formats
from lodestone.streaming.ingest import ingest

NT = """<http://x.org/a> <http://x.org/p> <http://x.org/b> .
# comment

<http://x.org/a> <http://x.org/q> "c d" . # more
<a> <b> "" .
<a> <b> <c>.
<a> <b> "x"@en .
_:b <p> <o> .
"""


def test_ntriples(spark, tmp_path):
    (tmp_path / "f.nt").write_text(NT)
    got = {tuple(r) for r in formats.read_ntriples(spark, str(tmp_path)).collect()}
    assert got == {("http://x.org/a", "http://x.org/p", "http://x.org/b"), ("http://x.org/a", "http://x.org/q", "c d"), ("a", "b", ""), ("a", "b", "c")}
    assert formats.rejected_lines(spark, str(tmp_path)).count() == 2
    g, new = formats.load(FactGraph.of(spark, [("a", "b", "c")]), formats.read_facts(spark, str(tmp_path), "anything"))
    assert new == 3 and g.size() == 4


def test_turtle(spark, tmp_path):
    text = '@prefix ex: <http://e.org/> .\nex:A ex:n "Physics" .\nex:A ex:n "New York" .\nex:A ex:n "J. Doe" .\nex:a ex:b ex:c ;\nex:d ex:e .\nzz:a <p> <http://o> .\n'
    new = list(formats.parse_turtle(text))
    assert [o for _, _, o in new] == ["Physics", "New York", "J. Doe", "http://e.org/c", "http://o"]
    assert new[-1] == ("zz:a", "p", "http://o") and new[0][:2] == ("http://e.org/A", "http://e.org/n")
    old = [o for _, _, o in formats.parse_turtle(text, compat=True)]
    assert old[:4] == ['"Physics"', "New York", '"J', "http://e.org/c"]
    (tmp_path / "f.ttl").write_text(text)
    assert formats.read_facts(spark, str(tmp_path), "ttl").count() == 5


def test_export(spark, tmp_path):
    g = FactGraph.of(spark, [("http://a", "http://p", "http://b"), ("http://a", "http://p", "lit"), ("<http://c>", "http://p", 'q"uote'), ("urn:x", "p", "urn:y")])
    lines = [r.line for r in formats.export(g, "nt").collect()]
    assert lines == sorted(lines) and '<urn:x> <p> "urn:y" .' in lines and "<http://a> <http://p> <http://b> ." in lines
    nodes = {r.subject: json.loads(r.node) for r in formats.jsonld_nodes(g).collect()}
    assert nodes["http://a"] == {"@id": "http://a", "http://p": ["http://b", "lit"]} and nodes["<http://c>"]["http://p"] == 'q"uote'
    with pytest.raises(ValueError):
        formats.export(g, "xml")
    formats.write(FactGraph.of(spark, [("http://a", "http://p", "lit")]), str(tmp_path / "out"))
    assert {tuple(r) for r in formats.read_ntriples(spark, str(tmp_path / "out")).collect()} == {("http://a", "http://p", "lit")}
    assert formats.export(FactGraph.of(spark, []), "nt").count() == 0


def test_namespaces(spark):
    names = formats.Namespaces({"ex": "http://e/"})
    terms = ["ex:a:b", "<ex:a>", "http://x", "no:a", "plain", "<<x>>"]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert [r[0] for r in df.select(names.column(df.t)).collect()] == [names.expand(t) for t in terms] == ["http://e/a:b", "ex:a", "http://x", "no:a", "plain", "x"]


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text("record_id,name,city\nr1,A,\nr2,,B\n")
    assert {tuple(r) for r in formats.read_records(spark, str(tmp_path)).collect()} == {("r1", "A", ""), ("r2", "", "B")}


def test_stream(spark, tmp_path):
    src, store, at = (str(tmp_path / x) for x in ("in", "store", "at"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.nt").write_text('<a> <p> "x" .\n<a> <p> "x" .\n')
    ingest(spark, src, store, at).awaitTermination()
    (tmp_path / "in/2.nt").write_text('<a> <p> "x" .\n<b> <p> "y" .\n')
    ingest(spark, src, store, at).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(store).select("subject", "predicate", "object").collect()} == {("a", "p", "x"), ("b", "p", "y")}
