import pytest

from lodestone.plans.graph import FactGraph, join_order
from lodestone.plans.patterns import Pattern, parse, parse_pattern

NINE = [
    ("oak", "growsIn", "meadow"), ("reed", "growsIn", "pond"), ("fir", "growsIn", "slope"),
    ("meadow", "partOf", "valley"), ("pond", "partOf", "marsh"), ("slope", "partOf", "ridge"),
    ("oak", "leaf", "broad"), ("reed", "leaf", "narrow"), ("fir", "leaf", "broad"),
]


@pytest.fixture(scope="module")
def nine(spark):
    return FactGraph.of(spark, NINE + NINE[:2])


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_parse():
    q = parse('select ?a ?b where { ?a <http://x.org/p.q> ?b . ?b name "J. Doe" } LIMIT 5 OFFSET 2')
    assert q.select == ["?a", "?b"] and q.limit == 5 and q.offset == 2
    assert q.patterns == [Pattern("?a", "http://x.org/p.q", "?b"), Pattern("?b", "name", "J. Doe")]
    assert q.all_variables == {"?a", "?b"}
    assert parse_pattern("?x p ?x").bound_count == 1 and parse_pattern("?x p ?x").variables == ["?x", "?x"]


@pytest.mark.parametrize("text", ["SELECT * WHERE { ?x p ?y }", "PREFIX a: <b> SELECT ?x WHERE { ?x p ?y }", "SELECT ?x WHERE { }", "SELECT ?x WHERE { ?x p }", "SELECT ?x { ?x p ?y }"])
def test_bad_queries(text):
    with pytest.raises(ValueError):
        parse(text)
    with pytest.raises(ValueError):
        parse_pattern("a b")


def test_compat():
    q = parse("SELECT ?x WHERE { ?x speedlimit 50 extra . ?x p }", compat=True)
    assert q.patterns == [Pattern("?x", "speedlimit", "50")] and q.limit == 50
    assert parse("SELECT ?x WHERE { ?x speedlimit 50 }").limit is None


def test_store(nine):
    assert nine.size() == 9
    assert nine.lookup(predicate="growsIn").count() == 3 and nine.lookup("oak", "", None).count() == 2
    assert nine.contains(*NINE[0]) and not nine.contains("oak", "growsIn", "")
    assert nine.cardinality("oak", "growsIn", "nowhere") == 1 and nine.cardinality() == 9
    assert nine.entities().count() == 11
    more = FactGraph.of(nine.facts.sparkSession, [NINE[0], ("a", "b", "c")]).facts
    assert rows(nine.new_facts(more)) == {("a", "b", "c")} and nine.add_all(more).size() == 10
    assert nine.remove_all(more).size() == 8 and nine.remove_all(more).lookup(predicate="growsIn").count() == 2


def test_queries(nine):
    assert rows(nine.query("SELECT ?x WHERE { ?x growsIn ?c . ?c partOf valley }")) == {("oak",)}
    assert rows(nine.query("SELECT ?x ?c WHERE { ?x leaf broad . ?x growsIn ?c }")) == {("oak", "meadow"), ("fir", "slope")}
    assert rows(nine.query("SELECT ?x WHERE { ?x ?p ?x }")) == set()
    assert nine.query("SELECT ?nosuch WHERE { ?x leaf ?y }").count() == 1
    assert nine.query("SELECT ?nosuch WHERE { ?x nosuch ?y }").count() == 0
    assert nine.query("SELECT ?x WHERE { ?x leaf ?y } LIMIT 0 OFFSET 0").count() == 3
    assert [r[0] for r in nine.query("SELECT ?x WHERE { ?x leaf ?y } LIMIT 1 OFFSET 1").collect()] == ["oak"]
    assert nine.query("SELECT ?x ?y WHERE { ?x leaf broad . ?y partOf marsh }").count() == 2
    assert nine.query("SELECT ?x WHERE { ?x leaf broad . reed leaf narrow }").count() == 2
    assert nine.query("SELECT ?x WHERE { ?x leaf broad . reed leaf broad }").count() == 0


def test_order_doesnt_matter(nine):
    a = rows(nine.query("SELECT ?x ?f WHERE { ?x growsIn ?c . ?c partOf ?l . ?x leaf ?f }"))
    b = rows(nine.query("SELECT ?x ?f WHERE { ?x leaf ?f . ?c partOf ?l . ?x growsIn ?c }"))
    assert a == b and len(a) == 3


def test_plan(nine):
    plan = nine.plan(parse("SELECT ?x WHERE { ?x growsIn ?place . ?place partOf valley }")).orderBy("step").collect()
    assert [r.pattern for r in plan] == ["?place partOf valley", "?x growsIn ?place"]
    assert [r.cardinality for r in plan] == [1, 3] and plan[0].cost == 4.0 and abs(plan[1].selectivity - 3 / 9) < 1e-12
    assert join_order([Pattern("?a", "p", "?b"), Pattern("?c", "p", "?d"), Pattern("?b", "q", "?c")], [1, 2, 3]) == [0, 2, 1]
