import pytest

from lodestone.operators import paths
from lodestone.plans.graph import FactGraph


@pytest.fixture(scope="module")
def six(spark):
    return FactGraph.of(spark, [("A", "knows", "B"), ("B", "knows", "C"), ("C", "knows", "D"), ("D", "knows", "E"), ("A", "worksAt", "X"), ("B", "worksAt", "X")])


def test_shortest(six):
    r = paths.shortest_path(six, "A", "D").first()
    assert r.length == 3 and r.reachable and [tuple(h) for h in r.path] == [("A", "knows", "B"), ("B", "knows", "C"), ("C", "knows", "D")]
    assert paths.shortest_path(six, "A", "E", max_depth=3).first().length == -1
    assert paths.shortest_path(six, "E", "A").first().length == -1
    assert paths.shortest_path(six, "E", "A", directed=False).first().length == 4
    assert paths.shortest_path(six, "nowhere", "nowhere").first().length == 0
    assert paths.shortest_path(six, "A", "X", relations=[]).first().length == -1


def test_reach(six):
    assert {r.node for r in paths.neighbours(six, "A", 2).collect()} == {"B", "C", "X"}
    assert paths.neighbours(six, "A", 0).count() == 0
    assert paths.reachable(six, "A", "E") and not paths.reachable(six, "E", "A") and not paths.reachable(six, "A", "E", 3)


def test_cycles_and_parallel_edges(spark):
    g = FactGraph.of(spark, [("a", "p", "b"), ("a", "q", "b"), ("b", "p", "a"), ("b", "p", "c")])
    assert {r.node for r in paths.neighbours(g, "a", 5).collect()} == {"b", "c"}
    assert paths.simple_paths(g, "a", "c").count() == 2 and paths.simple_paths(g, "a", "a").count() == 0
    assert paths.simple_paths(g, "a", "c", max_depth=1).count() == 0
