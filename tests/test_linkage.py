import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.operators import blocking, matching
from lodestone.operators.components import connected_components

PEOPLE = [("r1", "Greta Holm", "Oslo"), ("r2", "G. Holm", "Oslo"), ("r3", "Pauls Berzins", "Riga"), ("r4", "Paula Berzins", "Riga"), ("r5", "", "")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "record_id string, name string, city string")


def test_hash_family():
    a, b = blocking.hash_family(100)
    assert list(a[:3]) == [1608637543, 1273642420, 1935803229] and list(b[:3]) == [2016850622, 1470101905, 1181686489]
    assert list(blocking.hash_family(50)[1][:3]) == [1224821422, 508464061, 857592370]


def test_signatures(spark):
    df = spark.createDataFrame([("x", "Albert  Einstein"), ("y", "")], "record_id string, name string")
    got = {r.record_id: list(r.signature) for r in blocking.signatures(df, 50).collect()}
    assert got["x"][:3] == [62028836, 233488454, 748378095] and got["y"] == [0] * 50


def test_lsh(spark, people):
    with pytest.raises(ValueError):
        blocking.lsh_pairs(people, 100, 7)
    same = spark.createDataFrame([("a", "x y"), ("b", "y x"), ("c", ""), ("d", ""), ("e", "other")], "record_id string, t string")
    assert {tuple(r) for r in blocking.lsh_pairs(same, 20, 10).collect()} == {("a", "b"), ("c", "d")}


@pytest.mark.parametrize("parts", [1, 5])
def test_neighbourhood(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(i, f"k{rng.integers(40)}") for i in range(150)]
    df = spark.createDataFrame(rows, "record_id long, key string").repartition(parts)
    order = [i for _, i in sorted((k, i) for i, k in rows)]
    want = {tuple(sorted((order[i], order[j]))) for i in range(150) for j in range(i + 1, min(150, i + 5))}
    spark.conf.set("spark.sql.shuffle.partitions", str(7 * parts))
    got = [tuple(r) for r in blocking.neighbourhood_pairs(df, 5, F.col("key")).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(got) == want and len(got) == len(want)


def test_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("a", ""), ("É a", "é b")], "a string, b string")
    got = df.select(S.levenshtein("a", "b"), S.normalised_levenshtein("a", "b"), S.token_jaccard("a", "b"), S.cosine("a", "b")).collect()
    assert got[0][0] == 3 and got[1][1:] == (1.0, 1.0, 1.0) and got[2][1:3] == (0.0, 0.0) and abs(got[3][2] - 1 / 3) < 1e-12


def test_match_and_link(spark, people):
    pairs = spark.createDataFrame([("r1", "r2"), ("r3", "r4"), ("r1", "r5"), ("r1", "unknown")], "id1 string, id2 string")
    got = {(r.id1, r.id2): r for r in matching.Matcher(threshold=0.5).compare(people, pairs).collect()}
    assert len(got) == 3 and abs(got["r1", "r2"].similarity - (0.6 * 0.6 + 0.4)) < 1e-9 and got["r1", "r2"].is_match and not got["r1", "r5"].is_match
    clusters = matching.link(people, matching.Matcher(threshold=0.5), method="snb", window=4)
    assert {tuple(r.member_ids) for r in clusters.collect()} == {("r1", "r2"), ("r3", "r4"), ("r5",)}
    assert tuple(matching.link_statistics(clusters).first()) == (3, 1, 2, 5)
    assert tuple(matching.link_statistics(clusters.limit(0)).first()) == (0, 0, 0, 0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
