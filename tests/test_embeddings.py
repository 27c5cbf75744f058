import numpy as np
import pytest

from lodestone.operators import embeddings as M

TRIPLES = [(0, 0, 1), (1, 0, 2), (2, 1, 3), (3, 1, 4), (0, 2, 4), (1, 2, 3), (0, 0, 1)]
NEG = [(0, 3), (4, 2), (2, 0), (3, 0), (2, 4), (1, 0), (3, 1)]


def tables(spark, rng, dim, complex_=False):
    cols = ["re", "im"] if complex_ else ["vec"]
    make = lambda n: [(i, *[rng.normal(size=dim).tolist() for _ in cols]) for i in range(n)]
    schema = "id int, " + ", ".join(f"{c} array<double>" for c in cols)
    e, r = make(5), make(3)
    arrays = lambda rows: [np.array([x[k + 1] for x in rows]) for k in range(len(cols))]
    return spark.createDataFrame(e, schema), spark.createDataFrame(r, schema), arrays(e), arrays(r)


def batch(spark):
    return spark.createDataFrame([(*t, *n) for t, n in zip(TRIPLES, NEG, strict=True)], "h int, r int, t int, nh int, nt int")


def matrix(df, name="vec"):
    return np.array([r[name] for r in df.orderBy("id").collect()])


@pytest.mark.parametrize("norm", [1, 2])
def test_transe_step(spark, norm):
    e, r, (E,), (R,) = tables(spark, np.random.default_rng(1), 6)
    model = M.TransE(e, r, M.TransEConfig(dim=6, norm=norm, learning_rate=0.1))
    h, rel, t = np.array(TRIPLES).T
    nh, nt = np.array(NEG).T
    good, bad = E[h] + R[rel] - E[t], E[nh] + R[rel] - E[nt]
    size = (lambda x: np.abs(x).sum(1)) if norm == 1 else (lambda x: np.sqrt((x * x).sum(1)))
    loss = np.maximum(0, 1 + size(good) - size(bad))
    gp, gn = (np.sign(good), np.sign(bad)) if norm == 1 else (2 * good, 2 * bad)
    hot = loss > 0
    E2, R2 = E.copy(), R.copy()
    for at, g, k in ((h, gp, -1), (t, gp, 1), (nh, gn, 1), (nt, gn, -1)):
        np.add.at(E2, at[hot], k * 0.1 * g[hot])
    np.add.at(R2, rel[hot], -0.1 * gp[hot])
    E2 /= np.maximum(np.linalg.norm(E2, axis=1, keepdims=True), 1e-8)
    new, mean = model.step(batch(spark))
    assert abs(mean - loss.mean()) < 1e-9 and np.allclose(matrix(new.entities), E2) and np.allclose(matrix(new.relations), R2)
    score = M.triple_score(model, 0, 0, 1)
    assert abs(score + size(E[[0]] + R[[0]] - E[[1]])[0]) < 1e-9


def test_rotate_step(spark):
    e, r, (Er, Ei), (Rr, Ri) = tables(spark, np.random.default_rng(2), 4, True)
    model = M.RotatE(e, r, M.RotatEConfig(dim=4, learning_rate=0.1))
    model.relations = model.project_relations()
    m = np.sqrt(Rr**2 + Ri**2)
    Rr, Ri = Rr / m, Ri / m
    h, rel, t = np.array(TRIPLES).T
    nh, nt = np.array(NEG).T

    def gap(a, b):
        return Er[a] * Rr[rel] - Ei[a] * Ri[rel] - Er[b], Er[a] * Ri[rel] + Ei[a] * Rr[rel] - Ei[b]

    d = lambda g: np.sqrt((g[0] ** 2 + g[1] ** 2).sum(1))
    good = gap(h, t)
    loss = np.maximum(0, 6 + d(good) - d(gap(nh, nt)))
    hot = loss > 0
    A, B = Er.copy(), Ei.copy()
    np.add.at(A, h[hot], -0.1 * (good[0] * Rr[rel])[hot])
    np.add.at(B, h[hot], -0.1 * (good[1] * Rr[rel])[hot])
    np.add.at(A, t[hot], 0.1 * good[0][hot])
    np.add.at(B, t[hot], 0.1 * good[1][hot])
    new, mean = model.step(batch(spark))
    assert abs(mean - loss.mean()) < 1e-9 and np.allclose(matrix(new.entities, "re"), A) and np.allclose(matrix(new.entities, "im"), B)
    phase = np.array([x.phase for x in model.relation_phases().orderBy("id").collect()])
    assert np.allclose(phase, np.arctan2(Ri, Rr))


def test_initial_and_training(spark):
    model = M.TransE.initial(spark, 5, 3, M.TransEConfig(dim=8, learning_rate=0.05))
    assert np.allclose(np.linalg.norm(matrix(model.entities), axis=1), 1)
    rot = M.RotatE.initial(spark, 5, 3, M.RotatEConfig(dim=8))
    assert np.allclose(matrix(rot.relations, "re") ** 2 + matrix(rot.relations, "im") ** 2, 1)
    triples = spark.createDataFrame(TRIPLES[:6], "h int, r int, t int")
    neg = M.corrupt(triples, 5).collect()
    assert all((x.nh == x.h) != (x.nt == x.t) or (x.nh, x.nt) == (x.h, x.t) for x in neg) and all(0 <= x.nh < 5 and 0 <= x.nt < 5 for x in neg)
    trained, result = M.train(model, triples, 5, M.TrainerConfig(epochs=2, batch_size=4))
    assert len(result.losses) == 2 and np.allclose(np.linalg.norm(matrix(trained.entities), axis=1), 1)
    with pytest.raises(ValueError):
        M.train(model, triples, 5, M.TrainerConfig(epochs=0))
    with pytest.raises(ValueError):
        M.TransEConfig(norm=3)


def test_predict_and_evaluate(spark):
    e, r, (E,), (R,) = tables(spark, np.random.default_rng(4), 6)
    model = M.TransE(e, r, M.TransEConfig(dim=6))
    want = -np.linalg.norm(E[0] + R[1] - E, axis=1)
    vocab = spark.createDataFrame([(2, "two")], "id int, name string")
    got = M.predict_tail(model, 0, 1, 99, vocab).orderBy("rank").collect()
    assert [x.id for x in got] == list(np.argsort(-want)) and {x.name for x in got} == {"entity_0", "entity_1", "two", "entity_3", "entity_4"}
    heads = M.predict_head(model, 1, 3, 2).orderBy("rank").collect()
    assert [x.id for x in heads] == list(np.argsort(np.linalg.norm(E + R[1] - E[3], axis=1))[:2])
    rels = M.predict_relation(model, 0, 3).orderBy("rank").collect()
    assert [x.id for x in rels] == list(np.argsort(np.linalg.norm(E[0] + R - E[3], axis=1))) and rels[0].name.startswith("rel_")
    triples = spark.createDataFrame(TRIPLES[:4], "h int, r int, t int")
    ranks = {(x.h, x.r, x.t): x.rank for x in M.ranks(model, triples, block=3).collect()}
    for h, rel, t in TRIPLES[:4]:
        s = -np.linalg.norm(E[h] + R[rel] - E, axis=1)
        assert ranks[h, rel, t] == (s >= s[t]).sum()
    m = M.evaluate(model, triples).first()
    assert abs(m.mrr - np.mean([1 / x for x in ranks.values()])) < 1e-9 and m.hits_at_10 == 1.0


def test_queries_take_every_row(spark, tmp_path, monkeypatch):
    from lodestone.plans import registry

    n, rng = 620, np.random.default_rng(6)
    x = rng.normal(size=(n, 64))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {(i, i % 10, (i * 7 + 3) % n) for i in range(n)}
    seen = registry.QUERIES["negative_sample"](spark, str(tmp_path)).collect()
    assert len(seen) == n and {(r.h, r.r, r.t) for r in seen} == want and all(r.kept and r.within for r in seen)
    drawn = M.corrupt(*registry._all_triples(spark, str(tmp_path))).collect()
    assert len(drawn) == n and {(r.h, r.r, r.t) for r in drawn} == want
    assert max(max(r.nh, r.nt) for r in drawn) >= 500 and all(r.nh < n and r.nt < n and (r.nh == r.h or r.nt == r.t) for r in drawn)

    h, rel, t = np.array(sorted(want)).T
    nh, nt = h, (t * 7 + 3) % n
    z = x[:, :32] + 1j * x[:, 32:]
    w = z[:10] / np.abs(z[:10])
    size = lambda g: np.sqrt((np.abs(g) ** 2).sum(1))
    gap = z[h] * w[rel] - z[t]
    hot = 6 + size(gap) - size(z[nh] * w[rel] - z[nt]) > 0
    new = z.copy()
    np.add.at(new, h[hot], -0.01 * gap[hot] * w[rel][hot].real)
    np.add.at(new, t[hot], 0.01 * gap[hot])
    got = np.zeros_like(new)
    for r in registry.QUERIES["rotate_step"](spark, str(tmp_path)).collect():
        got[r.id, r.place - 1] = complex(r.re, r.im)
    assert np.allclose(got, new, atol=1e-6)

    seen = {}

    def spy(model, triples, n_entities, config):
        seen.update(entities=model.entities.count(), triples={tuple(r) for r in triples.collect()}, n=n_entities)
        return model, M.TrainResult([0.0])

    monkeypatch.setattr(registry.embeddings, "train", spy)
    registry.QUERIES["train_transe"](spark, str(tmp_path))
    assert seen == {"entities": n, "triples": want, "n": n}
