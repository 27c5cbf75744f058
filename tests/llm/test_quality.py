import re
from collections import Counter

import numpy as np

from lodestone.llm import cotraining, quality_rules


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, rows):
    out = quality_rules.score(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = Counter()
    for d, t, *_ in rows:
        b = brute(t or "")
        want[(d, *b, b[0] < 20 or 100 * b[4] > 30 * b[0])] += 1
    assert got == want and not any(r.kept and r.base_failed for r in out)


def test_weak_supervision(spark):
    good = [(i, " ".join(f"wort{(i * 31 + k * 7) % 997} und" for k in range(60)) + ".") for i in range(60)]
    junk = [(1000 + i, " ".join(f"wort{(i * 31 + k * 7) % 997}### |" for k in range(60))) for i in range(8)]
    loud = [(2000 + i, " ".join(f"WORT{chr(65 + (i + k) % 26)}{chr(65 + k % 26)}!!" for k in range(60))) for i in range(8)]
    out = quality_rules.score(spark.createDataFrame(good + junk + loud, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.kept} == {d for d, _ in good}


def slow_fit(patterns, counts, rounds):
    """The same estimation, one document pattern, kind and rule at a time."""
    rules = len(patterns[0])
    kinds = range(rules + 1)
    good, own, other = quality_rules.SAYS_BAD
    rate = [sum(n for n, p in zip(counts, patterns) if p[i] == "b") / sum(n for n, p in zip(counts, patterns) if p[i] != "-") for i in range(rules)]
    rate = [min(own, max(other, x)) for x in rate]
    start = [[(rate[i] if rate[i] > 0.5 else good) if k == 0 else own if k - 1 == i else rate[i] for i in range(rules)] for k in kinds]
    first = [quality_rules.GOOD_SHARE] + [(1 - quality_rules.GOOD_SHARE) / rules] * rules
    chance, share = [list(x) for x in start], list(first)
    for _ in range(rounds):
        post = []
        for p in patterns:
            like = []
            for k in kinds:
                x = share[k]
                for i, vote in enumerate(p):
                    x *= chance[k][i] if vote == "b" else 1 - chance[k][i] if vote == "g" else 1
                like.append(x)
            post.append([x / sum(like) for x in like])
        weight = quality_rules.PSEUDO
        for k in kinds:
            share[k] = (sum(n * q[k] for n, q in zip(counts, post)) + first[k] * weight) / (sum(counts) + weight)
            for i in range(rules):
                said = sum(n * q[k] for n, q, p in zip(counts, post, patterns) if p[i] != "-")
                bad = sum(n * q[k] for n, q, p in zip(counts, post, patterns) if p[i] == "b")
                chance[k][i] = (bad + start[k][i] * weight) / (said + weight)
    return {p: q[0] for p, q in zip(patterns, post)}, share, chance


def test_estimation(monkeypatch):
    patterns, counts = ["gggg", "ggg-", "bbgg", "bgbg", "gggb", "-bb-", "gbgg", "bbbg"], [700, 100, 60, 40, 30, 9, 20, 11]
    monkeypatch.setattr(quality_rules, "ROUNDS", 40)
    monkeypatch.setattr(quality_rules, "CLOSE", 0.0)
    got, want = quality_rules.fit(patterns, counts), slow_fit(patterns, counts, 40)
    assert all(abs(got[0][p] - want[0][p]) < 1e-9 for p in patterns)
    assert np.allclose(got[1], want[1]) and np.allclose(got[2], want[2])


def test_estimates_recover_the_truth():
    """Votes drawn from known chances: shares and chances move there from their start."""
    rng, rules = np.random.default_rng(9), 6
    truth = np.full((3, rules), 0.01)
    truth[1, :3], truth[2, 3:5] = 0.85, 0.9
    kind = rng.choice(3, 20_000, p=[0.7, 0.2, 0.1])
    votes = ["".join("b" if x else "g" for x in row) for row in rng.random((len(kind), rules)) < truth[kind]]
    table = Counter(votes)
    posterior, share, chance = quality_rules.fit(list(table), list(table.values()))
    assert abs(share[0] - 0.7) < 0.02 and np.abs(chance[0] - truth[0]).max() < 0.03
    assert posterior["gggggg"] > 0.9 and posterior["bbgggg"] < 0.1 and posterior["gggbbg"] < 0.1
    keep = np.array([posterior[x] >= 0.5 for x in votes])
    passes = np.array(["b" not in x for x in votes])
    assert (keep == (kind == 0)).mean() > (passes == (kind == 0)).mean()


def test_keep_and_empty(docs, empty):
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.score(docs).where("kept").count()
    assert quality_rules.score(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_cotraining(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(600):
        y = i % 3 > 0
        text = " ".join((f"good{rng.integers(40)}" if y else f"bad{rng.integers(40)}") if rng.random() < 0.2 else f"w{rng.integers(300)}" for _ in range(60))
        source = f"s{rng.integers(5) + (5 if y else 0)}" if rng.random() < 0.9 else "s9"
        docs.append((i, text, "en", source, len(text), 1))
        if i < 250:
            labels.append((i, int(y), 0))
    df = spark.createDataFrame([*docs, (None, None, None, None, None, 2), docs[0]], "doc_id long, text string, lang string, source string, n_chars long, score int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = cotraining.classify(df, lab).collect()
    assert len(out) == 602
    test = [(r.doc_id % 3 > 0, r) for r in out if r.doc_id is not None and r.doc_id >= 250]
    for name, least in (("score", 0.9), ("text_score", 0.85), ("meta_score", 0.85)):
        assert np.mean([(r[name] > 0.5) == y for y, r in test]) >= least, name
    alone = cotraining.classify(df, lab.where("quality = 1")).first()
    assert alone.score == 0.5 and cotraining.classify(df.limit(0), lab).count() == 0


def test_cotraining_searches_all_unlabelled(spark):
    """The surest unlabelled texts are handed over, once each, wherever they stand among more than 5,000."""
    from lodestone.llm.shared import settle

    rng = np.random.default_rng(2)
    text = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 300, k))
    docs = [(i, text(12), "en", "s0", 60) for i in range(7000)]
    docs += [(10_000 + i, f"rare{i} gold gold gold gold gold " + text(4), "en", "s1", 60) for i in range(40)] + [(20_000 + i, docs[0][1], "en", "s0", 60) for i in range(500)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    rows = rows.selectExpr("*", "xxhash64(doc_id, text, lang, source, n_chars) AS row", "xxhash64(text) AS text_key").mapInArrow(cotraining._kept_views, cotraining._KEPT)
    rows = settle(rows.selectExpr("*", "CAST(null AS double) AS y"))
    gold = cotraining.WordHashes()[b"gold"] % cotraining.WORDS
    wide = [cotraining._dense(v) for v in cotraining._unpacked(rows.limit(1).toArrow())]
    ws = [np.zeros(len(w) + 1) for w in wide[0]]
    ws[0][int(gold)], ws[0][-1] = 2.0, -6.0
    surest = cotraining._surest(rows)
    given = {(k, c): found for k, c, found in surest(ws)}
    assert set(given) == {(0, 1.0), (0, 0.0)}
    assert len(given[0, 1.0][0]) == 40 and (given[0, 1.0][0][:, int(gold)] > 10).all()
    assert len(given[0, 0.0][0]) == cotraining.HANDED_OVER
    again = {(k, c): found for k, c, found in surest(ws)}
    assert set(again) == {(0, 0.0)} and len(again[0, 0.0][0]) == cotraining.HANDED_OVER


def test_cotraining_deals_no_views(spark, monkeypatch):
    """However large the labels are, the table of views is written without a shuffle; labelled rows are never handed over."""
    plans, settle, known = [], cotraining.settle, set()
    monkeypatch.setattr(cotraining, "settle", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or settle(df))
    wide = cotraining._wide
    monkeypatch.setattr(cotraining, "_wide", lambda got: known.add(tuple(got.column("doc_id").to_pylist()) if "doc_id" in got.column_names else ()) or wide(got))
    docs = [(i, " ".join(["good" if i % 2 else "bad"] * 5 + [f"w{(i * k) % 97}" for k in range(20)]), "en", "s", 100) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert cotraining.classify(df, lab).count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    views = [p for c, p in plans if "words" in c]
    assert len(views) == 1 and "Exchange" not in views[0]
    given = [set(x) for x in known if x and len(x) != 200]
    assert given and all(min(x) >= 200 for x in given)
