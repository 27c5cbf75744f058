import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import jaccard_join, substring_dedup, suffix_dedup

LAST = 1 << 63


def words(t):
    return (t or "").encode().split()


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_substring_dedup(docs, rows):
    first = {}
    for d, t, *_ in sorted(rows, key=lambda x: LAST if x[0] is None else x[0]):
        w = words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), LAST if d is None else d)
    want = []
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (LAST if d is None else d):
                gone[i : i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((d, len(w), sum(gone), digest(b" ".join(kept))))
    got = [tuple(r)[:4] for r in substring_dedup.dedup_digests(docs).collect()]
    assert Counter(got) == Counter(want) and sum(w[2] for w in want) > 1000


def test_suffix_dedup(docs, rows):
    least = 60
    seen = Counter(b[i : i + least] for _, t, *_ in rows for b in [(t or "").encode()] for i in range(len(b) - least + 1))
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), digest(kept)))
    out = suffix_dedup.dedup(docs, least=least).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, digest(bytes(r.kept))) for r in out]
    assert Counter(got) == Counter(want)


def test_suffix_structures():
    rng = np.random.default_rng(1)
    for alphabet in (2, 4, 200):
        text = rng.integers(0, alphabet, 700).astype(np.uint8)
        text[300:400] = text[50:150]
        raw = text.tobytes()
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        longest, runs = suffix_dedup.matching_statistics(text)

        def common(a, b):
            k = 0
            while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            return k

        place = {int(s): k for k, s in enumerate(sa)}
        for i in range(0, len(raw), 7):
            k = place[i]
            near = [int(sa[j]) for j in (k - 1, k + 1) if 0 <= j < len(raw)]
            assert longest[i] == max(common(i, j) for j in near)
        assert 1 <= runs <= len(raw)


def components(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), LAST), d)
    return [(rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, k, percent):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, k, percent).collect()]
    assert Counter(got) == Counter(components(rows, k, percent))


def test_jaccard_join_loose_groups(spark):
    """Groups whose members don't all link to one of them, and very short sets."""
    r = random.Random(5)
    base = [[f"w{r.randrange(500)}" for _ in range(r.choice([3, 6, 9, 15, 40]))] for _ in range(12)]
    rows = []
    for i in range(300):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, max(2, len(w) // 6))):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((2, 60), (1, 70)):
        got = [(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(df, k, percent).collect()]
        assert Counter(got) == Counter(components(rows, k, percent))


def test_jaccard_join_below_half(spark):
    """Linked sets may be several sizes apart: 127 and 260 words are two tiles from one another."""
    word = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(word[a:b])) for i, (a, b) in enumerate([(0, 127), (0, 260), (400, 407), (400, 432), (500, 501), (500, 505), (600, 640)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (45, 20):
        got = [(x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(df, 1, percent).collect()]
        assert Counter(got) == Counter(components(rows, 1, percent))
    with pytest.raises(ValueError):
        jaccard_join.join(df, 1, 0)


def test_keep_one(docs, rows):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect() if r.doc_id is not None}
    assert got == {c for d, _, c in components(rows, 5, 80) if c is not None}


def test_bitmap_bound_never_excludes_a_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(5, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 60, 3, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        maps = jaccard_join.fold([jaccard_join.bitmap(a), jaccard_join.bitmap(b)])
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert jaccard_join.may_link(len(a), maps[0], len(b), maps[1], 80)


def test_empty(empty):
    assert substring_dedup.dedup_digests(empty).count() == 0
    assert suffix_dedup.dedup_digests(empty).count() == 0
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0
