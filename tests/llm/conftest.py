import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, keys string, bucket int, size long"


def make(seed: int, n: int = 120):
    """Documents with copies, near copies, shared passages, repetition, nulls, blanks and a long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    vocab = [word() for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocab) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(k))
    passage, out = text(70), []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            t = r.choice(out)[1]
        elif kind < 0.35 and out:
            w = (r.choice(out)[1] or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        elif kind < 0.5:
            t = text(r.randint(0, 40)) + " " + passage + " " + text(r.randint(0, 40))
        elif kind < 0.55:
            t = (text(11) + " ") * r.randint(1, 9)
        else:
            t = text(r.choice([0, 1, 3, 12, 13, 25, 80, 200]))
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, text(4000)), (None, out[3][1]), (None, None), out[5], out[5], (n + 4, "ab" * 900), (n + 5, "x " * 500)]
    meta = {d: (r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", "s3", None])) for d, _ in out}
    rows = [(d, t, *meta[d], len(t or ""), "x", "y", 3, 4) for d, t in out]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session", params=[1, 2])
def rows(request):
    return make(request.param)


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
