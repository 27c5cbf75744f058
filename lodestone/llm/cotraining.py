"""Quality classifier by co-training.

Two logistic regressions see different views of a document: its text (hashed word shares and content
features) and its page metadata (language, source, length). In each round either one labels the
unlabelled documents it is surest of and hands them to the other's training set. Both are then calibrated on
labelled rows that were held out, and a logistic regression of the two calibrated views scores every
document.

The labelled rows are at most ``LABELLED``, in the order of a hash of doc_id. In each round every unlabelled
row is scored and a text is handed over once: at most ``HANDED_OVER`` for each class and view. Both views
of all rows are computed once and kept; every row of the corpus is scored.

Defined cases: a null text is empty, null metadata are a value of their own; a null doc_id is scored
like others and is never trained on; repeated rows get equal rows; without labels of both classes
all scores are 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_rules import RULES, features
from lodestone.llm.shared import WordHashes, chunks, column_bytes, hashed_words, release, settle

LABELLED = 3000
#: Hashed words of the text view, and hashed values of the metadata view.
WORDS, VALUES = 2048, 64
ROUNDS, HANDED_OVER, SURE = 4, 150, 0.9
HELD_OUT = 0.25

_NAMES = [r[0] for r in RULES]
_META = ("lang", "source", "n_chars")


def _content(more: dict[str, float]) -> list[float]:
    return [0.0 if (x := more[n]) != x else min(np.log1p(x) / 5 if n == "n_words" else x, 4.0) for n in _NAMES]


def _views(chunk: pa.RecordBatch, cache: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, list[float], np.ndarray]]:
    """For each document: word buckets, content features, metadata buckets, metadata numbers."""
    texts = column_bytes(chunk)
    h, ends = hashed_words(texts, cache)
    meta = [chunk.column(c).to_pylist() for c in _META]
    start = 0
    for i, (raw, end) in enumerate(zip(texts, ends.tolist(), strict=True)):
        own = h[start:end]
        start = end
        lang, source, n = (m[i] for m in meta)
        values = [xxhash.xxh3_64_intdigest(f"{k}={v}".encode()) % VALUES for k, v in (("lang", lang), ("source", source))]
        size = np.log1p(max(0, n or 0))
        yield (own % np.uint64(WORDS)).astype(np.int64), np.array(_content(features(raw or b"", own)[1])), values, np.array([size / 5, (size / 5) ** 2, n is None])


_KEPT = "doc_id long, row long, text_key long, words binary, content binary, page binary, numbers binary"
_KINDS = (("words", np.uint16), ("content", float), ("page", np.uint8), ("numbers", float))


def _kept_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for chunk in chunks(batches):
        out = [(w.astype(np.uint16), c, np.array(v, np.uint8), x.astype(float)) for w, c, v, x in _views(chunk, cache)]
        packed = [pa.array([o[k].tobytes() for o in out], pa.binary()) for k in range(len(_KINDS))]
        names = ["doc_id", "row", "text_key"]
        yield pa.RecordBatch.from_arrays([*(chunk.column(n) for n in names), *packed], names=[*names, *(n for n, _ in _KINDS)])


def _unpacked(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    columns = [[np.frombuffer(x, t) for x in batch.column(n).to_pylist()] for n, t in _KINDS]
    return zip(*columns, strict=True)


def _logit(views, t: np.ndarray, e: np.ndarray) -> tuple[float, float]:
    words, content, values, numbers = views
    return 30.0 / max(len(words), 1) * t[words].sum() + content @ t[WORDS:-1] + t[-1], e[values].sum() + numbers @ e[VALUES:-1] + e[-1]


def _dense(views) -> tuple[np.ndarray, np.ndarray]:
    words, content, values, numbers = views
    x = np.bincount(words, minlength=WORDS) * (30.0 / max(len(words), 1))
    m = np.zeros(VALUES)
    m[values] = 1
    return np.concatenate([x, content]), np.concatenate([m, numbers])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights and, last, the intercept: accelerated gradient descent on the mean loss, classes weighted alike."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1, dtype=np.float32)
    y = y.astype(np.float32)
    w = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32) / len(y)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(8):  # the largest curvature
        v = x.T @ (w * (x @ v))
        v /= max(np.linalg.norm(v), 1e-30)
    rate = np.float32(1) / np.float32(0.25 * float(v @ (x.T @ (w * (x @ v)))) * 1.1 + l2)
    a = b = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        g = x.T @ (w * (sigmoid(x @ b) - y)) + np.float32(l2) * np.append(b[:-1], np.float32(0))
        new = b - rate * g
        b, a = new + t / (t + 3) * (new - a), new
    return a.astype(float)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views: list[np.ndarray], y: np.ndarray, surest, seed: int = 1) -> dict[str, np.ndarray] | None:
    """Weights of both views, their calibrations (slope, intercept) and the weights that join them.

    surest(ws) hands over, for each view k, class and set of texts, (k, label, both views of them)."""
    if not len(y) or y.min() == y.max():
        return None
    held = np.random.default_rng(seed).random(len(y)) < HELD_OUT
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    train = [[v[~held]] for v in views]
    said = [[y[~held]] for _ in views]
    ws = [fit_logistic(t[0], s[0]) for t, s in zip(train, said, strict=True)]
    for _ in range(ROUNDS):
        given = surest(ws)
        if not given:
            break
        for k, label, found in given:
            train[1 - k].append(found[1 - k])
            said[1 - k].append(np.full(len(found[0]), label))
        ws = [fit_logistic(np.concatenate(t), np.concatenate(s)) for t, s in zip(train, said, strict=True)]
    judged = held if held.any() else np.ones(len(y), bool)
    z = [logits(v[judged], w) for v, w in zip(views, ws, strict=True)]
    platt = [fit_logistic(x[:, None], y[judged], 1e-4) for x in z]
    both = fit_logistic(np.stack([c[0] * x + c[1] for x, c in zip(z, platt, strict=True)], 1), y[judged], 1e-3)
    return {"text": ws[0], "meta": ws[1], "platt": np.array(platt), "both": both}


def _wide(got: pa.Table) -> list[np.ndarray]:
    """Dense views of a bounded number of rows."""
    both = [_dense(v) for v in _unpacked(got)]
    return [np.array([b[k] for b in both], np.float32) for k in (0, 1)]


def _surest(rows: DataFrame, known: DataFrame | None = None):
    """For co_train(): scores all rows in the executors and takes the surest unlabelled ones of each class and view.

    known has the labelled ids; only the scores, not the views, are dealt by doc_id to leave them out."""
    taken: set[int] = set()
    #: What a list may lose to the two of the other view.
    most = 3 * HANDED_OVER
    names, kinds = ("k", "c", "text_key", "far", "row", "doc_id"), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def sure(batches):
        """The rows that a view is sure of."""
        t, e = model.value
        for batch in batches:
            out = []
            keys, ids, docs = (batch.column(c).to_numpy().tolist() for c in ("text_key", "row", "doc_id"))
            for key, row, doc, views in zip(keys, ids, docs, _unpacked(batch), strict=True):
                if key in gone:
                    continue
                for k, p in enumerate(sigmoid(np.array(_logit(views, t, e)))):
                    c = int(p >= 0.5)
                    if (p if c else 1 - p) >= SURE:
                        out.append((k, c, key, float(-p if c else p), row, doc))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=names)

    def surest(ws):
        nonlocal model, gone
        model, gone = rows.sparkSession.sparkContext.broadcast(ws), frozenset(taken)
        free = rows.where("doc_id is not null")
        found = free.mapInArrow(sure, "k int, c int, text_key long, far double, row long, doc_id long")
        if known is not None:
            found = found.join(known, F.col("doc_id") == F.col("id"), "left_anti")
        found = settle(found.groupBy("k", "c", "text_key").agg(F.min(F.struct("far", "row")).alias("x")))
        picked = {}
        for k in (0, 1):
            for c in (1, 0):
                top = found.where((F.col("k") == k) & (F.col("c") == c)).orderBy("x.far", "text_key").limit(most).select("text_key", "x.row").collect()
                mine = [r for r in top if r["text_key"] not in taken][:HANDED_OVER]
                taken.update(r["text_key"] for r in mine)
                picked |= {r["row"]: (k, c) for r in mine}
        release(found)
        if not picked:
            return []
        got = free.where(F.col("row").isin(list(picked))).dropDuplicates(["row"]).orderBy("row").toArrow()  # 4 x HANDED_OVER rows at most
        views, lists = _wide(got), [picked[r] for r in got.column("row").to_pylist()]
        at = {x: [i for i, y in enumerate(lists) if y == x] for x in sorted(set(lists))}
        return [(k, float(c), [v[i] for v in views]) for (k, c), i in at.items()]

    model, gone = None, frozenset()
    return surest


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, text_score, meta_score, score: probabilities that the label is 1."""
    row = F.xxhash64("doc_id", "text", *_META).alias("row")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("double").alias("y"))
    rows = docs.select("*", row, F.xxhash64("text").alias("text_key")).mapInArrow(_kept_views, _KEPT)
    rows, known = settle(rows), settle(known)
    some = known.orderBy(F.xxhash64("id"), "id").limit(LABELLED).select(F.col("id").alias("doc_id"), "y")
    got = rows.join(F.broadcast(some), "doc_id").orderBy("doc_id", "row").toArrow()  # the rows of LABELLED ids
    y = np.array(got.column("y").to_pylist(), float)
    model = docs.sparkSession.sparkContext.broadcast(co_train(_wide(got), y, _surest(rows, known.where("y is not null").select("id"))))
    release(known)

    def apply(batches):
        m = model.value
        for chunk in batches:
            out = []
            for kept in _unpacked(chunk):
                if m is None:
                    out.append((0.5, 0.5, 0.5))
                    continue
                z, u = _logit(kept, m["text"], m["meta"])
                views = m["platt"][:, 0] * (z, u) + m["platt"][:, 1]
                out.append((*sigmoid(views), sigmoid(views @ m["both"][:-1] + m["both"][-1])))
            if not out:
                continue
            cols = [pa.array(np.array(c, float)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *cols], names=["doc_id", "text_score", "meta_score", "score"])

    return rows.select("doc_id", *[n for n, _ in _KINDS]).mapInArrow(apply, "doc_id long, text_score double, meta_score double, score double")
