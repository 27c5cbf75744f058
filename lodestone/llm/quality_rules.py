"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation maximisation over the
counts of vote patterns (at most 3 ** rules of them, whatever the corpus) estimates how the documents
divide into good ones and kinds of junk, and for each of these how often each rule that votes says bad.
Votes are taken as independent within a kind, not among all junk: a kind sets off several rules together.
A kind starts from each rule. All shares and chances are estimated; the prior is worth ``PSEUDO``
documents. The posterior probability of good replaces passing every rule.

Defined cases: a null text has no words; a null doc_id is carried along; repeated rows get equal
rows; an empty table gives no rows; whole texts of any length are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import WordHashes, chunks, column_bytes, gram_hashes, hashed_words, row_key, settle

LEAST_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
KEEP_FROM = 0.5
ROUNDS, CLOSE = 1000, 1e-9
#: Where estimation starts: the share of good documents; a rule's chance to say bad on good documents, on the
#: kind of junk that starts from it and, at least, on the others, which start from the rule's share of bad votes; a
#: rule that says bad on most documents starts from that on good ones, too. The same values are the prior, worth so many documents.
GOOD_SHARE, SAYS_BAD, PSEUDO = 0.8, (0.005, 0.9, 0.1), 4.0

_SPACE = b" \t\n\v\f\r"
_TAIL = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that start no code point
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))

#: (feature, bad below, bad above, good from, good to): None leaves a side open; between bad and good a rule abstains.
RULES = (
    ("n_words", 20, None, 40, None),
    ("symbols_per_word", None, 0.1, None, 0.02),
    ("symbol_share", None, 0.05, None, 0.01),
    ("letter_share", 0.85, None, 0.93, None),
    ("upper_share", None, 0.3, None, 0.1),
    ("repeat_share", None, 0.2, None, 0.02),
    ("distinct_share", 0.35, None, 0.5, None),
    ("exclamations_per_word", None, 0.3, None, 0.05),
    ("dup_line_share", None, 0.3, None, 0.05),
    ("mean_word_chars", 3.5, 9.0, 4.2, 6.2),
)

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("votes", T.StringType())]
)


def repeated_words(h: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of k words found twice or more."""
    grams = gram_hashes(h, k)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    starts = np.union1d(order[1:][same], order[:-1][same])
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int((np.cumsum(edge) > 0).sum())


def repeated_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def features(raw: bytes, h: np.ndarray) -> tuple[tuple[int, ...], dict[str, float]]:
    n = len(h)
    chars = len(raw.translate(None, _TAIL + _SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup_lines, repeats = repeated_lines(raw), repeated_words(h)
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    more = {
        "n_words": n,
        "symbols_per_word": symbols / max(n, 1),
        "symbol_share": symbols / chars if chars else np.nan,
        "upper_share": upper / max(letters, 1) if letters >= 40 else np.nan,
        "repeat_share": repeats / max(n, 1),
        "distinct_share": len(np.unique(h)) / n if n >= 50 else np.nan,
        "exclamations_per_word": raw.count(b"!") / max(n, 1),
        "dup_line_share": dup_lines / max(1, raw.count(b"\n") + 1) if b"\n" in raw else np.nan,
        "mean_word_chars": chars / n if n else np.nan,
        "letter_share": letters / chars if chars else np.nan,
    }
    return (n, chars, symbols, dup_lines, repeats), more


def vote(more: dict[str, float]) -> str:
    """A letter for each rule: g, b or - if it abstains."""
    out = []
    for name, low, high, start, stop in RULES:
        x = more[name]
        if x != x:
            out.append("-")
        elif (low is not None and x < low) or (high is not None and x > high):
            out.append("b")
        else:
            out.append("g" if (start is None or x >= start) and (stop is None or x <= stop) else "-")
    return "".join(out)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for chunk in chunks(batches):
        texts = column_bytes(chunk)
        h, ends = hashed_words(texts, cache)
        rows, votes, start = [], [], 0
        for raw, end in zip(texts, ends.tolist(), strict=True):
            row, more = features(raw or b"", h[start:end])
            rows.append(row)
            votes.append(vote(more))
            start = end
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), *columns, pa.array(votes)], names=SCHEMA.names)


def fit(patterns: list[str], counts: list[int]) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Posterior probability of good for each pattern; the shares of good documents and of each kind of junk; and
    for each of these (rows) each rule's chance to say bad where it votes."""
    rules = len(patterns[0]) if patterns else len(RULES)
    good, own, other = SAYS_BAD
    v = np.array([["bg-".index(x) for x in p] for p in patterns]).reshape(-1, rules)
    n, bad, said = np.array(counts, float), v == 0, v != 2
    rate = np.clip(n @ bad / np.maximum(n @ said, 1), other, own)
    start = np.tile(rate, (rules + 1, 1))
    start[0] = np.where(rate > 0.5, rate, good)
    start[np.arange(rules) + 1, np.arange(rules)] = own
    chance, first = start, np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / rules] * rules)
    share = first
    if not patterns:
        return {}, share, chance
    for _ in range(ROUNDS):
        logs = np.log(share) + bad @ np.log(chance).T + (said & ~bad) @ np.log1p(-chance).T
        q = np.exp(logs - logs.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        w = (n[:, None] * q).T
        was = np.append(chance, share)
        chance, share = (w @ bad + start * PSEUDO) / (w @ said + PSEUDO), (w.sum(1) + first * PSEUDO) / (n.sum() + PSEUDO)
        if np.abs(np.append(chance, share) - was).max() < CLOSE:
            break
    return dict(zip(patterns, q[:, 0].tolist(), strict=True)), share, chance


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior and kept."""
    found = settle(docs.select("doc_id", "text").mapInArrow(_measure, SCHEMA))
    table = found.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    table = sorted(table)
    chance = fit([r["votes"] for r in table], [r["count"] for r in table])[0]
    pairs = found.sparkSession.createDataFrame(list(chance.items()) or [("", 0.5)], "votes string, posterior double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = found.join(F.broadcast(pairs), "votes", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP_FROM)).alias("kept"), "posterior", "votes",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept. The verdicts come back by the row's key, so that texts cross the shuffle once."""
    keyed = docs.withColumn("__row", row_key())
    verdict = score(keyed.select(F.col("__row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("__row")).distinct()
    return keyed.join(verdict, "__row", "left_semi").select(*docs.columns)
