"""Packing token sequences of at most ``window`` ids by order-preserving dynamic programming.

Documents stand in the order of their partition, one after the other, as a line of ids. A sequence
is a stretch of that line; the cuts minimise the sum of padding and truncation penalties: a cut at
a document's end is free, one at a sentence's end costs ``SENTENCE`` ids, and one elsewhere (offered
only where a gap without either is longer than ``GAP``) costs ``ANYWHERE``. With g(b) = cost(b) + b,

    cost(c) = penalty(c) + window - c + min { g(b) : c - window <= b < c },

whose minimum a monotone queue holds, so each cut is handled in constant time. A block of
``BLOCK`` ids is solved at a time; its last, unfinished sequence opens the next block. The rest at a
partition's end is cut into powers of two, which need no padding. There is no shuffle.

White space never lies in a token of the vocabulary, so a text's ids are those of its words in a
row; the ids of a bounded number of words are remembered.

Defined cases: a null text is empty and has the end id only; a null doc_id is carried along; repeated
rows are packed as separate documents; an empty table gives no rows; a document of any length is
cut as often as needed.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.shared import chunks, column_bytes

WINDOW = 4096
END_ID = 2
SENTENCE, ANYWHERE, GAP = 8, 24, 64
BLOCK = 1 << 19
#: Words whose ids a worker remembers, at most (and one chunk's more).
WORDS_KEPT = 700_000
#: A special token of the vocabulary, and how many new words are encoded in a line with it between them.
BETWEEN, IN_LINE = b"<|endoftext|>", 200
#: Marks become dots, the first bytes of code points outside ASCII and U+00C0 to U+027F zeros, the rest letters.
_SHAPE = bytes(
    32 if c in b" \t\n\v\f\r" else 46 if c < 128 and not chr(c).isalnum() else 0 if 0xC0 <= c < 0xC3 or c >= 0xCA else 97
    for c in range(256)
)

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)

_loaded: dict = {}


class WordIds(dict):
    """The ids of words, as unsigned 32-bit bytes (of the machine, little-endian here)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for mark in (".", "!", "?"):
            for i in self.tokenizer.encode(mark, add_special_tokens=False).ids:
                self.ends[i] = True
        self.ends[END_ID] = False
        self.mark = self.tokenizer.token_to_id(BETWEEN.decode())

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > WORDS_KEPT:
            self.clear()
        new = list(words.difference(self))
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.update(zip(part, self.together(part) or self.each(part), strict=True))

    def each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def together(self, words: list[bytes]) -> list[bytes] | None:
        """Many words to a line, cut at a special token, before which and after which text is encoded by itself; None if a word looks like one."""
        if self.mark is None or any(b"<|" in w for w in words):
            return None
        lines = [BETWEEN.join(words[k : k + IN_LINE]).decode() for k in range(0, len(words), IN_LINE)]
        ids = array("I")
        for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids.extend(e.ids)
            ids.append(self.mark)
        raw = ids.tobytes()
        ends = np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark)
        if len(ends) != len(words):
            return None
        return [raw[a:b] for a, b in zip((4 * np.append(0, ends[:-1] + 1)).tolist(), (4 * ends).tolist(), strict=True)]


def loose_words(raw: bytes | None) -> list[bytes]:
    """Parts of a text whose ids in a row are the text's.

    White space separates tokens of this vocabulary. Where no two marks stand together and all letters
    are below U+0280, which have their normal form and lower case alone, so do single marks; lower-cased
    and without marks, far fewer words are distinct. Other texts are left as they are."""
    if not raw:
        return []
    shape = raw.translate(_SHAPE)
    if b".." in shape or b"\0" in shape or b"\xc4\xb0" in raw or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
        return raw.split()
    raw = raw.lower() if raw.isascii() else raw.decode().lower().encode()
    for mark in (b".", b",", b"!", b"?", b";", b":"):
        raw = raw.replace(mark, b" " + mark + b" ")
    return raw.split()


def word_ids(path: str) -> WordIds:
    """The worker's own cache; its tokenizer runs in the worker's thread only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, open_end: bool = False) -> list[int]:
    """Chosen positions among the ascending cuts ``at`` (0 not among them), the last included; gaps must not exceed window.

    open_end: the last sequence goes on or is cut again, so that its padding doesn't count."""
    pos, pen = at.tolist(), penalty.tolist()
    came, costs = [-1] * len(pos), []
    queue = deque([(0, 0, -1)])  # position, g, index; g ascending
    push, pop, shift = queue.append, queue.pop, queue.popleft
    for k, (c, p) in enumerate(zip(pos, pen, strict=True)):
        low = c - window
        while queue[0][0] < low:
            shift()
        _, g, b = queue[0]
        came[k] = b
        g += p + window  # cost(c) + c
        while queue and queue[-1][1] >= g:
            pop()
        push((c, g, k))
        costs.append(g - c)
    out, k = [], len(pos) - 1
    if open_end and k >= 0 and pos[k] > window:
        came[k] = min(range(int(np.searchsorted(at, pos[k] - window)), k), key=costs.__getitem__)
    elif open_end and k >= 0:
        came[k] = -1
    while k >= 0:
        out.append(pos[k])
        k = came[k]
    return out[::-1]


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, ascending, and what a cut there costs."""
    inner = np.flatnonzero(sentence_end[np.minimum(ids, len(sentence_end) - 1)]) + 1
    at = np.union1d(inner, doc_ends)
    gaps = np.diff(at, prepend=0)
    wide = np.flatnonzero(gaps > GAP)
    if len(wide):
        more = [np.arange(at[k] - gaps[k] + GAP, at[k], GAP) for k in wide]
        at = np.union1d(at, np.concatenate(more))
    cost = np.full(len(at), ANYWHERE, np.int64)
    cost[np.isin(at, inner, assume_unique=True)] = SENTENCE
    cost[np.isin(at, doc_ends, assume_unique=True)] = 0
    return at, cost


def pack_partition(batches: Iterator[pa.RecordBatch], path: str, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    cache = word_ids(path)
    gc.disable()  # nothing here is cyclic, and the many words make collections slow
    end = np.array([END_ID], "<u4").tobytes()
    sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    # the open block: ids, and for each document its doc_id, ids before the block, ids in all, and end in the block
    held, docs, size = [], [], 0

    def solve(last: bool):
        nonlocal held, docs, size, sequence
        raw = b"".join(held)
        ids = np.frombuffer(raw, "<u4")
        ends = np.array([d[3] for d in docs], np.int64)
        at, cost = candidate_cuts(ids, ends, cache.ends)
        cuts = best_cuts(at, cost, window, open_end=True)
        start = cuts[-2] if len(cuts) > 1 else 0
        if last:
            rest, cuts = len(ids) - start, cuts[:-1]
            while rest:  # powers of two, the largest first
                piece = min(window, 1 << (rest.bit_length() - 1))
                start += piece
                rest -= piece
                cuts.append(start)
        else:
            cuts = cuts[:-1]
        done = cuts[-1] if cuts else 0
        edges = np.union1d(np.array(cuts, np.int64), ends[ends < done])
        begins = np.concatenate([[0], edges[:-1]]).astype(np.int64) if len(edges) else edges
        d = np.searchsorted(ends, begins, "right")
        s = np.searchsorted(cuts, begins, "right") if len(edges) else d
        s_start = np.concatenate([[0], cuts])[s] if len(edges) else d
        view = memoryview(raw)
        first = np.concatenate([[0], ends[:-1]])
        before = np.array([x[1] for x in docs], np.int64)
        out = {
            "doc_id": pa.array([docs[k][0] for k in d.tolist()], pa.int64()),
            "start": before[d] + begins - first[d] if len(edges) else begins,
            "length": edges - begins,
            "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), edges.tolist(), strict=True)], pa.int64()),
            "doc_tokens": pa.array([docs[k][2] for k in d.tolist()], pa.int64()),
            "sequence_id": s + sequence,
            "offset": begins - s_start,
        }
        sequence += len(cuts)
        keep = int(np.searchsorted(ends, done, "right")) if done else 0
        rest_docs = [(x[0], x[1] + max(0, done - int(f)), x[2], x[3] - done) for x, f in zip(docs[keep:], first[keep:].tolist(), strict=True)]
        held, docs, size = [raw[4 * done :]], rest_docs, len(ids) - done
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) if isinstance(v, np.ndarray) else v for k, v in out.items()})

    for chunk in chunks(batches):
        lists = list(map(loose_words, column_bytes(chunk)))
        cache.learn(set().union(*lists))
        get = cache.__getitem__
        for doc_id, words in zip(chunk.column("doc_id").to_pylist(), lists, strict=True):
            raw = b"".join(map(get, words)) + end
            n = len(raw) // 4
            held.append(raw)
            size += n
            docs.append((doc_id, 0, n, size))
            if size >= BLOCK:
                yield solve(False)
    if size:
        yield solve(True)
    gc.enable()


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece of a document: where it lies in its document and in its sequence.

    ``tokenizer_path`` must be readable on every executor, as the vocabulary's package is."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: pack_partition(it, tokenizer_path, window), SCHEMA)
