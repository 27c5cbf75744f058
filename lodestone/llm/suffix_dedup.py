"""Suffix-array dedup over a run-length index.

A byte is removed if it is covered by a string of ``least`` bytes that starts somewhere else too. The
corpus is cut so that each such question has one place: every window of ``least`` bytes has a
minimiser, the smallest hash of its ``SEED``-byte strings, and equal windows have equal minimisers. A
segment is a stretch of text whose windows share a minimiser; segments of one minimiser meet in one
bucket. Minimisers that stand in one place only are dropped before that.

A bucket keeps equal segments once, with whether they occur again, and builds a Burrows-Wheeler transform
of the distinct ones, kept as runs. The length of the longest match between a suffix and the one
before it in suffix order is computed for the first suffix of each run only (the sampled run ends):
within a run, going one byte to the left keeps neighbours neighbours, so that along the text the
length falls by one from a sampled suffix to the next. The longer of the two neighbours' matches is
the suffix's matching statistic, streamed in text order; windows where it reaches ``least`` are marked.
Segments that occur again are marked whole, and where a minimiser has no other segment than one such,
that run is all there is to index.

Defined cases: a null text is empty; a null doc_id is carried along; rows that repeat a text of
``least`` bytes or more are removed whole, each of them; an empty table gives no rows; matches don't
cross documents. Lengths are compared by 64-bit polynomial hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import (
    ENTRIES, chunks, column_bytes, gather, hot_buckets, is_in, mix, n_buckets, packed_entries, packed_once, packed_rows, packed_schema, pick_shared, probe, release, repeated_keys, row_key,
    settle, sliding_min, unpack,
)

LEAST, SEED = 400, 32
SCAN_BYTES, SORT_BYTES = 1 << 20, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SCAN_BYTES + (1 << 18))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def prefix_hashes(flat: np.ndarray) -> np.ndarray:
    up, _ = powers(len(flat) + 1)
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTES[flat] * up[: len(flat)], out=out[1:])
    return out


def string_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they lie."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


class Scan:
    """Segments of a chunk: document, first byte, end, minimiser (lowest bit clear)."""

    def __init__(self, texts: list[bytes | None], least: int):
        self.texts = [t or b"" for t in texts]
        self.ends = np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)))
        self.flat = np.frombuffer(b"".join(self.texts), np.uint8)
        self.prefix = prefix_hashes(self.flat)
        n, seed = len(self.flat), min(SEED, least)
        self.doc = self.start = self.end = np.zeros(0, int)
        self.key, self.twice = np.zeros(0, np.uint64), np.zeros(0, bool)
        if n < least:
            return
        _, down = powers(n + 1)
        grams = mix((self.prefix[seed:] - self.prefix[:-seed]) * down[: n - seed + 1]) & ~np.uint64(1)
        low = sliding_min(grams, least - seed + 1)
        doc = np.searchsorted(self.ends, np.arange(len(low)), "right")
        valid = np.arange(len(low)) + least <= self.ends[np.minimum(doc, len(self.ends) - 1)]
        at = np.flatnonzero(valid)
        if not len(at):
            return
        doc, low = doc[at], low[at]
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])))
        last = np.append(new[1:], len(at)) - 1
        self.doc, self.start, self.end, self.key = doc[new], at[new], at[last] + least, low[new]
        self.twice = self._places(grams, seed) > 1

    def _places(self, grams: np.ndarray, seed: int) -> np.ndarray:
        """How often each segment holds its minimiser, where no other segment has the same."""
        table = np.zeros(1 << 20, bool)
        table[(self.key >> np.uint64(20)).astype(np.int64) & 0xFFFFF] = True
        at = np.flatnonzero(table[(grams >> np.uint64(20)).astype(np.int64) & 0xFFFFF])
        order = np.argsort(self.key)
        keys = self.key[order]
        place = np.searchsorted(keys, grams[at])
        one = (place < len(keys)) & (np.searchsorted(keys, grams[at], "right") - place == 1)
        at, segment = at[one], order[place[one]]
        inside = (self.start[segment] <= at) & (at + seed <= self.end[segment])
        return np.bincount(segment[inside], minlength=len(self.key))

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return string_hashes(self.prefix, self.start[which], self.end[which])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling from eight bytes on; only groups that aren't yet told apart are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    new = np.append(True, k[1:] != k[:-1])
    rank = np.zeros(n + 1, np.int64)  # 1 and up; the end of the text is 0
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    alone = new & np.append(new[1:], True)
    open_, h = np.flatnonzero(~alone), 8
    while len(open_):
        suffix = sa[open_]
        pair = rank[suffix] * (n + 1) + rank[np.minimum(suffix + h, n)]
        order = np.argsort(pair, kind="stable")
        suffix, pair = suffix[order], pair[order]
        sa[open_] = suffix
        new = np.append(True, pair[1:] != pair[:-1])
        rank[suffix] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] + 1
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, by binary search on hashes."""
    up, _ = powers(len(prefix))
    n = len(prefix) - 1
    low, high = np.zeros(len(a), np.int64), n - np.maximum(a, b)
    left, right = up[b], up[a]
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (prefix[a + mid] - prefix[a]) * left == (prefix[b + mid] - prefix[b]) * right
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def matching_statistics(text: np.ndarray) -> tuple[np.ndarray, int]:
    """For each suffix of the text its longest match with another one, and the number of the transform's runs."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64), n
    sa = suffix_array(text)
    bwt = np.where(sa > 0, text[sa - 1].astype(np.int64), -1)
    head = np.append(True, bwt[1:] != bwt[:-1])
    head[1:] |= (sa[1:] == 0) | (sa[:-1] == 0)
    heads = np.flatnonzero(head)
    heads = heads[heads > 0]
    sampled = np.zeros(n, np.int64)
    sampled[sa[heads]] = common(prefix_hashes(text), sa[heads - 1], sa[heads])
    known = np.zeros(n, bool)
    known[sa[np.flatnonzero(head)]] = True
    known[0] = True
    place = np.maximum.accumulate(np.where(known, np.arange(n), 0))
    before = np.maximum(sampled[place] - (np.arange(n) - place), 0)
    after = np.zeros(n, np.int64)
    after[sa[:-1]] = before[sa[1:]]
    return np.maximum(before, after), int(head.sum())


def marked(segments: list[bytes], again: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of what is to be removed of each segment; again: those that occur more than once."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # a byte that UTF-8 doesn't have ends each
    longest, _ = matching_statistics(text)
    out, at = [], 0
    for s, twice in zip(segments, again.tolist(), strict=True):
        if twice:
            out.append((np.array([0], np.int32), np.array([len(s)], np.int32)))
        else:
            hit = np.flatnonzero(longest[at : at + len(s) - least + 1] >= least)
            new = np.flatnonzero(np.append(True, np.diff(hit) > 1)) if len(hit) else np.zeros(0, int)
            last = np.append(new[1:], len(hit)) - 1
            out.append((hit[new].astype(np.int32), (hit[last] + least).astype(np.int32) if len(hit) else np.zeros(0, np.int32)))
        at += len(s) + 1
    return out


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left)."""
    n = n_buckets(docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row"))

    def seeds(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, most=SCAN_BYTES):
            scan = Scan(column_bytes(chunk), least)
            if full:
                yield packed_entries(scan.key, chunk.column("row").to_numpy()[scan.doc], n)
            else:
                twice = scan.key[scan.twice]
                yield packed_once(np.concatenate([scan.key, twice]), np.concatenate([scan.start, -1 - np.flatnonzero(scan.twice)]), n)

    shared = repeated_keys(docs.select("text").mapInArrow(lambda it: seeds(it, False), "bucket int, keys binary, entries long"))
    mine = docs.select("row", "text").mapInArrow(lambda it: seeds(it, True), ENTRIES)
    hot = hot_buckets(shared)
    mine = probe(mine, shared, hot, n, "rows", pick_shared(n), packed_schema("keys"))
    mine = settle(gather(mine, {"keys": np.uint64}))
    release(shared)
    names = ["bucket", "keys", "hashes", "again", "sizes", "bytes", "refs", "rows", "starts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk and bucket: the distinct segments of wanted minimisers, and where segments stand."""
        for chunk in chunks(batches, most=SCAN_BYTES):
            scan = Scan(column_bytes(chunk), least)
            wanted = [np.frombuffer(x, np.uint64) for x in chunk.column("keys").to_pylist()]
            tag = mix(np.arange(len(wanted), dtype=np.uint64) + np.uint64(1))
            table = np.sort(np.concatenate([x ^ t for x, t in zip(wanted, tag, strict=True)]))
            at = np.flatnonzero(is_in(scan.key ^ tag[scan.doc], table)) if len(scan.key) else np.zeros(0, int)
            if not len(at):
                continue
            h, bucket = scan.hashes(at), (mix(scan.key[at]) % np.uint64(n)).astype(np.int32)
            order = np.lexsort((h, bucket))
            at, h, bucket = at[order], h[order], bucket[order]
            base = scan.ends - np.fromiter(map(len, scan.texts), np.int64, len(scan.texts))
            rows = chunk.column("row").to_numpy()
            raw = scan.flat
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, hh = at[a:b], h[a:b]
                new = np.flatnonzero(np.append(True, hh[1:] != hh[:-1]))
                again = np.diff(np.append(new, b - a)) > 1
                first = own[new]
                body = b"".join(raw[s:e].tobytes() for s, e in zip(scan.start[first], scan.end[first], strict=True))
                starts = scan.start[own] - base[scan.doc[own]]
                sizes = (scan.end[first] - scan.start[first]).astype(np.uint32)
                values = (scan.key[first], hh[new], again, sizes, body, hh, rows[scan.doc[own]], starts.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a])], pa.int32()), *(pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for v in values)], names=names
                )

    found = docs.join(mine, "row").select("row", "text", "keys")
    found = settle(found.mapInArrow(cut, "bucket int, " + ", ".join(f"{c} binary" for c in names[1:])))
    release(mine)

    def index(table: pa.Table) -> pa.Table:
        keys, h, sizes, again = (unpack(table, c, t) for c, t in (("keys", np.uint64), ("hashes", np.uint64), ("sizes", np.uint32), ("again", bool)))
        body = b"".join(table.column("bytes").to_pylist())
        begin = np.cumsum(sizes, dtype=np.int64) - sizes
        order = np.lexsort((h, keys))
        keys, h, sizes, again, begin = keys[order], h[order], sizes[order], again[order], begin[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (keys[1:] != keys[:-1]))) if len(h) else np.zeros(0, int)
        if len(new):
            again = np.logical_or.reduceat(again, new) | (np.diff(np.append(new, len(h))) > 1)
        keys, h, sizes, begin = keys[new], h[new], sizes[new], begin[new]
        groups = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, int)
        spans: list = [None] * len(keys)
        todo, held = [], 0

        def solve():
            nonlocal todo, held
            got = marked([body[begin[i] : begin[i] + sizes[i]] for i in todo], again[todo], least)
            for i, g in zip(todo, got, strict=True):
                spans[i] = g
            todo, held = [], 0

        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if b - a == 1 and again[a]:
                spans[a] = (np.array([0], np.int32), np.array([sizes[a]], np.int32))
                continue
            todo += range(a, b)
            held += int(sizes[a:b].sum())
            if held > SORT_BYTES:
                solve()
        if todo:
            solve()
        some = np.array([len(s[0]) > 0 for s in spans], bool)
        order = np.flatnonzero(some)[np.argsort(h[some])] if len(h) else np.zeros(0, int)
        counts = np.array([len(spans[i][0]) for i in order], np.uint32)
        flat = [np.concatenate([spans[i][k] for i in order]) if len(order) else np.zeros(0, np.int32) for k in (0, 1)]
        return pa.table({"bucket": table.column("bucket")[:1]} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in (("known", h[order]), ("counts", counts), ("first", flat[0]), ("last", flat[1]))})

    built = found.select("bucket", "keys", "hashes", "again", "sizes", "bytes").groupBy("bucket")
    built = settle(built.applyInArrow(index, "bucket int, known binary, counts binary, first binary, last binary"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        refs, rows, starts = unpack(left, "refs", np.uint64), unpack(left, "rows", np.int64), unpack(left, "starts", np.int64)
        known, counts = unpack(right, "known", np.uint64), unpack(right, "counts", np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(known, refs), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[at] == refs) if len(known) else np.zeros(0, int)
        own = at[hit]
        each = np.repeat(np.arange(len(hit)), counts[own])
        j = np.arange(len(each)) + np.repeat((np.cumsum(counts) - counts)[own] - (np.cumsum(counts[own]) - counts[own]), counts[own])
        first, last = (unpack(right, c, np.int32)[j] + starts[hit[each]] for c in ("first", "last"))
        return packed_rows(rows[hit[each]], n, {"first": first.astype(np.int64), "last": last.astype(np.int64)})

    spans = probe(found.select("bucket", "refs", "rows", "starts"), built, hot, n, "rows", place, packed_schema("first", "last"))
    spans = gather(spans, {"first": np.int64, "last": np.int64})
    spans = settle(spans)
    release(found, built)

    def strip(batches):
        for chunk in chunks(batches):
            out = []
            for raw, firsts, lasts in zip(column_bytes(chunk), chunk.column("first").to_pylist(), chunk.column("last").to_pylist(), strict=True):
                raw = raw or b""
                if not firsts:
                    out.append((len(raw), 0, 0, raw))
                    continue
                first, last = np.frombuffer(firsts, np.int64), np.frombuffer(lasts, np.int64)
                order = np.argsort(first, kind="stable")
                kept, reach, gone, runs = [], 0, 0, 0
                begun = False
                for a, b in zip(first[order].tolist(), last[order].tolist(), strict=True):
                    if a > reach or not begun:
                        kept.append(raw[reach:a])
                        runs, begun, reach = runs + 1, True, a
                    if b > reach:
                        gone += b - reach
                        reach = b
                kept.append(raw[reach:])
                out.append((len(raw), gone, runs, b"".join(kept)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    whole = docs.select("doc_id", "row", "text").join(spans, "row", "left").select("doc_id", "text", "first", "last")
    return whole.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
