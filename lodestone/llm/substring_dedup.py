"""Substring dedup by Relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id, held as an index from the hash of
each run of ``words`` words to the smallest document that starts it, split into blocks by hash. A
document is parsed greedily into factors: from a position that the index knows, the factor follows
one source as long as the next runs do; at its boundary the straddling runs are looked up as well, and
where one has a source of its own the next factor begins there. Factors are at least ``words`` words
long and become duplicate spans; the words between them are literals and are kept.

Only runs that may recur reach the index. Each run of 13 words has a minimiser, the smallest hash of
its 6-word runs; equal runs have equal minimisers, so a run whose minimiser stands in one place only
is left out. Steps: (1) minimisers that occur in two documents; (2) each document's part of those;
(3) the index of the runs they belong to, pre-aggregated in each chunk; (4) look-up, parse, removal.
Steps 2 and 4 look up the pieces of all chunks in a bucket's index, and the pieces of a bucket with
many are dealt to several tasks; steps 1 and 3 receive a key once from each chunk.

Defined cases: a null text has no words; a null doc_id orders after all others; repeated rows (same
doc_id) never remove each other's words; an empty table gives no rows; texts of any length are whole.
Runs are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import (
    ENTRIES, WordHashes, chunks, column_bytes, gather, gram_hashes, hashed_words, hot_buckets, is_in, mix, n_buckets, order_id, packed_entries, packed_once, packed_rows, packed_schema, pick_shared, probe, release, repeated_keys, row_key, settle, sliding_min, unpack,
)

WORDS, SEED_WORDS = 13, 6


def run_seeds(h: np.ndarray, ends: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of words within a document: where it starts, its document, its minimiser (lowest bit clear)."""
    least = sliding_min(gram_hashes(h, seed), words - seed + 1)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(np.arange(len(least)) + words <= ends[doc[: len(least)]]) if len(least) else np.zeros(0, int)
    return at, doc[at], least[at] & ~np.uint64(1)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Positions where a value differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, int)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def factors(at: np.ndarray, source: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the greedy factors, from the positions the index knows (ascending) and their sources."""
    if not len(at):
        return at, at
    begin = changes(at - np.arange(len(at)), source)
    last = np.append(begin[1:], len(at)) - 1
    return at[begin], at[last] + words


def dedup(docs: DataFrame, words: int = WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors and kept (the words left, joined by one space, as bytes)."""
    n = n_buckets(docs)
    docs = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row"), order_id().alias("ord"))

    def seeds(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for chunk in chunks(batches):
            h, ends = hashed_words(column_bytes(chunk), cache)
            _, doc, least = run_seeds(h, ends, words, seed)
            new = changes(doc, least)
            doc, least = doc[new], least[new]
            if full:
                yield packed_entries(least, chunk.column("row").to_numpy()[doc], n)
            else:
                yield packed_once(least, doc, n)

    shared = repeated_keys(docs.select("text").mapInArrow(lambda it: seeds(it, False), "bucket int, keys binary, entries long"))
    mine = docs.select("row", "text").mapInArrow(lambda it: seeds(it, True), ENTRIES)
    mine = probe(mine, shared, hot_buckets(shared), n, "rows", pick_shared(n), packed_schema("keys"))
    mine = settle(gather(mine, {"keys": np.uint64}))
    release(shared)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs whose minimiser recurs: hash, position, and the document's row and order once for each stretch."""
        cache = WordHashes()
        for chunk in chunks(batches):
            h, ends = hashed_words(column_bytes(chunk), cache)
            at, doc, least = run_seeds(h, ends, words, seed)
            wanted = [np.frombuffer(x, np.uint64) for x in chunk.column("keys").to_pylist()]
            # a document's own seeds, told apart from other documents' by its number
            tag = mix(np.arange(len(wanted), dtype=np.uint64) + np.uint64(1))
            table = np.sort(np.concatenate([x ^ t for x, t in zip(wanted, tag, strict=True)]))
            hit = is_in(least ^ tag[doc], table)
            at, doc = at[hit], doc[hit]
            run = gram_hashes(h, words)[at] & ~np.uint64(1)
            starts = ends - np.diff(ends, prepend=0)
            yield _packed_runs(run, at - starts[doc], doc, chunk, n)

    found = settle(docs.join(mine, "row").select("row", "ord", "text", "keys").mapInArrow(runs, "bucket int, runs binary, at binary, counts binary, rows binary, ords binary"))
    release(mine)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                run = unpack(one, "runs", np.uint64)
                ords = np.repeat(unpack(one, "ords", np.int64), unpack(one, "counts", np.uint32))
                order = np.lexsort((ords, run))
                new = changes(run[order])
                last = np.append(new[1:], len(run)) - 1
                lo, hi = ords[order[new]], ords[order[last]]
                keys = pa.array([(run[order[new]] | (lo != hi)).tobytes()])
                yield pa.RecordBatch.from_arrays([one.column("bucket"), keys, pa.array([lo.tobytes()]), pa.array([len(run)])], names=["bucket", "runs", "lo", "entries"])

    def merge(table: pa.Table) -> pa.Table:
        run, lo = unpack(table, "runs", np.uint64), unpack(table, "lo", np.int64)
        order = np.lexsort((lo, run & ~np.uint64(1)))
        key, many, lo = run[order] & ~np.uint64(1), (run[order] & np.uint64(1)) > 0, lo[order]
        new = changes(key)
        size = np.diff(np.append(new, len(key)))
        keep = (size > 1) | (np.logical_or.reduceat(many, new) if len(new) else many)
        entries = pa.array([sum(table.column("entries").to_pylist())], pa.int64())
        return pa.table({"bucket": table.column("bucket")[:1], "index": pa.array([key[new[keep]].tobytes()]), "lo": pa.array([lo[new[keep]].tobytes()]), "entries": entries})

    index = found.select("bucket", "runs", "counts", "ords").mapInArrow(firsts, "bucket int, runs binary, lo binary, entries long")
    index = settle(index.groupBy("bucket").applyInArrow(merge, "bucket int, index binary, lo binary, entries long"))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        run, at, counts = unpack(left, "runs", np.uint64), unpack(left, "at", np.uint32), unpack(left, "counts", np.uint32)
        table, lo = unpack(right, "index", np.uint64), unpack(right, "lo", np.int64)
        place = np.minimum(np.searchsorted(table, run), max(len(table) - 1, 0))
        owner = np.repeat(np.arange(len(counts)), counts)
        hit = np.flatnonzero((table[place] == run) & (lo[place] < unpack(left, "ords", np.int64)[owner])) if len(table) else np.zeros(0, int)
        return packed_rows(unpack(left, "rows", np.int64)[owner[hit]], n, {"at": at[hit], "source": lo[place[hit]]})

    matched = found.select("bucket", "runs", "at", "counts", "rows", "ords")
    matched = probe(matched, index, hot_buckets(index), n, "rows", look_up, packed_schema("at", "source"))
    matched = settle(gather(matched, {"at": np.uint32, "source": np.int64}))
    release(found, index)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out = []
            for raw, places, sources in zip(column_bytes(chunk), chunk.column("at").to_pylist(), chunk.column("source").to_pylist(), strict=True):
                own = raw.split() if raw else []
                total, parts = len(own), 0
                if places:
                    at, source = np.frombuffer(places, np.uint32), np.frombuffer(sources, np.int64)
                    order = np.unique(at, return_index=True)[1]
                    begin, end = factors(at[order].astype(np.int64), source[order], words)
                    parts = len(begin)
                    kept, reach = [], 0
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        if a > reach:
                            kept += own[reach:a]
                        reach = max(reach, b)
                    own = kept + own[reach:]
                out.append((total, total - len(own), parts, b" ".join(own)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_words", "n_removed", "n_factors", "kept"]
            )

    whole = docs.select("doc_id", "row", "text").join(matched, "row", "left").select("doc_id", "text", "at", "source")
    return whole.mapInArrow(parse, "doc_id long, n_words long, n_removed long, n_factors long, kept binary")


def _packed_runs(run: np.ndarray, at: np.ndarray, doc: np.ndarray, chunk: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """A row for each bucket: run hashes and positions, ordered by document, and each document's count, row and order."""
    bucket = (mix(run) % np.uint64(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, run, at, doc = bucket[order], run[order], at[order].astype(np.uint32), doc[order]
    edges = np.append(changes(bucket), len(bucket))
    rows, ords = chunk.column("row").to_numpy(), chunk.column("ord").to_numpy()
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        new = changes(doc[a:b])
        own = doc[a:b][new]
        counts = np.diff(np.append(new, b - a)).astype(np.uint32)
        out.append((int(bucket[a]), run[a:b].tobytes(), at[a:b].tobytes(), counts.tobytes(), rows[own].tobytes(), ords[own].tobytes()))
    cols = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "runs", "at", "counts", "rows", "ords"])


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_factors."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_factors")
