"""What several operators of this subpackage use: word splitting, hashing, key buckets, cut lineage.

Words are ``[^\\x20\\x09-\\x0D]+``, which is how ``bytes.split()`` cuts UTF-8. A chunk is a run of
documents with at most ``CHUNK_BYTES`` of text (or a single longer document); Python code works on
one chunk at a time, so a worker's memory doesn't grow with a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.lineage import give_back, release, settle  # noqa: F401  used by the operators

CHUNK_BYTES = 3 << 20
#: Words whose hash a worker remembers, at most.
WORD_CACHE = 200_000
#: A bucket with more than so many times the mean number of entries is dealt out.
HOT = 3
#: The pattern of a word, for Java and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: A missing doc_id orders after every other.
LAST_ID = (1 << 63) - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)


def row_key() -> Column:
    """Identifies a document's row by id and text: repeated rows share it, nulls are allowed."""
    return F.xxhash64("doc_id", "text")


def order_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def n_buckets(df: DataFrame, mb: int = 24) -> int:
    """Buckets for keys drawn from df: the session's shuffle partitions, or one for each mb of its input if more."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # unknown
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (mb << 20)))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hash of each word, remembered for up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def hashed_words(texts: list[bytes | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words end among them."""
    lists = [t.split() if t else [] for t in texts]
    ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
    total = int(ends[-1]) if len(ends) else 0
    get = cache.__getitem__
    return np.fromiter((get(w) for ws in lists for w in ws), np.uint64, total), ends


def column_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; windows that run over the end are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def by_bucket(h: np.ndarray, n_buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that h falls in: the bucket and, as bytes, its part of each column."""
    bucket = (h % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n_buckets))
    parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    rows = [pa.array([int(bucket[p[0]]) for p in parts], pa.int32())]
    return pa.RecordBatch.from_arrays([*rows, *(pa.array([c[p].tobytes() for p in parts], pa.binary()) for c in columns.values())], names=["bucket", *columns])


def packed_entries(keys: np.ndarray, rows: np.ndarray, n: int) -> pa.RecordBatch:
    """Entries (key, row) by the bucket of the key; a row stands once for its keys in a bucket, with their number."""
    bucket = (mix(keys & ~np.uint64(1)) % np.uint64(n)).astype(np.int64)
    order = np.lexsort((rows, bucket))
    bucket, keys, rows = bucket[order], keys[order], rows[order]
    begin = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (rows[1:] != rows[:-1]))) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(keys)))
    if len(size) and size.max() > 0xFFFF:  # counts have two bytes
        begin = np.union1d(begin, np.concatenate([np.arange(b, b + s, 0xFFFF) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]))
        size = np.diff(np.append(begin, len(keys)))
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, int)
    edges, runs = np.append(starts, len(keys)), np.append(np.searchsorted(begin, starts), len(begin))
    cut = lambda x, e: pa.array([x[a:b].tobytes() for a, b in zip(e[:-1], e[1:], strict=True)], pa.binary())
    parts = [cut(keys, edges), cut(size.astype(np.uint16), runs), cut(rows[begin], runs)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), *parts], names=["bucket", "keys", "counts", "rows"])


ENTRIES = "bucket int, keys binary, counts binary, rows binary"


def unpacked_entries(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return unpack(table, "keys", np.uint64), np.repeat(unpack(table, "rows", np.int64), unpack(table, "counts", np.uint16))


def unpack(table: pa.Table | pa.RecordBatch, name: str, dtype) -> np.ndarray:
    """All values of a column of packed arrays."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def packed_once(key: np.ndarray, owner: np.ndarray, n: int) -> pa.RecordBatch:
    """A chunk's distinct keys by bucket (see ``once``), with the number of entries they stand for."""
    keys = once(key, owner)
    out = by_bucket(mix(keys & ~np.uint64(1)), n, {"keys": keys})
    entries = np.bincount((mix(key & ~np.uint64(1)) % np.uint64(n)).astype(np.int64), minlength=n)
    return out.append_column("entries", pa.array(entries[out.column("bucket").to_numpy()], pa.int64()))


def repeated_keys(packed: DataFrame) -> DataFrame:
    """From ``packed_once`` rows (bucket, keys, entries): for each bucket the sorted keys that two owners have,
    and its entries in all.

    Each chunk has sent a key once, so a very frequent key costs its bucket one entry for each chunk."""

    def merge(table: pa.Table) -> pa.Table:
        keys = np.sort(unpack(table, "keys", np.uint64))
        key = keys & ~np.uint64(1)
        twice = np.zeros(len(key), bool)
        twice[1:] = key[1:] == key[:-1]
        found = np.unique(key[twice | ((keys & np.uint64(1)) > 0)])
        entries = pa.array([sum(table.column("entries").to_pylist())], pa.int64())
        return pa.table({"bucket": table.column("bucket")[:1], "shared": pa.array([found.tobytes()], pa.binary()), "entries": entries})

    return settle(packed.groupBy("bucket").applyInArrow(merge, "bucket int, shared binary, entries long"))


def hot_buckets(index: DataFrame) -> dict[int, int]:
    """Into how many parts the entries of a bucket with over HOT times the mean are to be dealt; fewer than 1 / HOT of all buckets."""
    mean = index.agg(F.avg("entries")).first()[0] or 1.0
    rows = index.where(F.col("entries") > max(HOT * mean, 4096)).select("bucket", "entries").collect()
    return {r["bucket"]: math.ceil(r["entries"] / (HOT * mean)) for r in rows}


def probe(left: DataFrame, index: DataFrame, hot: dict[int, int], n: int, by: str, look, schema: str) -> DataFrame:
    """look(left rows, index rows) for each bucket. A hot bucket's left rows (pieces of chunks) are dealt by
    a hash of the column ``by`` to several groups, each of which gets the bucket's index."""
    if hot:
        table = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])
        parts = lambda: F.coalesce(F.try_element_at(table, F.col("bucket")), F.lit(1))
        left = left.withColumn("bucket", (F.col("bucket") + F.lit(n) * F.pmod(F.xxhash64(by), parts())).cast("int"))
        index = index.withColumn("bucket", F.explode(F.transform(F.sequence(F.lit(0), parts() - 1), lambda i: F.col("bucket") + F.lit(n) * i)))
    return left.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, schema)


def pick_shared(n: int):
    """For probe(): the entries (keys, rows) whose key is in the index, packed by a hash of the row for ``gather``."""

    def look(left: pa.Table, index: pa.Table) -> pa.Table:
        keys, rows = unpacked_entries(left)
        hit = is_in(keys, unpack(index, "shared", np.uint64))
        return packed_rows(rows[hit], n, {"keys": keys[hit]})

    return look


def packed_rows(rows: np.ndarray, n: int, values: dict[str, np.ndarray]) -> pa.Table:
    return pa.Table.from_batches([by_bucket(mix(rows.astype(np.uint64)), n, {"rows": rows} | values)])


def gather(packed: DataFrame, kinds: dict[str, type]) -> DataFrame:
    """From packed_rows(): for each row the values of all its entries, as bytes."""

    def collect(table: pa.Table) -> pa.Table:
        rows = unpack(table, "rows", np.int64)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        edges = np.append(np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), len(rows)) if len(rows) else np.zeros(1, int)
        out = {"row": pa.array(rows[edges[:-1]], pa.int64())}
        for name, kind in kinds.items():
            size, raw = np.dtype(kind).itemsize, unpack(table, name, kind)[order].tobytes()
            ends = (edges * size).tolist()
            out[name] = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        return pa.table(out)

    return packed.groupBy("bucket").applyInArrow(collect, "row long, " + ", ".join(f"{c} binary" for c in kinds))


def packed_schema(*names: str) -> str:
    return "bucket int, rows binary, " + ", ".join(f"{c} binary" for c in names)


def once(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct keys with the lowest bit telling whether two owners have the key."""
    order = np.lexsort((owner, key))
    k, o = key[order] & ~np.uint64(1), owner[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return k
    return k[at] | (np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at)).astype(np.uint64)


def is_in(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys
