"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct shingles; two documents link when their sets' Jaccard
similarity is at least ``percent`` / 100. Documents of size 2^t to 2^(t+1) stand in tile t, and those
whose partner may be larger than that in the tiles above too, up to the largest partner's (below 50
percent that may be several), so that linked documents share a tile. In a
tile, two linked sets differ in at most D elements. The shingles are dealt by hash to more than D
parts, so that at least one part that isn't empty is equal in both; equal parts, found by a sum of
hashes, are a tile's cells. (A set with D non-empty parts or fewer gets a cell of its kind besides.)

Documents with equal sets are one from the start. Within a cell, links are tried against one set
rather than between all: first each set with one of its cells' smallest, then, where a cell still holds more than one component, with
one of the largest, then with all that are drawn by the cells' keys. Cells that still hold several components are compared in full, in blocks, between
components: the sizes and the bit counts of hashed bitmaps bound the overlap of a pair from above
before its sorted arrays are intersected. So components are exact, without all pairs of a group.

A document with fewer words than ``words`` is one shingle; without words it is empty and alone.

Defined cases: a null text has no words; rows with equal doc_id and text are one document and get
equal rows; component_id is the smallest doc_id that isn't null; an empty table gives no rows.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import (
    ENTRIES, LAST_ID, WordHashes, by_bucket, chunks, column_bytes, gather, gram_hashes, hashed_words, hot_buckets, is_in, mix, n_buckets, packed_entries, packed_once, packed_schema, pick_shared, probe, release, repeated_keys, row_key, settle, unpack, unpacked_entries,
)
from lodestone.operators.components import connected_components

WORDS, PERCENT = 5, 80
#: Documents of a cell in a block, when a cell is compared in full.
IN_BLOCK = 1500
_LEAST_BITS, _MOST_BITS = 256, 1 << 14


def shingle_sets(texts: list[bytes | None], cache: WordHashes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each distinct shingle, ordered by both."""
    h, ends = hashed_words([t.lower() if t else t for t in texts], cache)
    grams = gram_hashes(h, words)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(np.arange(len(grams)) + words <= ends[doc[: len(grams)]]) if len(grams) else np.zeros(0, int)
    grams, owner = grams[at], doc[at]
    sizes = np.diff(ends, prepend=0)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        own = np.array([gram_hashes(h[ends[i] - sizes[i] : ends[i]], int(sizes[i]))[0] ^ np.uint64(sizes[i]) for i in short], np.uint64)
        grams, owner = np.concatenate([grams, own]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], grams[new]


def set_hashes(owner: np.ndarray, grams: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each document's set, and its size."""
    size = np.bincount(owner, minlength=n_docs)
    total = np.zeros(n_docs, np.uint64)
    begin = np.cumsum(size) - size
    some = size > 0
    if some.any():
        total[some] = np.add.reduceat(mix(grams ^ np.uint64(0xA0761D6478BD642F)), begin[some])
    return mix(total + size.astype(np.uint64)).astype(np.int64), size


def cells(owner: np.ndarray, grams: np.ndarray, n_docs: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and key (lowest bit clear) of each cell that a document lies in."""
    size = np.bincount(owner, minlength=n_docs)
    tile = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
    out = [(np.zeros(0, int), np.zeros(0, np.uint64))]
    most = int(size.max(initial=0)) * 100 // percent
    for up in range(max(most, 1).bit_length()):
        t = tile + up
        inside = size > 0 if not up else (size > 0) & (size * 100 // percent >= 1 << t)
        if not inside.any():
            break
        top = (2 << t) - 1
        apart = (100 - percent) * 2 * top // (100 + percent)
        parts = np.where(apart == 0, 1, apart * 11 // 10 + 4)
        rows = np.flatnonzero(inside[owner])
        if not len(rows):
            continue
        d, g = owner[rows], grams[rows]
        part = mix(g ^ np.uint64(0x5851F42D4C957F2D)) % parts[d].astype(np.uint64)
        group = (d.astype(np.uint64) << np.uint64(32)) | part
        order = np.argsort(group)
        group, g = group[order], g[order]
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        total = np.add.reduceat(mix(g), new)
        who = (group[new] >> np.uint64(32)).astype(int)
        out.append((who, mix(total ^ mix((t[who].astype(np.uint64) << np.uint64(40)) | ((group[new] & np.uint64(0xFFFFFFFF)) + np.uint64(1))))))
        filled = np.bincount(who, minlength=n_docs)
        own_apart = (100 - percent) * (size + np.minimum(size * 100 // percent, top)) // (100 + percent)
        few = np.flatnonzero(inside & (filled <= own_apart))
        out.append((few, mix(t[few].astype(np.uint64) + np.uint64(0x1D872B41 << 20))))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]) & ~np.uint64(1)


def bitmap(grams: np.ndarray) -> bytes:
    """Bits at the shingles' hashes; their number is a power of two, so that a longer map folds to a shorter."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, 8 << (len(grams).bit_length() - 1 if len(grams) else 0)))
    out = np.zeros(bits, np.uint8)
    out[(grams % np.uint64(bits)).astype(int)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(maps: list[bytes]) -> np.ndarray:
    """The maps as rows of words, folded to the shortest."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, least // 8), axis=0) for m in maps])


def may_link(n_a, a: np.ndarray, n_b, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes and bitmaps can reach the similarity: a bit of one map that the other lacks is an element that isn't shared."""
    most = np.minimum(n_a - np.bitwise_count(a & ~b).sum(-1), n_b - np.bitwise_count(b & ~a).sum(-1))
    return 100 * most >= percent * (n_a + n_b - most)


def bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that may link, from rows with both sizes and bitmaps."""
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        ok = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
        for i in np.flatnonzero(ok):
            x, y = fold([batch.column("map_a")[i].as_py(), batch.column("map_b")[i].as_py()])
            ok[i] = may_link(n_a[i], x, n_b[i], y, percent)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])


def links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that link, from rows with both sets."""
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = int(is_in(x, y).sum())
            ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
        keep = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "ab"], names=["a", "b"])


def compare_cells(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller, larger) of different components that share a cell and may link, each once.

    side is 0 or 1 for the two blocks of a cell that is compared in parts, 2 within one block."""
    cell, row, label, n, side = (table.column(c).to_numpy() for c in ("cell", "row", "label", "n", "side"))
    rows, first, doc = np.unique(row, return_index=True, return_inverse=True)
    order = np.lexsort((doc, cell))
    cell, doc, label, n, side = cell[order], doc[order], label[order], n[order], side[order]
    found, d, at = [np.zeros(0, np.int64)], 0, np.arange(len(cell))
    while True:
        d += 1
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        i, j = at, at + d
        ok = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] == 2) | (side[i] != side[j]))
        found.append(doc[i[ok]] * len(rows) + doc[j[ok]])
        if d % 64 == 0:
            found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found))
    x, y = pairs // max(len(rows), 1), pairs % max(len(rows), 1)
    if not len(x):
        return rows[x], rows[y]
    maps = table.column("map").combine_chunks() if isinstance(table.column("map"), pa.ChunkedArray) else table.column("map")
    size_of = table.column("n").to_numpy()[first]
    words = np.array([len(maps[int(k)].as_buffer()) // 8 for k in first])
    keep = np.zeros(len(x), bool)
    for wide in np.unique(words):
        for narrow in np.unique(words[words <= wide]):
            these = np.flatnonzero((np.maximum(words[x], words[y]) == wide) & (np.minimum(words[x], words[y]) == narrow))
            for s in range(0, len(these), 20_000):
                part = these[s : s + 20_000]
                docs, which = np.unique(np.concatenate([x[part], y[part]]), return_inverse=True)
                flat = np.stack([np.bitwise_or.reduce(np.frombuffer(maps[int(first[k])].as_buffer(), np.uint64).reshape(-1, narrow), axis=0) for k in docs])
                a, b = which[: len(part)], which[len(part) :]
                for t in range(0, len(part), 2000):
                    u, v = a[t : t + 2000], b[t : t + 2000]
                    keep[part[t : t + 2000]] = may_link(size_of[docs[u]], flat[u], size_of[docs[v]], flat[v], percent)
    return rows[x[keep]], rows[y[keep]]


def packed_pairs(a: np.ndarray, b: np.ndarray, n: int) -> pa.Table:
    """Pairs by the bucket of their hash."""
    return pa.Table.from_batches([by_bucket(mix(a.astype(np.uint64) ^ mix(b.astype(np.uint64))), n, {"a": a, "b": b})])


def distinct_pairs(packed: DataFrame) -> DataFrame:
    """From packed_pairs(): each pair (a, b) once."""

    def merge(table: pa.Table) -> pa.Table:
        got = np.unique(np.stack([unpack(table, c, np.int64) for c in "ab"]), axis=1)
        return pa.table({"a": got[0], "b": got[1]})

    return packed.groupBy("bucket").applyInArrow(merge, "a long, b long")


PAIRS = "bucket int, a binary, b binary"


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row (the document's key), n_shingles, component_id, label (the component; null for an empty document)."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    n, cores = n_buckets(docs), 2 * docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and one for each chunk and bucket of keys."""
        cache = WordHashes()
        names = ["row", "doc_id", "n", "node", "bucket", "keys", "counts", "rows"]
        for chunk in chunks(batches):
            owner, grams = shingle_sets(column_bytes(chunk), cache, words)
            m = chunk.num_rows
            nodes, size = set_hashes(owner, grams, m)
            nil = pa.nulls(m, pa.binary())
            node = pa.array(nodes, mask=size == 0)
            yield pa.RecordBatch.from_arrays([chunk.column("row"), chunk.column("doc_id"), pa.array(size), node, pa.nulls(m, pa.int32()), nil, nil, nil], names=names)
            who, keys = cells(owner, grams, m, percent)
            first = np.zeros(m, bool)
            first[np.unique(nodes, return_index=True)[1]] = True  # equal sets of a chunk are one
            who, keys = who[first[who]], keys[first[who]]
            out = packed_entries(keys, nodes[who], n)
            gone = [pa.nulls(out.num_rows, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*gone, *out.columns], names=names)

    seen = settle(docs.mapInArrow(read, "row long, doc_id long, n long, node long, " + ENTRIES))
    packed = seen.where("bucket is not null").select("bucket", "keys", "counts", "rows")

    def thin(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield packed_once(*unpacked_entries(one), n)

    shared = repeated_keys(packed.mapInArrow(thin, "bucket int, keys binary, entries long"))
    hot = hot_buckets(shared)
    lying = probe(packed, shared, hot, n, "rows", pick_shared(n), packed_schema("keys"))
    lying = settle(gather(lying, {"keys": np.uint64}), seen, tasks=cores)
    release(shared)
    own = settle(seen.where("row is not null").select("row", "doc_id", "n", "node"))
    release(seen)

    def sets(batches):
        cache = WordHashes()
        for chunk in chunks(batches):
            owner, grams = shingle_sets(column_bytes(chunk), cache, words)
            edges = np.searchsorted(owner, np.arange(chunk.num_rows + 1))
            parts = [grams[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            cols = [pa.array([len(p) for p in parts], pa.int64()), pa.array([bitmap(p) for p in parts]), pa.array([p.tobytes() for p in parts])]
            yield pa.RecordBatch.from_arrays([chunk.column("node"), *cols], names=["row", "n", "map", "set"])

    one = own.groupBy("node").agg(F.min("row").alias("row")).join(lying.select(F.col("row").alias("node")), "node")
    held = docs.join(one, "row").dropDuplicates(["row"]).select("node", "text")  # dealt by row already: texts are shuffled once
    held = settle(held.mapInArrow(sets, "row long, n long, map binary, set binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Bounded by sizes and bitmaps first, so that sets are read for pairs that pass only."""

        def beside(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
            for x in "ab":
                pairs = pairs.join(held.select(F.col("row").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
            return pairs

        maybe = settle(beside(pairs, ("n", "map")).mapInArrow(lambda it: bounded(it, percent), "a long, b long"), held, tasks=cores)
        found = settle(beside(maybe, ("set",)).mapInArrow(lambda it: links(it, percent), "a long, b long"), held, tasks=cores)
        release(maybe)
        return found

    def entries(labels: DataFrame | None) -> DataFrame:
        """Rows (bucket, keys, rows, labels) of all cells."""
        told = lying.withColumn("label", F.col("row")) if labels is None else lying.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))

        def spread(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, 2000):
                    part = batch.slice(s, 2000)
                    parts = [np.unique(np.frombuffer(x, np.uint64)) for x in part.column("keys").to_pylist()]
                    counts = list(map(len, parts))
                    keys = np.concatenate(parts)
                    yield by_bucket(mix(keys), n, {"keys": keys, "rows": np.repeat(part.column("row").to_numpy(), counts), "labels": np.repeat(part.column("label").to_numpy(), counts)})

        return told.select("row", "label", "keys").mapInArrow(spread, "bucket int, keys binary, rows binary, labels binary")

    def mixed_cells(spread: DataFrame, step: str) -> DataFrame:
        """For each bucket the cells with several labels: key, a chosen document, its label, and the number of documents."""

        def rank(keys, rows):
            if step in ("smallest", "largest"):
                place = rows.astype(np.uint64) ^ np.uint64(1 << 63)
                return place if step == "smallest" else ~place
            return mix(keys ^ rows.astype(np.uint64))

        def reduce(keys, rows, labels, low, high, count):
            order = np.lexsort((rank(keys, rows), keys))
            keys, rows, labels, low, high, count = (x[order] for x in (keys, rows, labels, low, high, count))
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            if not len(new):
                return keys, rows, labels, low, high, count
            return keys[new], rows[new], labels[new], np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), np.add.reduceat(count, new)

        names, kinds = ("keys", "rows", "labels", "low", "high", "count"), (np.uint64, *[np.int64] * 5)

        def thin(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    keys, rows, labels = (unpack(one, c, t) for c, t in zip(names[:3], kinds[:3], strict=True))
                    got = reduce(keys, rows, labels, labels, labels, np.ones(len(keys), np.int64))
                    yield pa.RecordBatch.from_arrays([one.column("bucket"), *(pa.array([x.tobytes()]) for x in got)], names=["bucket", *names])

        def merge(table):
            keys, rows, labels, low, high, count = reduce(*(unpack(table, c, t) for c, t in zip(names, kinds, strict=True)))
            many = low != high
            return pa.table({"bucket": table.column("bucket")[:1]} | {c: pa.array([x[many].tobytes()]) for c, x in (("cell", keys), ("chosen", rows), ("its", labels), ("count", count))})

        schema = "bucket int, " + ", ".join(f"{c} binary" for c in names)
        return settle(spread.mapInArrow(thin, schema).groupBy("bucket").applyInArrow(merge, "bucket int, cell binary, chosen binary, its binary, count binary"), spread, tasks=cores)

    def tries(spread: DataFrame, mixed: DataFrame, one_each: bool) -> DataFrame:
        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, rows, labels = unpack(left, "keys", np.uint64), unpack(left, "rows", np.int64), unpack(left, "labels", np.int64)
            cell, chosen, its = unpack(right, "cell", np.uint64), unpack(right, "chosen", np.int64), unpack(right, "its", np.int64)
            at = np.minimum(np.searchsorted(cell, keys), max(len(cell) - 1, 0))
            hit = (cell[at] == keys) & (its[at] != labels) if len(cell) else np.zeros(len(keys), bool)
            a, b = rows[hit], chosen[at[hit]] if len(cell) else rows[hit]
            got = np.unique(np.stack([a, b] if one_each else [np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return packed_pairs(got[0], got[1], n)

        pairs = distinct_pairs(probe(spread, mixed.drop("count"), hot, n, "rows", pair, PAIRS))
        # at first each set is tried with one other only: most components are found by that
        return pairs.groupBy("a").agg(F.min("b").alias("b")) if one_each else pairs

    def rest(spread: DataFrame, mixed: DataFrame) -> DataFrame:
        """The documents of cells with several labels, once for each pair of the cell's blocks that theirs is in."""

        def deal(left: pa.Table, right: pa.Table) -> pa.Table:
            keys, rows, labels = unpack(left, "keys", np.uint64), unpack(left, "rows", np.int64), unpack(left, "labels", np.int64)
            cell, count = unpack(right, "cell", np.uint64), unpack(right, "count", np.int64)
            at = np.minimum(np.searchsorted(cell, keys), max(len(cell) - 1, 0))
            hit = np.flatnonzero(cell[at] == keys) if len(cell) else np.zeros(0, int)
            blocks = -(-count[at[hit]] // IN_BLOCK) if len(hit) else hit
            mine = (mix(rows[hit].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            each = np.repeat(np.arange(len(hit)), blocks)
            other = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            m, h = mine[each], hit[each]
            side = np.where(m < other, 0, np.where(m > other, 1, 2))
            # cells of one block are compared together, bucket by bucket; larger ones block by block
            alone = blocks[each] == 1
            group = np.where(alone, (mix(keys[h]) % np.uint64(n)).astype(np.int64), keys[h].astype(np.int64))
            cols = [group, keys[h].astype(np.int64), np.minimum(m, other), np.maximum(m, other), side, rows[h], labels[h]]
            return pa.table(dict(zip(["group", "cell", "i", "j", "side", "row", "label"], cols, strict=True)))

        dealt = probe(spread, mixed.drop("chosen", "its"), hot, n, "rows", deal, "group long, cell long, i long, j long, side long, row long, label long")
        dealt = dealt.join(held.select("row", "n", "map"), "row")
        return distinct_pairs(dealt.groupBy("group", "i", "j").applyInArrow(lambda t: packed_pairs(*compare_cells(t, percent), n), PAIRS))

    found, inputs, labels = None, [], None
    for step in ("smallest", "largest", "drawn", "all"):
        spread = settle(entries(labels))
        mixed = mixed_cells(spread, step)
        if mixed.where(F.length("cell") > 0).limit(1).count():
            new = verified(rest(spread, mixed) if step == "all" else tries(spread, mixed, step != "drawn"))
            found = new if found is None else found.unionByName(new)
            inputs.append(new)
            labels = connected_components(found, *inputs)
        release(spread, mixed)
        if labels is None:
            break
    release(held, lying)  # all that is read below are own and the labels
    out = own.withColumnRenamed("n", "n_shingles")
    if labels is None:
        out = out.withColumn("label", F.col("node"))
    else:
        out = out.join(labels.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").withColumn("label", F.coalesce("label", "node"))
    least = out.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = out.join(least.withColumnRenamed("label", "its"), F.col("label") == F.col("its"), "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "label")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but the first document of each component (the smallest doc_id; a null one only
    where there is no other); of repeated rows one stays. Documents without words are no copies of others."""
    groups = join(docs, words, percent)
    first = groups.where("label is not null").groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)), "row"))["row"].alias("__row"))
    stay = first.select("__row").unionByName(groups.where("label is null").select(F.col("row").alias("__row"))).distinct()
    kept = docs.withColumn("__row", row_key()).join(stay, "__row", "left_semi")
    return kept.dropDuplicates(["__row"]).select(*docs.columns)
