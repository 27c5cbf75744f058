"""LM scoring by context-tree weighting over bytes, beside a smoothed unigram score.

Tokens are the words of a text after lower-casing A-Z, and one end. A text is spelt as its tokens, a
space after each, and a line feed for the end; the context of a byte is the ``DEPTH`` bytes before it, across
tokens, and a line feed before the first. Each byte is eight binary decisions. At every context node of
every depth, from none to ``DEPTH`` bytes, the Krichevsky-Trofimov estimate of the decision is mixed with
the weighted estimate of its children: P(s) = KT(s) / 2 + (product of the children's P) / 2. The counts come
from the training texts; a text's probability is the product of the mixed estimates, counts held fixed. A
context that training hasn't seen leaves the estimate to the longest one that it has.

The spelt texts are kept in chunks. Each chunk's distinct events (context, byte) are counted and dealt by
their hash, so a frequent context is spread over all buckets, and merged to one table of events. The
tree is dealt by the ``LOW`` nearest bytes of the context: what lies below such a node is weighed in one
task, and the driver has the nodes above alone, 256 x 256 at most. The ``HEAD_EVENTS`` most frequent events
are broadcast with their costs; each chunk asks the buckets for its others' and sums them for its texts.
Costs travel as 32-bit floats. For the base, the ``HEAD``
most frequent tokens are broadcast with their counts; the others meet the token table in a join by hash bucket.

Defined cases: a null text is empty and has its end alone; a null doc_id is in training; repeated
rows count as often as they stand; an empty table gives no rows; texts of any length are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import by_bucket, chunks, column_bytes, mix, probe, release, settle, unpack

DEPTH, LOW, HEAD = 6, 2, 80_000
END = b"\n"
#: Distinct tokens that a task gathers before it passes them on, and in a bucket of the token table.
GATHERED, IN_BUCKET = 300_000, 400_000
#: Bytes of text in a chunk, and for each bucket of events and part of the tree.
IN_CHUNK, IN_EVENTS = 3 << 20, 8 << 20
#: Frequent events that are broadcast with their costs, at most.
HEAD_EVENTS = 1 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5, by Stirling's series at x + 8."""
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        out -= np.log(x + k)
    return out


def text_events(spelt: bytes, ends: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Keys of all bytes of the texts that end at ``ends``: context in the high bytes with the nearest lowest, then the byte."""
    # the eight bytes up to each position, read as one number
    key = np.ndarray(len(spelt), ">u8", bytes(7) + spelt, strides=(1,)).astype(np.uint64)
    key &= np.uint64((1 << 8 * (depth + 1)) - 1)
    starts = (np.concatenate([[0], ends[:-1]]) if len(ends) else ends).astype(np.int64)
    for k in range(depth):  # a text's k-th byte has k of its own bytes before it
        at = starts + k
        at = at[at < ends]
        key[at] = key[at] & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(END[0] << 8 * (k + 1))
    return key


#: log_gamma of n + 1/2 and of n + 1 for the usual counts.
_SMALL = [log_gamma(np.arange(4096) + shift) for shift in (0.5, 1.0)]


def _log_gamma(n: np.ndarray, k: int) -> np.ndarray:
    small = n < 4096
    out = _SMALL[k][np.where(small, n, 0).astype(np.int64)]
    if not small.all():
        out[~small] = log_gamma(n[~small] + (0.5, 1.0)[k])
    return out


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Of whole numbers of zeros and ones."""
    return _log_gamma(zeros, 0) + _log_gamma(ones, 0) - _log_gamma(zeros + ones, 1) - np.log(np.pi)


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct value, ascending, and the number of each element's value."""
    order = np.argsort(x)
    at = _firsts(x[order])
    which = np.empty(len(x), np.int64)
    which[order] = np.repeat(np.arange(len(at)), np.diff(at, append=len(x)))
    return order[at], which


def _decision(keys: np.ndarray, n: np.ndarray, j: int, low: int, depth: int):
    """Decision j of each event: prefix and bit; for each depth from low on the node of each event, the nodes' counts,
    KT estimates and products below; and the lowest depth's weighted estimates and first events."""
    sym, ctx = (keys & np.uint64(255)).astype(np.int64), keys >> np.uint64(8)
    prefix = np.uint64(1 << j) | (sym >> (8 - j)).astype(np.uint64)
    bit = (sym >> (7 - j)) & 1
    inv, first, n0, n1, kt = [], [], [], [], []
    for d in range(low, depth + 1):
        mask = np.uint64((1 << (8 * d)) - 1)
        at, which = _groups(((ctx & mask) << np.uint64(8)) | prefix)
        ones, zeros = (np.bincount(which, n * b, len(at)) for b in (bit, 1 - bit))
        inv.append(which)
        first.append(at)
        n0.append(zeros)
        n1.append(ones)
        kt.append(_kt(zeros, ones))
    weighted, below = kt[-1], [None] * len(kt)
    for d in range(len(kt) - 2, -1, -1):
        below[d] = np.bincount(inv[d][first[d + 1]], weighted, len(kt[d]))
        weighted = np.logaddexp(kt[d], below[d]) - np.log(2)
    return prefix, bit, inv, n0, n1, kt, below, weighted, first[0]


def weigh(keys: np.ndarray, n: np.ndarray, depth: int, top: list | None = None) -> np.ndarray:
    """log10 of the mixed probability of each event, given the counts of all; or, with the nodes above ``LOW`` as
    ``crown`` has them, given the counts of all events that share the LOW nearest bytes with one of these."""
    ctx, low = keys >> np.uint64(8), 0 if top is None else LOW
    out = np.zeros(len(keys))
    for j in range(8):
        prefix, bit, inv, n0, n1, kt, below, _, _ = _decision(keys, n, j, low, depth)
        p, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for d in range(depth, -1, -1):
            if d < low:
                a, b, own_share = (x[((ctx & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | prefix] for x in top[d])
            else:
                k = d - low
                a, b = n0[k][inv[k]], n1[k][inv[k]]
                own_share = 1.0 if d == depth else 1 / (1 + np.exp(np.clip(below[k] - kt[k], -700, 700)))[inv[k]]
            own = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1)
            p, seen = np.where(seen, own_share * own + (1 - own_share) * p, own), a + b > 0
        out += np.log10(p)
    return out


def roots(keys: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Of all events that share the LOW nearest bytes: counts (zeros, ones) of the nodes one depth above, and the
    product below them; a node's place is its context and prefix."""
    out = np.zeros((3, 256**LOW))
    for j in range(8):
        prefix, _, _, n0, n1, _, _, weighted, first = _decision(keys, n, j, LOW, depth)
        node = ((((keys >> np.uint64(8)) & np.uint64(256 ** (LOW - 1) - 1)) << np.uint64(8)) | prefix)[first].astype(np.int64)
        out += [np.bincount(node, x, out.shape[1]) for x in (n0[0], n1[0], weighted)]
    return out


def crown(sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the sum of all roots(): counts and the share of the own estimate, for each depth under LOW."""
    out = []
    for _ in range(LOW):
        zeros, ones, below = sums
        kt = _kt(zeros, ones)
        out.insert(0, (zeros, ones, 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))))
        weighted = np.where(zeros + ones > 0, np.logaddexp(kt, below) - np.log(2), 0.0)
        if len(zeros) > 256:  # the farthest byte is the highest
            sums = np.stack([x.reshape(256, -1).sum(0) for x in (zeros, ones, weighted)])
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens with their number in training documents and in all."""
    train, other = Counter(), Counter()

    def flush():
        words = list(train.keys() | other.keys())
        c = np.fromiter((train.get(w, 0) for w in words), np.int64, len(words))
        t = c + np.fromiter((other.get(w, 0) for w in words), np.int64, len(words))
        train.clear()
        other.clear()
        for k in range(0, len(words), 50_000):
            s = slice(k, k + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(words[s], pa.binary()), pa.array(c[s]), pa.array(t[s])], names=["word", "c", "total"])

    for _, spelt, ends, held, _ in _chunks(batches):
        for tokens, out in zip(_split(spelt, ends), held.tolist(), strict=True):
            (other if out else train).update(tokens)
        if len(train) + len(other) > GATHERED:
            yield from flush()
    if train or other:
        yield from flush()


_CHUNK = "chunk long, spelt binary, sizes binary, held binary, doc_ids array<long>"
_BASE = "uid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, bucket int, hashes binary, uids binary"


def _pressed(raw: bytes) -> bytes:
    return pa.compress(raw, "zstd", asbytes=True)


def _raw(pressed: bytes, size: int) -> bytes:
    return pa.decompress(pressed, size, "zstd", asbytes=True)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, byte by byte, compressed."""
    return _pressed(x.view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes())


def _numbers(table: pa.Table, name: str, kind: type, width: int) -> list[np.ndarray]:
    """The numbers of each row of a packed column, of which the column m has the count."""
    out = []
    for raw, m in zip(table.column(name).to_pylist(), table.column("m").to_pylist(), strict=True):
        x = np.zeros((m, np.dtype(kind).itemsize), np.uint8)
        x[:, :width] = np.frombuffer(_raw(raw, m * width), np.uint8).reshape(width, m).T
        out.append(x.reshape(-1).view(kind))
    return out


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: its texts spelt one after the other, their sizes, and whether they are held out."""
    number = TaskContext.get().partitionId() << 20
    for chunk in chunks(batches, most=IN_CHUNK):
        texts = [b" ".join([*raw.lower().split(), END]) if raw else END for raw in column_bytes(chunk)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        held = chunk.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        cells = [[number], [_pressed(b"".join(texts))], [sizes.tobytes()], [held.tobytes()], [chunk.column("doc_id").to_pylist()]]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["chunk", "spelt", "sizes", "held", "doc_ids"])
        number += 1


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Chunk, spelt texts, where each ends, held out, doc_ids; one chunk at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            ends = np.cumsum(np.frombuffer(row["sizes"].as_py(), np.int64))
            held = np.frombuffer(row["held"].as_py(), bool) if "held" in row else None
            yield row["chunk"].as_py(), _raw(row["spelt"].as_py(), int(ends[-1])), ends, held, row["doc_ids"].values if "doc_ids" in row else None


def _split(spelt: bytes, ends: np.ndarray) -> list[list[bytes]]:
    cuts = ends.tolist()
    return [[*spelt[a : b - 1].split(), END] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def _dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets that events fall in, ascending, and the places of each bucket's events.

    Dealt by the four farthest bytes: neighbours in order stay together and compress, and no such group is large."""
    bucket = (mix(keys >> np.uint64(24)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = _firsts(bucket[order])
    return bucket[order][at], np.split(order, at[1:])


def _count(n_buckets: int):
    def count(batches):
        """The distinct events of each chunk with their number in training, by bucket."""
        for _, spelt, ends, held, _ in _chunks(batches):
            x = text_events(spelt, ends)
            x <<= np.uint64(1)
            x |= np.repeat(~held, np.diff(ends, prepend=0)).view(np.uint8)
            x.sort()
            trained = (x & np.uint64(1)).astype(np.uint32)
            x >>= np.uint64(1)
            at = _firsts(x)
            n, found = np.add.reduceat(trained, at, dtype=np.uint32), x[at]
            bucket, parts = _dealt(found, n_buckets)
            columns = [[_planes(found[p], 7) for p in parts], [_planes(n[p], 4) for p in parts], list(map(len, parts))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *map(pa.array, columns)], names=["bucket", "keys", "n", "m"])

    return count


def _merge(n_trees: int):
    def merge(table: pa.Table) -> pa.Table:
        """Each event of a bucket once, by part of the tree."""
        keys, n = np.concatenate(_numbers(table, "keys", np.uint64, 7)), np.concatenate(_numbers(table, "n", np.uint32, 4))
        order = np.argsort(keys)
        keys = keys[order]
        at = _firsts(keys)
        out = {"keys": keys[at], "n": np.add.reduceat(n[order].astype(float), at)}
        out = by_bucket(mix((out["keys"] >> np.uint64(8)) & np.uint64(256**LOW - 1)), n_trees, out)
        tree = out.column("bucket")
        return pa.table({"tree": tree, "bucket": pa.repeat(table.column("bucket")[0], out.num_rows), "keys": out.column("keys"), "n": out.column("n")})

    return merge


def _bits(n: np.ndarray) -> np.ndarray:
    return np.frexp(n)[1]


def _roots(table: pa.Table) -> pa.Table:
    """The part's roots(); and, as nodes -1 - b, how many of its events have counts of b bits."""
    n = unpack(table, "n", float)
    sums = roots(unpack(table, "keys", np.uint64), n, DEPTH)
    node, of_bits = np.flatnonzero(sums.any(0)), np.bincount(_bits(n), minlength=1)
    many = np.concatenate([node, -1 - np.arange(len(of_bits))]).astype(np.int32)
    rest = np.zeros((3, len(of_bits)))
    rest[0] = of_bits
    return pa.table({"node": pa.array(many)} | {name: x for name, x in zip(("zeros", "ones", "below"), np.concatenate([sums[:, node], rest], 1), strict=True)})


def _least(many: dict[int, float], most: int, lowest: int) -> int:
    """From how many things are of each grade: the least grade such that at most ``most`` are of it or higher."""
    least, seen = max(many, default=lowest) + 1, 0
    while least > lowest and seen + many.get(least - 1, 0) <= most:
        least -= 1
        seen += many.get(least, 0)
    return least


def text_costs(spelt: DataFrame, n_bytes: int) -> DataFrame:
    """uid and lp, the log10 probability, of each text of the chunks."""
    n = max(8, n_bytes // IN_EVENTS)
    counted = spelt.select("chunk", "spelt", "sizes", "held").mapInArrow(_count(n), "bucket int, keys binary, n binary, m long")
    events = settle(counted.groupBy("bucket").applyInArrow(_merge(n), "tree int, bucket int, keys binary, n binary"))
    sums = np.zeros((3, 256**LOW))
    nodes = events.groupBy("tree").applyInArrow(_roots, "node int, zeros double, ones double, below double")
    nodes = nodes.groupBy("node").agg(*[F.sum(x).alias(x) for x in ("zeros", "ones", "below")]).toPandas()  # 256 ** LOW rows at most
    least = _least({-1 - int(k): v for k, v in zip(nodes["node"], nodes["zeros"], strict=True) if k < 0}, HEAD_EVENTS, 1)
    nodes = nodes[nodes["node"] >= 0]
    sums[:, nodes["node"].to_numpy(int)] = nodes[["zeros", "ones", "below"]].to_numpy(float).T
    top = spelt.sparkSession.sparkContext.broadcast(crown(sums))

    def weighed(table: pa.Table) -> pa.Table:
        """The costs of all events: the frequent ones as bucket -1, the others by bucket."""
        keys, n = unpack(table, "keys", np.uint64), unpack(table, "n", float)
        logs = weigh(keys, n, DEPTH, top.value).astype(np.float32)
        head = _bits(n) >= least
        owner = np.repeat(np.arange(table.num_rows), [len(k) // 8 for k in table.column("keys").to_pylist()])
        parts = [np.flatnonzero(head), *(p[~head[p]] for p in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(owner)) + 1))]
        columns = [[-1, *table.column("bucket").to_pylist()], [keys[p].tobytes() for p in parts], [logs[p].tobytes() for p in parts]]
        types = zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in types], names=["bucket", "keys", "logs"])

    costs = settle(events.groupBy("tree").applyInArrow(weighed, "bucket int, keys binary, logs binary"))
    release(events)
    known = costs.where("bucket = -1").toArrow()  # HEAD_EVENTS events at most
    keys, logs = unpack(known, "keys", np.uint64), unpack(known, "logs", np.float32)
    order = np.argsort(keys)
    head = spelt.sparkSession.sparkContext.broadcast((keys[order], logs[order]))

    def frequent(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted events are broadcast, and their costs."""
        keys, logs = head.value
        at = np.searchsorted(keys, found) if len(keys) else np.zeros(len(found), np.int64)
        at[at == len(keys)] = 0
        hit = keys[at] == found if len(keys) else np.zeros(len(found), bool)
        return hit, logs[at[hit]]

    def ask(batches):
        """The distinct events of each chunk, by bucket."""
        for chunk, text, ends, _, _ in _chunks(batches):
            x = text_events(text, ends)
            x.sort()
            found = x[_firsts(x)]
            found = found[~frequent(found)[0]]
            if not len(found):
                continue
            bucket, parts = _dealt(found, n)
            columns = [[chunk] * len(parts), [_planes(found[p], 7) for p in parts], list(map(len, parts))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *map(pa.array, columns)], names=["bucket", "chunk", "keys", "m"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """The costs of asked events, in their order."""
        if not left.num_rows:  # all of the bucket's events are broadcast
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "logs": pa.array([], pa.binary()), "m": pa.array([], pa.int64())})
        keys, logs = unpack(right, "keys", np.uint64), unpack(right, "logs", np.float32)
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        got = [_planes(logs[np.searchsorted(keys, k)], 4) for k in _numbers(left, "keys", np.uint64, 7)]
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "logs": pa.array(got, pa.binary()), "m": left.column("m")})

    def cost(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over the bytes of each text."""
        given = dict(zip(right.column("bucket").to_pylist(), _numbers(right, "logs", np.float32, 4), strict=True))
        chunk, text, ends, _, _ = next(_chunks(left.combine_chunks().to_batches()))
        x = text_events(text, ends)
        order = np.argsort(x)
        x = x[order]
        at = _firsts(x)
        logs = np.zeros(len(at))
        hit, usual = frequent(x[at])
        logs[hit] = usual
        rest = np.flatnonzero(~hit)
        if len(rest):
            for b, p in zip(*_dealt(x[at[rest]], n), strict=True):
                logs[rest[p]] = given[int(b)]
        each = np.empty(len(x))
        each[order] = np.repeat(logs, np.diff(at, append=len(x)))
        return pa.table({"uid": (chunk << 24) + np.arange(len(ends)), "lp": np.add.reduceat(each, ends - np.diff(ends, prepend=0))})

    texts = spelt.select("chunk", "spelt", "sizes")
    asked = texts.mapInArrow(ask, "bucket int, chunk long, keys binary, m long")
    answers = asked.groupBy("bucket").cogroup(costs.where("bucket >= 0").groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, logs binary, m long")
    out = settle(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cost, "uid long, lp double"))
    release(costs)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the code length: bits_per_byte of the spelt text."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out"))
    spelt = settle(docs.mapInArrow(_spell, _CHUNK))
    vocabulary = spelt.select("chunk", "spelt", "sizes", "held").mapInArrow(_gather, "word binary, c long, total long")
    vocabulary = settle(vocabulary.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total")))
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("total"), F.lit(0)).alias("seen")).first()
    n_train, whole = sums["n"], sums["n"] + 0.5 * (sums["v"] + 1)
    n_buckets = max(8, -(-sums["all"] // IN_BUCKET), sums["seen"] // (20 * IN_BUCKET))
    grade = F.floor(F.log2("total") * 8)
    least = _least({r["grade"]: r["count"] for r in vocabulary.groupBy(grade.alias("grade")).count().collect()}, HEAD, 0)
    top = vocabulary.where(grade >= least).select("word", "c").toPandas()  # HEAD rows at most
    place = {bytes(w): i for i, w in enumerate(top["word"])}
    base = lambda c: np.log10((c + 0.5) / whole)
    head = spark.sparkContext.broadcast((place, base(top["c"].to_numpy(float)), top["c"].to_numpy() > 0))

    def read(batches):
        """A row for each document with the sums over frequent tokens, and one for each chunk and bucket with the others."""
        place, logs, known = head.value
        get, names = place.get, [x.split()[0] for x in _BASE.split(", ")]
        logs, known = np.append(logs, 0.0), np.append(known, False)
        for chunk, spelt, ends, held, ids in _chunks(batches):
            lists = _split(spelt, ends)
            n = len(lists)
            sizes = np.fromiter(map(len, lists), np.int64, n)
            flat = [w for ws in lists for w in ws]
            at = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            starts = np.cumsum(sizes) - sizes
            uids = (chunk << 24) + np.arange(n)
            rare = np.flatnonzero(at < 0)
            k, sums = (np.add.reduceat(x, starts) for x in (known[at].astype(np.int64), logs[at]))
            nil = pa.nulls(n, pa.binary())
            numbers = (sizes, np.diff(ends, prepend=0), k, sums)
            yield pa.RecordBatch.from_arrays([pa.array(uids), ids, pa.array(held), *map(pa.array, numbers), pa.nulls(n, pa.int32()), nil, nil], names=names)
            if len(rare):
                h = np.fromiter((xxhash.xxh3_64_intdigest(flat[i]) for i in rare.tolist()), np.uint64, len(rare))
                own = uids[np.searchsorted(starts, rare, "right") - 1]
                bucket = (h % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=n_buckets))
                parts = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                m = len(parts)
                gone = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*gone, pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([h[p].tobytes() for p in parts]), pa.array([own[p].tobytes() for p in parts])], names=names
                )

    done = settle(spelt.mapInArrow(read, _BASE))

    def table(batches):
        """The token table's rows of a partition as one row for each bucket and batch."""
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            bucket = (h % np.uint64(n_buckets)).astype(np.int32)
            for b in np.unique(bucket):
                rows = np.flatnonzero(bucket == b)
                rows = rows[np.argsort(h[rows])]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x[rows].tobytes()]) for x in (h, c))], names=["bucket", "h", "c"])

    index = vocabulary.select("word", "c").mapInArrow(table, "bucket int, h binary, c binary")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        h, c = (np.concatenate([np.frombuffer(x, t) for x in right.column(n).to_pylist()] or [np.zeros(0, t)]) for n, t in (("h", np.uint64), ("c", np.int64)))
        order = np.argsort(h)
        h, logs, known = h[order], base(c[order]), c[order] > 0
        out = []
        for hashes, uids in zip(left.column("hashes"), left.column("uids"), strict=True):
            at = np.searchsorted(h, np.frombuffer(hashes.as_buffer(), np.uint64))
            uid, which = np.unique(np.frombuffer(uids.as_buffer(), np.int64), return_inverse=True)
            out.append((uid, *(np.bincount(which, x[at], len(uid)) for x in (known, logs))))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0)] * 3
        return pa.table({"uid": pa.array(cols[0].astype(np.int64)), "k": pa.array(cols[1].astype(np.int64)), "b": cols[2]})

    rare = probe(done.where("bucket is not null").select("bucket", "hashes", "uids"), index, {}, n_buckets, "uids", meet, "uid long, k long, b double")
    rare = rare.groupBy("uid").agg(*[F.sum(x).alias(x) for x in "kb"])
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    rows = settle(done.where("uid is not null").join(rare, "uid", "left").select(
        "uid", "doc_id", "held_out", "n_tokens", "n_bytes", plus("known", "k").alias("n_known"), plus("base", "b").alias("base_score")
    ))
    release(vocabulary, done)
    costs = text_costs(spelt, rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    release(spelt)
    return rows.join(costs, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", F.col("lp").alias("score"),
        (-F.col("lp") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
