"""Candidate pairs of records: MinHash with banding, and sorted neighbourhoods.

A record table has record_id and string columns (its fields, in order)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.similarity import tokens
from lodestone.plans.lineage import settle

PRIME = (1 << 31) - 1
#: Seed of the hash family; it fixes the signatures.
FAMILY = 42


def fields_of(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c not in ("record_id", "ordinal")]


def record_tokens(records: DataFrame, field: str | None = None) -> Column:
    """The token set of a field, or of all if there is no field of that name."""
    names = fields_of(records)
    names = [field] if field in names else names
    return tokens(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in names]))


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(FAMILY)
    return draw.randint(1, PRIME, size=n).astype(np.int64), draw.randint(0, PRIME, size=n).astype(np.int64)


def signatures(records: DataFrame, n: int = 100, field: str | None = None) -> DataFrame:
    """record_id and signature: for each hash function the least value over the tokens, 0 without tokens.

    A token's md5 is taken once for each worker and batch; the functions are applied as one array product."""
    a, b = hash_family(n)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known: dict[str, int] = {}
            out = []
            for ts in frame["tokens"]:
                h = np.array([known.setdefault(t, int.from_bytes(hashlib.md5(t.encode()).digest()) % PRIME) if t not in known else known[t] for t in ts], np.int64)
                least = np.full(n, PRIME, np.int64)
                for s in range(0, len(h), 4096):
                    least = np.minimum(least, ((a[:, None] * h[None, s : s + 4096] + b[:, None]) % PRIME).min(1))
                out.append(least if len(h) else np.zeros(n, np.int64))
            yield pd.DataFrame({"record_id": frame["record_id"], "signature": out})

    kind = records.schema["record_id"].dataType.simpleString()
    return records.select("record_id", record_tokens(records, field).alias("tokens")).mapInPandas(sign, f"record_id {kind}, signature array<long>")


def lsh_pairs(records: DataFrame, n: int = 100, bands: int = 10, field: str | None = None) -> DataFrame:
    """id1 < id2 of records that agree on a band of their signatures. Of rows with one record_id the last in order counts."""
    if n % bands:
        raise ValueError("the number of hashes must be a multiple of the number of bands")
    rows = n // bands
    if "ordinal" in records.columns:
        last = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("ordinal")))
        records = records.withColumn("__last", last).where("__last = 1").drop("__last", "ordinal")
    signed = signatures(records, n, field)
    slices = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.xxhash64(F.slice("signature", k * rows + 1, rows)).alias("hash"), F.slice("signature", k * rows + 1, rows).alias("key")))
    banded = signed.select("record_id", F.explode(slices).alias("x")).select("record_id", "x.*")
    left, right = banded.withColumnRenamed("record_id", "id1"), banded.withColumnRenamed("record_id", "id2")
    return left.join(right, ["band", "hash", "key"]).where("id1 < id2").select("id1", "id2").distinct()


def default_key(records: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields_of(records)]))


def neighbourhood_pairs(records: DataFrame, window: int = 5, key: Column | None = None, ordinal: str = "record_id") -> DataFrame:
    """Pairs of records less than window places apart in the order of key, ties in the order of ordinal.

    Places come from range partitions: rows are numbered within each, and a row also meets the first
    window - 1 rows of the partitions after its own; only those and the partitions' sizes are gathered,
    so nothing but these edges leaves its partition."""
    key = default_key(records) if key is None else key
    ordered = records.select(key.alias("k"), F.col(ordinal).alias("o"), "record_id").repartitionByRange("k", "o").sortWithinPartitions("k", "o")
    ordered = settle(ordered.withColumn("part", F.spark_partition_id()))  # both branches below must see the same parts
    within = Window.partitionBy("part").orderBy("k", "o")
    ahead = F.array(*[F.lead("record_id", d).over(within) for d in range(1, window)])
    numbered = ordered.withColumn("ahead", ahead).withColumn("n", F.row_number().over(within)).withColumn("rest", F.count(F.lit(1)).over(Window.partitionBy("part")) - F.col("n"))
    inner = numbered.select("record_id", F.explode("ahead").alias("other")).where("other is not null")
    # rows near a partition's edge: the last and first window - 1 of each, few for each partition
    edge = numbered.where((F.col("n") < window) | (F.col("rest") < window - 1)).select("part", "n", "k", "o", "record_id")
    whole = Window.orderBy("part", "n")
    place = edge.withColumn("next", F.array(*[F.struct(F.lead("part", d).over(whole).alias("part"), F.lead("record_id", d).over(whole).alias("id")) for d in range(1, window)]))
    across = place.select("part", "record_id", F.explode("next").alias("x")).where("x.part is not null and x.part <> part").select("record_id", F.col("x.id").alias("other"))
    both = inner.unionByName(across)
    return both.select(F.least("record_id", "other").alias("id1"), F.greatest("record_id", "other").alias("id2")).distinct()
