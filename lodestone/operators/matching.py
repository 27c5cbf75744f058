"""Comparing candidate records, and linking matches to clusters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.similarity import normalised_levenshtein, token_jaccard
from lodestone.operators.blocking import lsh_pairs, neighbourhood_pairs
from lodestone.operators.components import connected_components


@dataclass(frozen=True)
class Field:
    """A field's share of the similarity; ``similarity`` makes a Column of two Columns (a pandas_udf is one, too)."""

    name: str
    weight: float
    similarity: Callable[[Column, Column], Column]


DEFAULT = (Field("name", 0.6, normalised_levenshtein), Field("city", 0.4, token_jaccard))


class Matcher:
    def __init__(self, fields=None, threshold: float = 0.7):
        fields = list(fields or DEFAULT)
        total = sum(f.weight for f in fields)
        self.fields = [Field(f.name, f.weight / total, f.similarity) if total > 0 else f for f in fields]
        self.threshold = threshold

    def compare(self, records: DataFrame, pairs: DataFrame) -> DataFrame:
        """id1, id2, similarity, field_scores, is_match for each pair whose records are known; a missing field is ""."""
        names = [f.name for f in self.fields]
        text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
        side = lambda k: records.select(F.col("record_id").alias(f"id{k}"), *[text(c).alias(f"{c}_{k}") for c in names])
        joined = pairs.select("id1", "id2").join(side(1), "id1").join(side(2), "id2")
        scores = {f.name: f.similarity(F.col(f"{f.name}_1"), F.col(f"{f.name}_2")) for f in self.fields}
        joined = joined.select("id1", "id2", *[s.alias(f"s_{n}") for n, s in scores.items()])
        similarity = reduce(lambda acc, f: acc + F.lit(f.weight) * F.col(f"s_{f.name}"), self.fields, F.lit(0.0))
        table = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"s_{n}"))])
        out = joined.select("id1", "id2", similarity.alias("similarity"), table.alias("field_scores"))
        return out.withColumn("is_match", F.col("similarity") >= self.threshold)

    def match(self, records: DataFrame, pairs: DataFrame) -> DataFrame:
        return self.compare(records, pairs).where("is_match")


def cluster_labels(records: DataFrame, matches: DataFrame) -> DataFrame:
    """record_id and canonical_id, the smallest of its cluster; a record without matches is its own."""
    labels = connected_components(matches.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    ids = records.select("record_id").distinct()
    return ids.join(labels.withColumnRenamed("node", "record_id"), "record_id", "left").select("record_id", F.coalesce("label", "record_id").alias("canonical_id"))


def link(records: DataFrame, matcher: Matcher | None = None, method: str = "lsh", hashes: int = 100, bands: int = 10, window: int = 5) -> DataFrame:
    """canonical_id, member_ids (ordered) and the matches within, a row for each cluster."""
    matcher = matcher or Matcher()
    pairs = lsh_pairs(records, hashes, bands) if method == "lsh" else neighbourhood_pairs(records, window)
    matches = matcher.match(records, pairs)
    labels = cluster_labels(records, matches)
    members = labels.groupBy("canonical_id").agg(F.sort_array(F.collect_list("record_id")).alias("member_ids"))
    inside = matches.join(labels.withColumnRenamed("record_id", "id1"), "id1").groupBy("canonical_id")
    inside = inside.agg(F.sort_array(F.collect_list(F.struct("id1", "id2", "similarity"))).alias("matches"))
    return members.join(inside, "canonical_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast(inside.schema["matches"].dataType)))


def link_statistics(clusters: DataFrame) -> DataFrame:
    size = F.size("member_ids").cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return clusters.agg(
        F.count(F.lit(1)).alias("total_clusters"), F.count_if(size == 1).alias("singletons"),
        zero(F.max(size)).alias("max_cluster_size"), zero(F.sum(size)).alias("total_records"),
    )
