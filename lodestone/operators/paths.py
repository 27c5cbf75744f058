"""Paths and neighbourhoods in a fact graph, by one join for each hop.

A level's frontier is written to the shared folder, so that plans don't grow with depth. Nodes named
"" are nodes like any other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.graph import FactGraph
from lodestone.plans.lineage import release, settle

HOP = "struct<src:string,rel:string,dst:string>"


def edges(graph: FactGraph, relations: Iterable[str] | None = None, directed: bool = True) -> DataFrame:
    """src, rel, dst; undirected edges are given both ways. relations: None for all."""
    facts = graph.facts
    if relations is not None:
        facts = facts.where(F.col("predicate").isin(list(relations)))
    out = facts.select(F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("dst"))
    if directed:
        return out
    return out.unionByName(out.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst")))


def _answer(graph: FactGraph, source: str, target: str, length: int, path=None) -> DataFrame:
    spark = graph.facts.sparkSession
    return spark.createDataFrame([(source, target, path or [], length)], f"source string, target string, path array<{HOP}>, length int").withColumn("reachable", F.col("length") >= 0)


def shortest_path(graph: FactGraph, source: str, target: str, max_depth: int = 10, relations: Iterable[str] | None = None, directed: bool = True) -> DataFrame:
    """One row: source, target, path, length (-1 if there is none) and reachable. Of several shortest paths the smallest is taken."""
    if source == target:
        return _answer(graph, source, target, 0)
    steps, spark, levels = edges(graph, relations, directed), graph.facts.sparkSession, []
    front = spark.createDataFrame([(source, [])], f"node string, path array<{HOP}>")
    seen = front.select("node")
    for depth in range(1, max_depth + 1):
        hop = F.struct("src", "rel", "dst").cast(HOP)
        ahead = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array(hop)).alias("path"))
        ahead = ahead.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        front = settle(ahead)
        levels.append(front)
        hit = front.where(F.col("node") == target).select("path").first()
        if hit or not front.limit(1).count():
            break
        seen = seen.unionByName(front.select("node"))
    release(*levels)
    return _answer(graph, source, target, depth, [tuple(h) for h in hit["path"]]) if levels and hit else _answer(graph, source, target, -1)


def reachable(graph: FactGraph, source: str, target: str, max_depth: int = 10, relations: Iterable[str] | None = None) -> bool:
    """Along directed edges."""
    if source == target:
        return True
    return bool(within(graph, source, max_depth, relations, stop=target).where(F.col("node") == target).limit(1).count())


def within(graph: FactGraph, source: str, depth: int, relations: Iterable[str] | None = None, stop: str | None = None) -> DataFrame:
    """node and distance (1 to depth) of what directed edges reach from source, source left out; ends early once stop is found."""
    spark = graph.facts.sparkSession
    out = spark.createDataFrame([], "node string, distance int")
    if depth < 1:
        return out
    steps = edges(graph, relations).select("src", "dst")
    front = spark.createDataFrame([(source,)], "node string")
    seen = front
    for d in range(1, depth + 1):
        ahead = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = settle(ahead.join(seen, "node", "left_anti"))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
        out = out.unionByName(front.withColumn("distance", F.lit(d)))
        if stop is not None and front.where(F.col("node") == stop).limit(1).count():
            break
    return out


def neighbours(graph: FactGraph, entity: str, depth: int = 1, relations: Iterable[str] | None = None) -> DataFrame:
    return within(graph, entity, depth, relations).select("node")


def simple_paths(graph: FactGraph, source: str, target: str, max_depth: int = 5, relations: Iterable[str] | None = None) -> DataFrame:
    """path and length of all paths of 1 to max_depth hops without a repeated node that end at their first sight of target."""
    spark = graph.facts.sparkSession
    found = spark.createDataFrame([], f"path array<{HOP}>, length int")
    if source == target:
        return found
    steps = edges(graph, relations)
    front = spark.createDataFrame([(source, [source], [])], f"node string, nodes array<string>, path array<{HOP}>")
    for d in range(1, max_depth + 1):
        hop = F.struct("src", "rel", "dst").cast(HOP)
        ahead = front.join(steps, (F.col("node") == F.col("src")) & ~F.array_contains("nodes", F.col("dst")))
        ahead = settle(ahead.select(F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("path", F.array(hop)).alias("path")))
        found = found.unionByName(ahead.where(F.col("node") == target).select("path", F.lit(d).alias("length")))
        front = ahead.where(F.col("node") != target)
        if not front.limit(1).count():
            break
    return found
