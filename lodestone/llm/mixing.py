"""Mixing sources to target weights by systematic sampling.

Each document of a source with target t and size s is expected t / s times. Documents of a source
stand in a line ordered by size; the running sum of expected copies, plus one offset for the source
drawn from the seed, is cut at the integers, and a document is emitted once for each integer that
its interval crosses. Ordering by size makes the sample even over sizes, so that the words taken
come near the target.

The line is laid without sorting a source in one task: a document's place is the number of documents
in earlier cells (source, size class, salt), from a table of cell counts, plus its number in its own
cell. Cells stay small when one source holds most rows.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a
null doc_id is ordered before others; repeated rows are separate documents; an empty table gives no
rows. Documents of a source of size 0 are never taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Salts of a (source, size class) cell.
SALTS = 32
#: Size classes for each doubling of the size.
CLASSES = 8


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """From (source, source_size): adds weight and target.

    A source stops at ``most`` times its size and the rest is shared by weight again. The level at
    which that ends is found in one pass: sources fill up in the order of size / weight, so the
    level after the first k are full is (share * total - most * their sizes) / the other weights,
    and it holds from the first k whose next source isn't full at it. The table has a row for each
    source, which is what the unpartitioned windows read.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("n").asc())
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    full = F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * F.lit(most)
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - full) / rest
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * F.lit(most)
    return (
        sizes.withColumn("n", F.row_number().over(in_order))
        .withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("filled", F.row_number().over(by_fill))
        .withColumn("final", F.min(F.when(fits, F.struct("filled", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("source_size") * F.lit(most)), F.col("source_size") * F.lit(most)))
        .select("source", "source_size", "weight", "target")
    )


def plan(docs: DataFrame, keep: list[str], seed: int = 42, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The columns ``keep`` of docs, with size, source_size, target and copies."""
    docs = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), "source", _size().alias("size"))
    cell = F.floor(F.log2(F.col("size") + 1) * CLASSES).cast("int")
    docs = docs.withColumn("cell", cell).withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALTS)).cast("int"))
    cells = docs.groupBy("source", "cell", "salt").agg(F.sum("size").alias("cell_size"), F.count(F.lit(1)).alias("cell_rows"))
    goal = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most)
    line = Window.partitionBy("source").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_rows").over(line), F.lit(0)))
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    cells = cells.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    cells = cells.select(F.struct("source", "cell", "salt").alias("at"), "before", "source_size", "target")
    own = Window.partitionBy("source", "cell", "salt").orderBy("size", "id", "row")  # what is kept decides ties, so that reruns agree
    docs = docs.withColumn("k", F.row_number().over(own))
    docs = docs.join(cells, F.struct("source", "cell", "salt") == F.col("at"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.col("before") + F.col("k")
    # rounded, as a ratio such as 2 must not lose a copy to the last bit
    crossed = F.floor(F.round(place * expected + offset, 9)) - F.floor(F.round((place - 1) * expected + offset, 9))
    return docs.select("row.*", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix_counts(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) and copies."""
    out = plan(docs, ["doc_id"], seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of docs.

    The text doesn't go through the shuffle that numbers documents: the few columns that decide do,
    and the copies come back to the row by its key."""
    from lodestone.llm.shared import row_key

    keyed = docs.withColumn("__key", row_key())
    counts = plan(docs.withColumn("__key", row_key()), ["__key"], seed)
    # repeated rows share a key and may be taken a different number of times: their sum is emitted
    counts = counts.groupBy("__key").agg(F.sum("copies").alias("__copies"))
    once = keyed.dropDuplicates(["__key"])
    out = once.join(counts, "__key").where("__copies > 0")
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
