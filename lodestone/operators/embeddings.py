"""Translational and rotational embeddings: scores, relational training steps, prediction and evaluation.

TransE tables: entities and relations (id INT, vec ARRAY<DOUBLE>). RotatE tables: (id, re, im).
Triples: (h, r, t)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.plans.lineage import release, settle


@dataclass
class TransEConfig:
    dim: int = 128
    margin: float = 1.0
    learning_rate: float = 0.01
    norm: int = 2
    seed: int = 42

    def __post_init__(self):
        if self.norm not in (1, 2):
            raise ValueError("norm is 1 or 2")


@dataclass
class RotatEConfig:
    dim: int = 128
    margin: float = 6.0
    learning_rate: float = 0.01
    seed: int = 42
    #: The gradient of the paper, for relations too, instead of the reference's.
    paper_gradient: bool = False


@dataclass
class TrainerConfig:
    epochs: int = 100
    batch_size: int = 256
    seed: int = 42


@dataclass
class TrainResult:
    losses: list[float] = field(default_factory=list)

    @property
    def final_loss(self) -> float:
        return self.losses[-1]


def _uniform(n: int, dim: int, low: float, high: float, seed: int, name: str) -> Column:
    """dim values in [low, high) that depend on id, position, seed and name alone."""
    one = lambda k: (F.pmod(F.xxhash64("id", k, F.lit(seed), F.lit(name)), F.lit(1 << 52)) / float(1 << 52)) * (high - low) + low
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), one)


def _table(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("id"))


def _one(table: DataFrame, i: int, name: str) -> list[float] | None:
    row = table.where(F.col("id") == i).select(name).first()
    return None if row is None else list(row[0])


class TransE:
    """Vectors are read with ``entity`` and ``relation``; of no id they have none."""

    def __init__(self, entities: DataFrame, relations: DataFrame, config: TransEConfig | None = None):
        self.entities, self.relations, self.config = entities, relations, config or TransEConfig()

    @classmethod
    def initial(cls, spark: SparkSession, n_entities: int, n_relations: int, config: TransEConfig | None = None) -> TransE:
        c = config or TransEConfig()
        bound = 6 / math.sqrt(c.dim)
        ents = _table(spark, n_entities).withColumn("vec", V.normalised(_uniform(n_entities, c.dim, -bound, bound, c.seed, "e")))
        rels = _table(spark, n_relations).withColumn("vec", _uniform(n_relations, c.dim, -bound, bound, c.seed, "r"))
        return cls(settle(ents), settle(rels), c)

    def entity(self, i: int) -> list[float] | None:
        return _one(self.entities, i, "vec")

    def relation(self, i: int) -> list[float] | None:
        return _one(self.relations, i, "vec")

    def distance(self, h: Column, r: Column, t: Column) -> Column:
        gap = V.minus(V.plus(h, r), t)
        return V.l1(gap) if self.config.norm == 1 else V.l2(gap)

    def score_columns(self, h: str, r: str, t: str) -> Column:
        return -self.distance(F.col(f"{h}.vec"), F.col(f"{r}.vec"), F.col(f"{t}.vec"))

    def moved(self, h: str, r: str) -> Column:
        """Where the relation takes the head; a triple's score is the distance from there, negated."""
        return V.plus(F.col(f"{h}.vec"), F.col(f"{r}.vec"))

    def flat(self, x: str) -> Column:
        return F.col(f"{x}.vec")

    def normalise_entities(self) -> DataFrame:
        return self.entities.withColumn("vec", V.normalised("vec"))

    def step(self, batch: DataFrame) -> tuple[TransE, float]:
        """One step on rows (h, r, t, nh, nt). All reads come before all writes; gradients of one vector add up."""
        c = self.config
        rows = batch
        for at, table in (("h", self.entities), ("r", self.relations), ("t", self.entities), ("nh", self.entities), ("nt", self.entities)):
            rows = rows.join(table.select(F.col("id").alias(at), F.col("vec").alias(f"v_{at}")), at)
        good, bad = V.minus(V.plus("v_h", "v_r"), F.col("v_t")), V.minus(V.plus("v_nh", "v_r"), F.col("v_nt"))
        size = (lambda g: V.l1(g)) if c.norm == 1 else (lambda g: V.l2(g))
        rows = rows.select("h", "r", "t", "nh", "nt", good.alias("good"), bad.alias("bad"))
        rows = settle(rows.withColumn("loss", F.greatest(F.lit(0.0), c.margin + size("good") - size("bad"))))
        loss = rows.agg(F.avg("loss")).first()[0] or 0.0
        slope = (lambda g: V.scaled(g, F.lit(2.0))) if c.norm == 2 else (lambda g: F.transform(g, lambda x: F.signum(x)))
        hot = rows.where("loss > 0").select("h", "r", "t", "nh", "nt", slope("good").alias("gp"), slope("bad").alias("gn"))
        move = lambda kind, at, g, k: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("id"), V.scaled(F.col(g), F.lit(k * c.learning_rate)).alias("d"))
        # the relation takes the positive's gradient only
        moves = F.array(move("e", "h", "gp", -1.0), move("e", "t", "gp", 1.0), move("r", "r", "gp", -1.0), move("e", "nh", "gn", 1.0), move("e", "nt", "gn", -1.0))
        moved = summed(hot.select(F.explode(moves).alias("m")).select("m.*"))
        if not rows.where("loss > 0").limit(1).count():
            return self, loss
        ents = shifted(self.entities, moved, "e", "vec").withColumn("vec", V.normalised("vec"))
        new = TransE(settle(ents), settle(shifted(self.relations, moved, "r", "vec")), c)
        release(rows)
        return new, loss


def summed(moves: DataFrame) -> DataFrame:
    """kind, id and the sum of the vectors d."""
    by_place = moves.select("kind", "id", F.posexplode("d").alias("k", "x")).groupBy("kind", "id", "k").agg(F.sum("x").alias("x"))
    return by_place.groupBy("kind", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("d"))


def shifted(table: DataFrame, moved: DataFrame, kind: str, name: str) -> DataFrame:
    own = moved.where(F.col("kind") == kind).select("id", "d")
    return table.join(own, "id", "left").withColumn(name, F.when(F.col("d").isNull(), F.col(name)).otherwise(V.plus(name, "d"))).drop("d")


class RotatE:
    def __init__(self, entities: DataFrame, relations: DataFrame, config: RotatEConfig | None = None):
        self.entities, self.relations, self.config = entities, relations, config or RotatEConfig()

    @classmethod
    def initial(cls, spark: SparkSession, n_entities: int, n_relations: int, config: RotatEConfig | None = None) -> RotatE:
        c = config or RotatEConfig()
        bound = 6 / math.sqrt(c.dim)
        ents = _table(spark, n_entities).select("id", _uniform(0, c.dim, -bound, bound, c.seed, "re").alias("re"), _uniform(0, c.dim, -bound, bound, c.seed, "im").alias("im"))
        rels = _table(spark, n_relations).withColumn("phase", _uniform(0, c.dim, -math.pi, math.pi, c.seed, "phase"))
        rels = rels.select("id", F.transform("phase", lambda x: F.cos(x)).alias("re"), F.transform("phase", lambda x: F.sin(x)).alias("im"))
        return cls(settle(ents), settle(rels), c)

    def entity(self, i: int) -> list[complex] | None:
        re, im = (_one(self.entities, i, c) for c in ("re", "im"))
        return None if re is None else [complex(a, b) for a, b in zip(re, im, strict=True)]

    def gaps(self, h: str, r: str, t: str) -> tuple[Column, Column]:
        re, im = V.rotated(f"{h}.re", f"{h}.im", f"{r}.re", f"{r}.im")
        return V.minus(re, F.col(f"{t}.re")), V.minus(im, F.col(f"{t}.im"))

    def score_columns(self, h: str, r: str, t: str) -> Column:
        return -V.complex_distance(*self.gaps(h, r, t))

    def moved(self, h: str, r: str) -> Column:
        return F.concat(*V.rotated(f"{h}.re", f"{h}.im", f"{r}.re", f"{r}.im"))

    def flat(self, x: str) -> Column:
        return F.concat(F.col(f"{x}.re"), F.col(f"{x}.im"))

    def project_relations(self) -> DataFrame:
        re, im = V.on_unit_circle("re", "im")
        return self.relations.select("id", re.alias("re"), im.alias("im"))

    def relation_phases(self) -> DataFrame:
        return self.relations.select("id", V.phases("re", "im").alias("phase"))

    def step(self, batch: DataFrame) -> tuple[RotatE, float]:
        """One step on rows (h, r, t, nh, nt). As in the reference only positives move, relations don't, and both
        parts of the head move by the relation's real part; ``paper_gradient`` uses the conjugate instead."""
        c = self.config
        rows = batch
        for at, table in (("h", self.entities), ("r", self.relations), ("t", self.entities), ("nh", self.entities), ("nt", self.entities)):
            rows = rows.join(table.select(F.col("id").alias(at), F.struct("re", "im").alias(f"v_{at}")), at)
        dre, dim = self.gaps("v_h", "v_r", "v_t")
        bad = V.complex_distance(*self.gaps("v_nh", "v_r", "v_nt"))
        rows = rows.select("h", "t", "v_r", dre.alias("dre"), dim.alias("dim"), bad.alias("bad"))
        rows = settle(rows.withColumn("loss", F.greatest(F.lit(0.0), c.margin + V.complex_distance("dre", "dim") - F.col("bad"))))
        loss = rows.agg(F.avg("loss")).first()[0] or 0.0
        hot = rows.where("loss > 0")
        times = lambda a, b: F.zip_with(F.col(a), F.col(b), lambda x, y: x * y)
        if c.paper_gradient:
            g_re, g_im = V.plus(times("dre", "v_r.re"), times("dim", "v_r.im")), V.minus(times("dim", "v_r.re"), times("dre", "v_r.im"))
        else:
            g_re, g_im = times("dre", "v_r.re"), times("dim", "v_r.re")
        hot = hot.withColumn("gre", g_re).withColumn("gim", g_im)
        lr = c.learning_rate
        one = lambda kind, at, g, k: F.struct(F.lit(kind).alias("kind"), F.col(at).alias("id"), V.scaled(F.col(g), F.lit(k)).alias("d"))
        moves = F.array(one("re", "h", "gre", -lr), one("im", "h", "gim", -lr), one("re", "t", "dre", lr), one("im", "t", "dim", lr))
        moved = summed(hot.select(F.explode(moves).alias("m")).select("m.*"))
        ents = shifted(shifted(self.entities, moved, "re", "re"), moved, "im", "im")
        new = RotatE(settle(ents), self.relations, c)
        release(rows)
        return new, loss


def corrupt(triples: DataFrame, n_entities: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds nh and nt: with even chances the head or the tail is replaced by any entity. Reruns agree."""
    draw = lambda name, n: F.pmod(F.xxhash64("h", "r", "t", F.lit(epoch), F.lit(seed), F.lit(name)), F.lit(n)).cast("int")
    other, head = draw("entity", n_entities), draw("side", 2) == 0
    return triples.withColumn("nh", F.when(head, other).otherwise(F.col("h"))).withColumn("nt", F.when(head, F.col("t")).otherwise(other))


def in_batches(triples: DataFrame, size: int, seed: int, epoch: int, cells: int = 4096) -> DataFrame:
    """Adds batch: the row's place in a seeded order, by size. Rows are numbered within cells of the order, whose
    counts (a row for each of ``cells``) give where they begin, so no task sorts all rows."""
    draw = F.xxhash64("h", "r", "t", F.lit(seed), F.lit(epoch))
    dealt = triples.withColumn("__draw", draw).withColumn("__cell", F.pmod("__draw", F.lit(cells)).cast("int"))
    own = F.row_number().over(Window.partitionBy("__cell").orderBy("__draw", "h", "r", "t"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = dealt.withColumn("__place", own).join(F.broadcast(starts), "__cell")
    return placed.withColumn("batch", F.floor((F.col("__start") + F.col("__place") - 1) / size)).drop("__draw", "__cell", "__place", "__start")


def train(model, triples: DataFrame, n_entities: int, config: TrainerConfig | None = None, verbose: bool = False):
    """The trained model and its losses. Batches are stretches of a seeded order (see ``in_batches``)."""
    c = config or TrainerConfig()
    if c.epochs < 1:
        raise ValueError("at least one epoch")
    result = TrainResult()
    n = triples.count()
    for epoch in range(c.epochs):
        shuffled = settle(in_batches(corrupt(triples, n_entities, c.seed, epoch), c.batch_size, c.seed, epoch))
        losses = []
        for b in range(-(-n // c.batch_size)):
            model, loss = model.step(shuffled.where(F.col("batch") == b).drop("batch"))
            losses.append(loss)
        release(shuffled)
        result.losses.append(sum(losses) / max(len(losses), 1))
        if verbose and epoch % 10 == 0:
            print(f"epoch {epoch}: {result.losses[-1]:.4f}")
    return model, result


def _parts(table: DataFrame, name: str, kind: str) -> DataFrame:
    return table.select(F.col("id").alias(name), F.struct(*[c for c in table.columns if c != "id"]).alias(kind))


def score(model, triples: DataFrame) -> DataFrame:
    """triples with their score."""
    rows = triples.join(_parts(model.entities, "h", "_h"), "h").join(_parts(model.relations, "r", "_r"), "r").join(_parts(model.entities, "t", "_t"), "t")
    return rows.select(*triples.columns, model.score_columns("_h", "_r", "_t").alias("score"))


def triple_score(model, h: int, r: int, t: int) -> float:
    spark = model.entities.sparkSession
    return score(model, spark.createDataFrame([(h, r, t)], "h int, r int, t int")).first()["score"]


def _named(found: DataFrame, vocab: DataFrame | None, prefix: str) -> DataFrame:
    if vocab is None:
        return found.withColumn("name", F.concat(F.lit(prefix), F.col("id")))
    names = vocab.select(F.col("id"), F.col("name").alias("known"))
    return found.join(names, "id", "left").withColumn("name", F.coalesce("known", F.concat(F.lit(prefix), F.col("id")))).drop("known")


def _ranked(scored: DataFrame, top_k: int, ties: Column, vocab, prefix: str) -> DataFrame:
    best = scored.orderBy(F.desc("score"), ties).limit(top_k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), ties)))  # top_k rows
    return _named(best, vocab, prefix).select("id", "name", "score", "rank")


def _against(model, fixed: dict[str, tuple[str, int]], table: DataFrame) -> DataFrame:
    """The rows of table beside the one row of each fixed part (at most two rows are broadcast)."""
    out = table.select("id", F.struct(*[c for c in table.columns if c != "id"]).alias("_x"))
    for kind, (which, i) in fixed.items():
        one = getattr(model, which).where(F.col("id") == i)
        out = out.join(F.broadcast(one.select(F.struct(*[c for c in one.columns if c != "id"]).alias(kind)).limit(1)), F.lit(True))
    return out


def predict_tail(model, head: int, relation: int, top_k: int = 10, vocab: DataFrame | None = None) -> DataFrame:
    """id, name, score, rank of the best tails; equal scores are ranked by larger id first."""
    rows = _against(model, {"_h": ("entities", head), "_r": ("relations", relation)}, model.entities)
    return _ranked(rows.select("id", model.score_columns("_h", "_r", "_x").alias("score")), top_k, F.desc("id"), vocab, "entity_")


def predict_head(model, relation: int, tail: int, top_k: int = 10, vocab: DataFrame | None = None) -> DataFrame:
    rows = _against(model, {"_r": ("relations", relation), "_t": ("entities", tail)}, model.entities)
    return _ranked(rows.select("id", model.score_columns("_x", "_r", "_t").alias("score")), top_k, F.desc("id"), vocab, "entity_")


def predict_relation(model, head: int, tail: int, top_k: int = 5, vocab: DataFrame | None = None) -> DataFrame:
    """Equal scores are ranked by smaller id first."""
    rows = _against(model, {"_h": ("entities", head), "_t": ("entities", tail)}, model.relations)
    return _ranked(rows.select("id", model.score_columns("_h", "_x", "_t").alias("score")), top_k, F.asc("id"), vocab, "rel_")


def ranks(model, triples: DataFrame, block: int = 4096) -> DataFrame:
    """triples with rank: how many entities score at least as well as their tail.

    A score is a distance of the moved head from the entity. Triples and entities are dealt to blocks of about ``block``
    rows, and each block of the one meets each of the other, as arrays. Repeated triples get a row each."""
    rows = triples.join(_parts(model.entities, "h", "_h"), "h").join(_parts(model.relations, "r", "_r"), "r").join(_parts(model.entities, "t", "_t"), "t")
    rows = settle(rows.select("h", "r", "t", model.moved("_h", "_r").alias("q"), model.flat("_t").alias("own")).withColumn("k", F.monotonically_increasing_id()))
    n, m = (max(1, -(-df.count() // block)) for df in (rows, model.entities))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = rows.select("k", "q", "own", deal("k", n).alias("a")).withColumn("b", every(m))
    inner = F.struct(*[c for c in model.entities.columns if c != "id"]).alias("_x")
    right = model.entities.select(deal("id", m).alias("b"), inner).select("b", model.flat("_x").alias("x")).withColumn("a", every(n))
    power = model.config.norm if isinstance(model, TransE) else 2

    def count(asked: pa.Table, known: pa.Table) -> pa.Table:
        wide = lambda c: np.array(c.combine_chunks().flatten()).reshape(len(c), -1)
        size = lambda d: np.abs(d).sum(-1) if power == 1 else np.sqrt((d * d).sum(-1))
        if not len(asked) or not len(known):
            return pa.table({"k": asked.column("k"), "better": pa.array([0] * len(asked), pa.int64())})
        q, own, x = wide(asked.column("q")), wide(asked.column("own")), wide(known.column("x"))
        better = [int((size(one - x) <= size((one - t)[None])[0]).sum()) for one, t in zip(q, own, strict=True)]
        return pa.table({"k": asked.column("k"), "better": pa.array(better, pa.int64())})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(count, "k long, better long")
    met = met.groupBy("k").agg(F.sum("better").alias("rank"))
    return rows.join(met, "k").select("h", "r", "t", F.greatest(F.col("rank"), F.lit(1)).alias("rank"))


def evaluate(model, triples: DataFrame, ks=(1, 3, 10)) -> DataFrame:
    """mrr and hits_at_k over the tails, unfiltered."""
    r = ranks(model, triples)
    return r.agg(F.avg(1.0 / F.col("rank")).alias("mrr"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks])
