"""A set of facts (subject, predicate, object) as one DataFrame, and pattern queries compiled to joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.patterns import Pattern, PatternQuery, is_variable, parse

FACT = T.StructType([T.StructField(c, T.StringType(), False) for c in ("subject", "predicate", "object")])
COLUMNS = FACT.fieldNames()


class FactGraph:
    """Facts without repetition. Every method returns DataFrames or new graphs; nothing is changed in place."""

    def __init__(self, facts: DataFrame, distinct: bool = False):
        """distinct: the caller knows that no fact is repeated, which saves the shuffle."""
        facts = facts.select(*COLUMNS)
        self.facts = facts if distinct else facts.distinct()
        self._shape: dict[Pattern, tuple[float, dict[str, float]]] = {}

    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> FactGraph:
        return cls(spark.createDataFrame(list(rows), FACT))

    # ---- changes

    def new_facts(self, facts: DataFrame) -> DataFrame:
        """Those of facts that the graph lacks, once each; their count is what a load adds."""
        return facts.select(*COLUMNS).distinct().join(self.facts, COLUMNS, "left_anti")

    def add_all(self, facts: DataFrame) -> FactGraph:
        return FactGraph(self.facts.unionByName(facts.select(*COLUMNS)))

    def remove_all(self, facts: DataFrame) -> FactGraph:
        return FactGraph(self.facts.join(facts.select(*COLUMNS), COLUMNS, "left_anti"), distinct=True)

    # ---- reads

    def lookup(self, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
        """Facts that agree with the given terms; None and "" stand for any."""
        given = [F.col(c) == t for c, t in zip(COLUMNS, (subject, predicate, obj), strict=True) if t]
        return self.facts.where(reduce(Column.__and__, given)) if given else self.facts

    def contains(self, subject: str, predicate: str, obj: str) -> bool:
        """Here "" is a term like any other."""
        terms = zip(COLUMNS, (subject, predicate, obj), strict=True)
        return bool(self.facts.where(reduce(Column.__and__, [F.col(c) == t for c, t in terms])).limit(1).count())

    def subjects(self) -> DataFrame:
        return self.facts.select("subject").distinct()

    def predicates(self) -> DataFrame:
        return self.facts.select("predicate").distinct()

    def objects(self) -> DataFrame:
        return self.facts.select("object").distinct()

    def entities(self) -> DataFrame:
        both = self.facts.select(F.explode(F.array("subject", "object")).alias("entity"))
        return both.distinct()

    def size(self) -> int:
        return self.facts.count()

    def cardinality(self, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> int:
        """Facts that agree; with three terms given the object is left out, as in the reference's estimate."""
        return self.counts([Pattern(subject or "?s", predicate or "?p", obj or "?o")])[0]

    def counts(self, patterns: list[Pattern]) -> list[int]:
        """Estimates for several patterns by one pass over the facts."""
        if not patterns:
            return []
        row = self.facts.agg(*[F.count_if(_estimated(p)).alias(f"n{k}") for k, p in enumerate(patterns)]).first()
        return list(row)

    def predicate_statistics(self) -> DataFrame:
        return self.facts.groupBy("predicate").agg(
            F.count(F.lit(1)).alias("facts"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects")
        )

    def shapes(self, patterns: list[Pattern]) -> list[tuple[float, dict[str, float]]]:
        """For each pattern about how many facts match and how many values each variable takes, kept for later queries.

        One pass with approximate distinct counts for all patterns that aren't known yet; it has no shuffle of facts."""
        new = [p for p in dict.fromkeys(patterns) if p not in self._shape]
        if new:
            found = [reduce(Column.__and__, self._tests(p), F.lit(True)) for p in new]
            places = [[(c, t) for c, t in zip(COLUMNS, p.terms, strict=True) if is_variable(t)] for p in new]
            counts = [F.count_if(f).cast("double") for f in found]
            values = [F.approx_count_distinct(F.when(f, F.col(c)), 0.1).cast("double") for f, own in zip(found, places, strict=True) for c, _ in own]
            row = list(self.facts.agg(*[x.alias(f"x{k}") for k, x in enumerate(counts + values)]).first())
            rest = iter(row[len(new) :])
            for p, n, own in zip(new, row[: len(new)], places, strict=True):
                self._shape[p] = (n, {v: min(max(next(rest), 1.0), max(n, 1.0)) for _, v in own})
        return [self._shape[p] for p in patterns]

    # ---- queries

    def plan(self, query: PatternQuery) -> DataFrame:
        """Patterns in join order with cardinality, selectivity and the plan's cost (the sum of cardinalities)."""
        counts, size = self.counts(query.patterns), self.size()
        order = join_order(query.patterns, counts)
        cost = float(sum(counts))
        rows = [(k, str(query.patterns[i]), counts[i], counts[i] / (size or 1), cost) for k, i in enumerate(order)]
        return self.facts.sparkSession.createDataFrame(rows, "step int, pattern string, cardinality long, selectivity double, cost double")

    def query(self, text: str, compat: bool = False) -> DataFrame:
        return self.execute(parse(text, compat))

    def execute(self, query: PatternQuery) -> DataFrame:
        """One STRING column for each selected variable that the patterns have, without repeated rows.

        LIMIT 0 and OFFSET 0 have no effect; slices are taken in the order of all columns."""
        spark = self.facts.sparkSession
        if not query.patterns:
            return spark.createDataFrame([], T.StructType([]))
        patterns = query.patterns
        scans = [self._scan(p) for p in patterns]
        open_, fixed = ([i for i, (_, names) in enumerate(scans) if bool(names) == some] for some in (True, False))
        wanted = {v[1:] for v in query.select}

        def build(tree) -> tuple[DataFrame, set[int]]:
            if isinstance(tree, int):
                return scans[tree][0], {tree}
            (a, left), (b, right) = map(build, tree)
            shared, inside = [c for c in b.columns if c in a.columns], left | right
            out = a.join(b, shared) if shared else a.crossJoin(b)
            # a variable that nothing needs any more only repeats rows
            alive = [c for c in out.columns if c in wanted or any(c in scans[i][1] for i in open_ if i not in inside)]
            if alive and len(alive) < len(out.columns) and len(inside) < len(open_):
                out = out.select(*alive).distinct()
            return out, inside

        if open_:
            shapes = self.shapes([patterns[i] for i in open_]) if len(open_) > 1 else [(0.0, {})]
            out = build(join_tree(dict(zip(open_, shapes, strict=True))))[0]
        else:
            out = scans[fixed.pop()][0].limit(1).select(F.lit(1).alias("__hit"))
        for i in fixed:
            out = out.join(scans[i][0].limit(1), F.lit(True), "left_semi")
        kept = [v[1:] for v in dict.fromkeys(query.select) if v[1:] in out.columns]
        if not kept:
            return out.limit(1).select()
        out = out.select(*kept).distinct()
        if query.offset or query.limit:
            out = out.orderBy(*kept)
        if query.offset:
            out = out.offset(query.offset)
        return out.limit(query.limit) if query.limit else out

    def _scan(self, pattern: Pattern) -> tuple[DataFrame, list[str]]:
        """The pattern's matches, a column for each of its variables."""
        tests = self._tests(pattern)
        found = self.facts.where(reduce(Column.__and__, tests)) if tests else self.facts
        at = {v: c for c, v in reversed(list(zip(COLUMNS, pattern.terms, strict=True))) if is_variable(v)}
        names = list(dict.fromkeys(pattern.variables))
        return found.select(*[F.col(at[v]).alias(v[1:]) for v in names]), [v[1:] for v in names]

    @staticmethod
    def _tests(pattern: Pattern) -> list[Column]:
        """What a fact must fulfil to match."""
        at: dict[str, str] = {}
        tests = []
        for column, term in zip(COLUMNS, pattern.terms, strict=True):
            if not is_variable(term):
                if term:
                    tests.append(F.col(column) == term)
            elif term in at:
                tests.append(F.col(column) == F.col(at[term]))
            else:
                at[term] = column
        return tests


def _estimated(pattern: Pattern) -> Column:
    given = [(c, t) for c, t in zip(COLUMNS, pattern.terms, strict=True) if t and not is_variable(t)]
    tests = [F.col(c) == t for c, t in given[: 2 if len(given) == 3 else 3]]
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def join_order(patterns: list[Pattern], counts: list[int]) -> list[int]:
    """Smallest first, then always the smallest that shares a variable with those before, or else the smallest."""
    left = sorted(range(len(patterns)), key=lambda i: counts[i])
    order, known = [], set()
    while left:
        best = next((i for i in left if known & set(patterns[i].variables)), left[0])
        left.remove(best)
        order.append(best)
        known |= set(patterns[best].variables)
    return order


def join_tree(shapes: dict[int, tuple[float, dict[str, float]]]):
    """Pairs of pairs of the shapes' keys: always the two parts are joined whose join is estimated smallest,
    parts that share a variable first.

    Two tables that share variables are taken to give |A| |B| / (the larger number of values, for each of them)."""

    def joined(a, b):
        (n, x), (m, y) = a, b
        out = n * m
        for v in x.keys() & y.keys():
            out /= max(x[v], y[v])
        return out, {v: max(1.0, min(x.get(v, out), y.get(v, out), out)) for v in x | y}

    parts = [(i, s) for i, s in shapes.items()]
    while len(parts) > 1:
        pairs = [(j, k) for k in range(len(parts)) for j in range(k)]
        apart = lambda j, k: not parts[j][1][1].keys() & parts[k][1][1].keys()
        j, k = min(pairs, key=lambda p: (apart(*p), joined(parts[p[0]][1], parts[p[1]][1])[0], p))
        new = ((parts[j][0], parts[k][0]), joined(parts[j][1], parts[k][1]))
        parts = [p for i, p in enumerate(parts) if i not in (j, k)] + [new]
    return parts[0][0]
