"""String similarity as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """The set of lower-cased words, split at Unicode white space."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(c)), SPACE), lambda x: x != ""))


def jaccard(a, b) -> Column:
    """Of two sets given as arrays: 1 for two empty ones, 0 if one is empty."""
    a, b = _col(a), _col(b)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def levenshtein(a, b) -> Column:
    return F.levenshtein(_col(a), _col(b))


def normalised_levenshtein(a, b) -> Column:
    """1 - distance / longer length; case matters; 1 for two empty strings."""
    longest = F.greatest(F.length(_col(a)), F.length(_col(b)))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def token_jaccard(a, b) -> Column:
    return jaccard(tokens(a), tokens(b))


def cosine(a, b) -> Column:
    """Of two token sets (beyond the reference, which only names it)."""
    a, b = tokens(a), tokens(b)
    norm = F.sqrt(F.size(a) * F.size(b).cast("double"))
    return F.when(norm == 0, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(norm, F.lit(1.0)))
