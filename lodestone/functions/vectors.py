"""Vector algebra on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c) -> Column:
    return F.aggregate(_col(c), F.lit(0.0), lambda acc, x: acc + x)


def plus(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def minus(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def scaled(a, k) -> Column:
    return F.transform(_col(a), lambda x: x * k)


def l1(a) -> Column:
    return total(F.transform(_col(a), lambda x: F.abs(x)))


def l2(a) -> Column:
    return F.sqrt(total(F.transform(_col(a), lambda x: x * x)))


def normalised(a) -> Column:
    """Divided by its length, or by FLOOR if that is larger."""
    a = _col(a)
    return F.transform(F.array(F.greatest(l2(a), F.lit(FLOOR))), lambda size: F.transform(a, lambda x: x / size))[0]


def rotated(re, im, r_re, r_im) -> tuple[Column, Column]:
    """Real and imaginary part of the elementwise complex product."""
    prod = lambda a, b: F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return minus(prod(re, r_re), prod(im, r_im)), plus(prod(re, r_im), prod(im, r_re))


def complex_distance(re, im) -> Column:
    return F.sqrt(total(F.zip_with(_col(re), _col(im), lambda x, y: x * x + y * y)))


def on_unit_circle(re, im) -> tuple[Column, Column]:
    """Each number divided by its modulus, or by FLOOR if that is larger."""
    re, im = _col(re), _col(im)
    size = F.zip_with(re, im, lambda x, y: F.greatest(F.sqrt(x * x + y * y), F.lit(FLOOR)))
    part = lambda v: F.zip_with(v, size, lambda x, m: x / m)
    return part(re), part(im)


def phases(re, im) -> Column:
    return F.zip_with(_col(im), _col(re), lambda y, x: F.atan2(y, x))
