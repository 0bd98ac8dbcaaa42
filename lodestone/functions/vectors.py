"""Vector and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a) -> Column:
    """Vector of length 1; null for a zero vector."""
    return F.transform(_col(a), lambda x: x.cast("double") / F.nullif(norm(a), F.lit(0.0)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def relu(x) -> Column:
    return F.greatest(_col(x), F.lit(0.0))


def log_softmax(x, window) -> Column:
    """x less the logarithm of the summed exponentials over the window, taken at its maximum."""
    top = F.max(_col(x)).over(window)
    return _col(x) - (top + F.log(F.sum(F.exp(_col(x) - top)).over(window)))


def hashed_unit(*parts) -> Column:
    """A number in [0, 1) from md5 of the parts; the same in every engine and partitioning."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hashed_order(*parts) -> Column:
    """md5 of the parts, to sort by."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))
