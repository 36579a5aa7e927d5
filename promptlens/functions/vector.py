"""Vector expressions on ``ARRAY<DOUBLE>`` columns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptlens.functions.columns import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    """Cast stored ``ARRAY<FLOAT>`` to doubles before any arithmetic."""
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def sum_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(a) -> Column:
    return F.sqrt(sum_sq(a))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); 0.0 when either norm is zero."""
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def normalize(a) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(l2_norm(a), lambda n: F.transform(_c(a), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))


def packed(a) -> Column:
    """An ``ARRAY<DOUBLE>`` as singles where these hold the same values, as it
    is elsewhere; :func:`unpacked` gives it back."""
    single = F.forall(_c(a), lambda x: x.cast("float").cast("double") == x)
    return F.struct(F.when(single, F.transform(_c(a), lambda x: x.cast("float"))).alias("single"),
                    F.when(F.coalesce(single, F.lit(False)), F.lit(None)).otherwise(_c(a)).alias("double"))


def unpacked(p: str) -> Column:
    return F.coalesce(as_double(f"{p}.single"), F.col(f"{p}.double"))


def vec_sum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def vec_min(a) -> Column:
    return F.array_min(_c(a))


def vec_max(a) -> Column:
    return F.array_max(_c(a))
