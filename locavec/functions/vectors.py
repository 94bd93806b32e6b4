"""Vector column functions on ``array<double>`` (or ``array<tinyint>`` before decoding)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.primitives import _c

# Fixed values of the int8 code.
NODATA = -128
SIGNED_SQUARE_SCALE = 127.5
LINEAR_SCALE = 127.0


def dequantize(vec, method: str = "signed_square") -> Column:
    v = _c(vec)
    if method == "signed_square":
        return F.transform(
            v, lambda q: F.signum(q.cast("double")) * F.pow(F.abs(q.cast("double")) / SIGNED_SQUARE_SCALE, F.lit(2.0))
        )
    if method == "linear":
        return F.transform(v, lambda q: q.cast("double") / LINEAR_SCALE)
    if method == "none":
        return F.transform(v, lambda q: q.cast("double"))
    raise ValueError(f"unknown dequantization method {method!r}")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x)


def norm(v) -> Column:
    return F.sqrt(squared_norm(v))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """Divide by the norm; an all-zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(eps))
    # the length is bound once through a one-element array, so it is not evaluated per entry
    return F.element_at(
        F.transform(F.array(length), lambda n: F.transform(_c(v), lambda x: x / n)), 1
    )


def has_nodata(v, nodata: int = NODATA) -> Column:
    return F.exists(_c(v), lambda x: x == nodata)


def nodata_to_nan(v, dim: int, nodata: int = NODATA) -> Column:
    """The whole vector becomes NaN when any entry is the nodata code."""
    return F.when(has_nodata(v, nodata), F.array_repeat(F.lit(float("nan")), dim)).otherwise(
        F.transform(_c(v), lambda x: x.cast("double"))
    )


def all_finite(v) -> Column:
    return F.forall(
        _c(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )


def prefix(v, width: int, dim: int | None = None) -> Column:
    if width < 1 or (dim is not None and width > dim):
        raise ValueError("prefix width must be positive and within the vector")
    return F.slice(_c(v), 1, width)


def chunk(v, lo: int, hi: int, dim: int | None = None) -> Column:
    """Entries lo..hi-1."""
    if not 0 <= lo < hi or (dim is not None and hi > dim):
        raise ValueError("chunk bounds must be increasing and within the vector")
    return F.slice(_c(v), lo + 1, hi - lo)


def constant_vector(values: Sequence[float]) -> Column:
    """One literal, whatever its length: the text of the values, which the optimizer folds into an array of doubles."""
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>")


def standardize(v, mean: Sequence[float], std: Sequence[float], threshold: float = 1e-4) -> Column:
    """(v - mean) / std with near-constant channels set to zero."""
    inverse = [1.0 / s if s > threshold else 0.0 for s in std]
    centred = F.zip_with(_c(v), constant_vector(mean), lambda x, m: x - m)
    return F.zip_with(centred, constant_vector(inverse), lambda x, k: x * k)


def affine_decode(q, scale, offset) -> Column:
    """q * scale + offset per dimension; scale and offset are array columns or sequences."""
    s = scale if isinstance(scale, (str, Column)) else constant_vector(scale)
    o = offset if isinstance(offset, (str, Column)) else constant_vector(offset)
    scaled = F.zip_with(_c(q), _c(s), lambda x, k: x.cast("double") * k)
    return F.zip_with(scaled, _c(o), lambda x, b: x + b)


def squared_distance(a, b) -> Column:
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def relative_change(a, b, eps: float = 1e-9) -> Column:
    return distance(a, b) / F.greatest(norm(a), F.lit(eps))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def permute(v, order: Sequence[int]) -> Column:
    return F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.get(_c(v), i))
