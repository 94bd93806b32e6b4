"""Colour expressions for three-component scores and scalar ramps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.primitives import _c, value_rank

# Lab range of the palette, ramp control points (r, g, b).
LIGHT_MIN, LIGHT_SPAN, CHROMA = 32.0, 60.0, 58.0
VIRIDIS = (
    (68, 1, 84), (71, 19, 101), (72, 40, 120), (69, 55, 129), (64, 71, 136), (57, 86, 140), (51, 99, 141), (45, 113, 142),
    (40, 125, 142), (35, 138, 141), (31, 151, 139), (33, 164, 133), (47, 177, 121), (70, 190, 105), (102, 202, 84),
    (141, 211, 59), (184, 219, 38), (253, 231, 37),
)
MAGMA = (
    (0, 0, 4), (29, 17, 71), (81, 18, 124), (132, 38, 129), (183, 55, 121), (229, 81, 99), (252, 135, 97), (254, 197, 134),
    (252, 253, 191),
)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def lab_to_srgb(light: Column, a: Column, b: Column) -> Column:
    """Struct r, g, b in [0, 1] (D65)."""
    y = (light + 16.0) / 116.0

    def cube(t):
        c = t * t * t
        return F.when(c > 0.008856, c).otherwise((t - 16.0 / 116.0) / 7.787)

    X, Y, Z = cube(y + a / 500.0) * 0.95047, cube(y), cube(y - b / 200.0) * 1.08883

    def gamma(v):
        c = clip(v, 0.0, 1.0)
        return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)

    return F.struct(
        gamma(3.2406 * X - 1.5372 * Y - 0.4986 * Z).alias("r"),
        gamma(-0.9689 * X + 1.8758 * Y + 0.0415 * Z).alias("g"),
        gamma(0.0557 * X - 0.2040 * Y + 1.0570 * Z).alias("b"),
    )


def stretched_rgb(p1, p2, p3, stretch: Sequence[float]) -> Column:
    """First score to lightness between its percentiles, the others to chroma by their magnitude."""
    lo, hi, m2, m3 = stretch
    return lab_to_srgb(
        LIGHT_MIN + clip((_c(p1) - lo) / (hi - lo + 1e-9), 0.0, 1.0) * LIGHT_SPAN,
        clip(_c(p2) / (m2 + 1e-9), -1.0, 1.0) * CHROMA,
        clip(_c(p3) / (m3 + 1e-9), -1.0, 1.0) * CHROMA,
    )


def stretch_of(df: DataFrame, p1: str, p2: str, p3: str, id_col: str, rule: str = "absolute") -> tuple[list[float], list[float]]:
    """(stretch, signs). "absolute": 98th percentile of |score|. "tails": the larger tail percentile by
    floor index, with each score's sign turned so that its longer tail is positive."""
    from ..operators.stats import floor_percentiles, percentile_values

    if rule == "absolute":
        lo, hi = percentile_values(df, p1, id_col, [0.02, 0.98])
        m = [percentile_values(df.select(id_col, F.abs(F.col(c)).alias("m")), "m", id_col, [0.98])[0] for c in (p2, p3)]
        return [lo, hi, *m], [1.0, 1.0, 1.0]
    if rule != "tails":
        raise ValueError(f"unknown stretch rule {rule!r}")
    tails = [floor_percentiles(df, c, id_col, [0.02, 0.98]) for c in (p1, p2, p3)]
    sign = [-1.0 if hi < -lo else 1.0 for lo, hi in tails]
    lo, hi = sorted(sign[0] * t for t in tails[0])
    return [lo, hi, *[max(abs(t[0]), abs(t[1])) for t in tails[1:]]], sign


def rank_uniform(df: DataFrame, key: str, id_col: str, out: str) -> DataFrame:
    """Ranks spread evenly over (-1, 1), ties by id."""
    n = df.count()
    r = value_rank(df, key, id_col, out="__rk")
    return r.withColumn(out, (F.col("__rk") + 0.5) / n * 2.0 - 1.0).drop("__rk")


def ramp_color(t, ramp=VIRIDIS, round_index: bool = True) -> Column:
    """Array r, g, b (0..255) of a value in [0, 1], from a 256-step table of the ramp."""
    table = []
    for i in range(256):
        x = i / 255 * (len(ramp) - 1)
        j = min(int(x), len(ramp) - 2)
        table.append([int(ramp[j][c] + (ramp[j + 1][c] - ramp[j][c]) * (x - j) + 0.5) for c in range(3)])
    lut = F.array(*[F.array(*[F.lit(v) for v in row]) for row in table])
    i = clip(_c(t), 0.0, 1.0) * 255
    return F.get(lut, F.floor(i + 0.5 if round_index else i).cast("int"))
