"""Colour as column expressions: luma, and sRGB to CIE Lab (D65) and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standards: sRGB's matrices and transfer curve, the D65 white, CIE Lab's breakpoint.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
DELTA = 6 / 29


def luma(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Integer Rec. 709 luma."""
    c = [F.col(x) if isinstance(x, str) else x for x in (r, g, b)]
    total = (c[0] * 2126 + c[1] * 7152 + c[2] * 722).cast("bigint")
    return ((total - total % 10000) / 10000).cast("int")


def lab(r: Column | str, g: Column | str, b: Column | str) -> tuple[Column, Column, Column]:
    lin = []
    for x in (r, g, b):
        c = (F.col(x) if isinstance(x, str) else x).cast("double") / 255.0
        lin.append(F.when(c <= 0.04045, c / 12.92).otherwise(F.power((c + 0.055) / 1.055, F.lit(2.4))))
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (lin[0] * row[0] + lin[1] * row[1] + lin[2] * row[2]) / white
        f.append(F.when(t > DELTA**3, F.power(t, F.lit(1 / 3))).otherwise(t / (3 * DELTA**2) + 4 / 29))
    return f[1] * 116.0 - 16.0, (f[0] - f[1]) * 500.0, (f[1] - f[2]) * 200.0


def rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """Back to 8-bit sRGB, clamped and rounded half up."""
    fy = (l + 16.0) / 116.0
    xyz = []
    for f, white in zip((fy + a / 500.0, fy, fy - b / 200.0), WHITE, strict=True):
        xyz.append(F.when(f > DELTA, f * f * f).otherwise((f - 4 / 29) * (3 * DELTA**2)) * white)
    out = []
    for row in FROM_XYZ:
        c = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        c = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        c = F.when(c <= 0.0031308, c * 12.92).otherwise(F.power(c, F.lit(1 / 2.4)) * 1.055 - 0.055)
        out.append(F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255.0 + 0.5).cast("int"))
    return tuple(out)
