"""Tile geometry as column expressions. Pixels are level pixels unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def int_div(a: Column | str, b: Column | str | int) -> Column:
    """Integer division of non-negative numbers, without a detour over doubles."""
    a, b = _c(a), _c(b)
    return ((a - a % b) / b).cast("bigint")


def tiles_across(size: Column | str, tile: Column | str | int) -> Column:
    """Number of tiles that cover a side, the last one possibly padded."""
    return int_div(_c(size).cast("bigint") + _c(tile) - 1, tile)


def window_count(size: Column | str, window: Column | str | int, stride: Column | str | int) -> Column:
    """Number of whole windows along a side; a partial one at the end is dropped, a window larger than the side gives 0."""
    return F.when(_c(window) > _c(size), F.lit(0).cast("bigint")).otherwise(int_div(_c(size).cast("bigint") - _c(window), stride) + 1)


def whole_pixels(length: Column | str) -> Column:
    """Pixels of a length that is meant to be whole: at least 1, forgiving a millionth below."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(_c(length) + F.lit(1e-6)).cast("bigint"))


def valid_side(size: Column | str, index: Column | str, tile: Column | str | int) -> Column:
    """The part of a tile's side inside the level; 0 beyond it."""
    left = _c(size).cast("bigint") - _c(index).cast("bigint") * _c(tile)
    return F.least(F.greatest(left, F.lit(0).cast("bigint")), _c(tile).cast("bigint"))


def half_up(x: Column) -> Column:
    """Rounded half away from zero (non-negative x), as a long."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def base_pixels(level_pixels: Column | str, downsample: Column | str) -> Column:
    """Level pixels in pixels of the finest level."""
    return half_up(_c(level_pixels).cast("double") * _c(downsample))


def resized_side(side: Column | str, factor: Column | str, epsilon: float = 1e-3) -> Column:
    """A side after resampling by factor; unchanged where the factor is null or within epsilon of 1."""
    scaled = F.greatest(F.lit(1).cast("bigint"), half_up(_c(side).cast("double") * _c(factor)))
    return F.when(_c(factor).isNull() | (F.abs(_c(factor) - 1) <= epsilon), _c(side).cast("bigint")).otherwise(scaled)


def span(start: Column | str, length: Column | str | int, scale: Column | str | float, size: Column | str | int) -> tuple[Column, Column]:
    """The overview pixels [lo, hi) that a run of level pixels falls on; never empty."""
    s, n, k, m = _c(start).cast("double"), _c(length).cast("double"), _c(scale), _c(size).cast("bigint")
    lo = F.least(F.floor(s * k).cast("bigint"), m - 1)
    return lo, F.least(F.greatest(F.ceil((s + n) * k).cast("bigint"), lo + 1), m)


def fit_within(aspect: Column | str, width: Column | str | float, height: Column | str | float) -> tuple[Column, Column]:
    """The largest box of that aspect ratio inside width x height."""
    a, w, h = _c(aspect), _c(width), _c(height)
    wide = a > w / h
    return F.when(wide, w).otherwise(h * a), F.when(wide, w / a).otherwise(h)


def fractional(origin: Column | str, footprint: Column | str, base: Column | str) -> tuple[Column, Column]:
    """A footprint's two edges as fractions of the base side, in single precision."""
    o, f, b = _c(origin).cast("bigint"), _c(footprint).cast("bigint"), _c(base).cast("bigint")
    return (o.cast("float") / b.cast("float")).cast("float"), (F.least(o + f, b).cast("float") / b.cast("float")).cast("float")


def fraction(part: Column | str, whole: Column | str) -> Column:
    """part / whole in single precision; 0 for an empty whole."""
    p, n = _c(part), _c(whole)
    return F.when(n == 0, F.lit(0.0).cast("float")).otherwise((p.cast("float") / n.cast("float")).cast("float"))
