"""Tile coordinates and their joins, generated by sequences: no range or cross join anywhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import int_div


Along = dict[str, Callable[[Column], Column]]


def cells(df: DataFrame, columns: Column | str, rows: Column | str, x: str = "tile_x", y: str = "tile_y", of_x: Along | None = None, of_y: Along | None = None) -> DataFrame:
    """A row for each cell of a grid, row by row; none where a side has none.

    of_x, of_y: further columns, from a cell's column or row alone; worked out once a column or row and not for each cell.
    """
    c, r = (F.col(n) if isinstance(n, str) else n for n in (columns, rows))
    some = df.withColumns({"_c": c, "_r": r}).where("_c > 0 and _r > 0")
    sides = [(name, n, of or {}) for name, n, of in ((y, "_r", of_y), (x, "_c", of_x))]
    some = some.withColumns({f"{n}s": _line(F.col(n), name, of) for name, n, of in sides})
    for name, n, of in sides:
        some = some.withColumn(name, F.explode_outer(f"{n}s"))  # none is empty; explode would have a filter work them out before they are dealt out
    told = [F.col(name)[k].alias(k) for name, _, of in sides if of for k in (name, *of)]
    return some.select(*df.columns, *(name for name, _, of in sides if not of), *told)


def _line(n: Column, name: str, of: Along) -> Column:
    """0 to n - 1 or, with of, a struct for each of them."""
    line = F.sequence(F.lit(0).cast("bigint"), n - 1)
    return F.transform(line, lambda i: F.struct(i.alias(name), *(f(i).alias(k) for k, f in of.items()))) if of else line


def looked_up(tiles: DataFrame, index: str, lists: dict[str, str]) -> DataFrame:
    """tiles with what their row's lists hold at their index; those beyond a list are left out, as by a join with its numbered rows."""
    at = F.col(index).cast("int")
    inside = [F.size(c) > F.col(index) for c in lists.values()]
    found = tiles.where(reduce(lambda a, b: a & b, inside)).withColumns({k: F.get(c, at) for k, c in lists.items()})
    return found.drop(*lists.values())


def overlapped(df: DataFrame, x: str, y: str, w: Column | str, h: Column | str, tile_w: str, tile_h: str, limit: tuple[Column, Column] | None = None) -> DataFrame:
    """A row for each native tile (native_x, native_y) that a rectangle meets, within the level's tiles where limit gives their numbers."""
    out = df
    for at, size, tile, name, most in ((x, w, tile_w, "native_x", limit and limit[0]), (y, h, tile_h, "native_y", limit and limit[1])):
        lo, hi = int_div(F.col(at), tile), int_div(F.col(at) + size - 1, tile)
        if most is not None:
            hi = F.least(hi, most - 1)
        out = out.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn(name, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return out


def met_by(windows: Column | str, size: Column | str, stride: Column | str, tile: Column | str) -> Column:
    """Along one side, a struct: pairs of a window and a native tile that it meets, and native_tiles that any meets. One pass over the windows."""
    n, w, s, t = (F.col(c) if isinstance(c, str) else c for c in (windows, size, stride, tile))
    zero = F.lit(0).cast("bigint")

    def add(a: Column, i: Column) -> Column:
        lo, hi = int_div(i * s, t), int_div(i * s + w - 1, t)
        return F.struct((a["pairs"] + hi - lo + 1).alias("pairs"), (a["native_tiles"] + hi - F.greatest(lo, a["seen"]) + 1).alias("native_tiles"), (hi + 1).alias("seen"))

    return F.aggregate(F.sequence(zero, n - 1), F.struct(zero.alias("pairs"), zero.alias("native_tiles"), zero.alias("seen")), add)


def best_level(levels: DataFrame, slide: str, target: Column) -> DataFrame:
    """The coarsest level that is at least as fine as the target, else the finest; null without microns per pixel.

    levels: slide, level, mpp. Among equal mpp the last level fits, among the finest the first.
    """
    fits = F.max_by(F.when(F.col("mpp") <= F.col("_t"), F.col("level")), F.when(F.col("mpp") <= F.col("_t"), F.struct("mpp", "level")))
    finest = F.min_by("level", F.when(F.col("mpp").isNotNull(), F.struct("mpp", "level")))
    return levels.withColumn("_t", target).groupBy(slide).agg(F.when(F.max("mpp").isNotNull(), F.coalesce(fits, finest)).alias("best_level"))
