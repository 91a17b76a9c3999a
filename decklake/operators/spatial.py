"""Joins of rectangles by a grid: rectangles that touch share a cell, so an equi-join on cells finds them.

Keys (slides, orders) with few pairs are one cell each. On crowded ones a cell is as large as an average rectangle of the right side, but
a grid has no more cells than the key has such rectangles: each is copied to few cells, and no cell holds most of a key. A
pair that shares several cells is reported in one only, that of the corner at which both have begun.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.functions.constants import EMU_PER_INCH

#: Pairs of a key up to which it is compared whole.
CROWD = 4_096
#: Added to regions, so that rounding loses no pair; exact conditions follow the join.
_HAIR = 1.0
_AXES = ("x", "y")


def region(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """A rectangle, a hair wider on all sides."""
    return F.struct((x - _HAIR).alias("x"), (y - _HAIR).alias("y"), (cx + 2 * _HAIR).alias("cx"), (cy + 2 * _HAIR).alias("cy"))


def bottom_edge(rect: Column) -> Column:
    return F.struct(rect["x"].alias("x"), (rect["y"] + rect["cy"]).alias("y"), rect["cx"].alias("cx"), F.lit(0.0).alias("cy"))


def band_above(rect: Column, over: float, under: float) -> Column:
    """Where a bottom edge lies that ends up to ``over`` inches above a rectangle, or ``under`` below its top."""
    return region(rect["x"], rect["y"] - over * EMU_PER_INCH, rect["cx"], F.lit((over + under) * EMU_PER_INCH))


def _bounds(rows: DataFrame, rect: Column, side: str) -> DataFrame:
    """``rows`` with the least and largest coordinate of their rectangle on each axis."""
    rows = rows.where(rect.isNotNull())
    ends = {axis: (rect[axis], rect[axis] + rect[f"c{axis}"]) for axis in _AXES}
    return rows.withColumns({f"grid__{n}_{axis}_{side}": f(*c) for axis, c in ends.items() for n, f in (("lo", F.least), ("hi", F.greatest))})


def grids(left: DataFrame, right: DataFrame, keys: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """The keys with over ``crowd`` pairs, and origin, extent and cell of their grid on each axis. Counts and sums of
    each key are made before the shuffle."""
    none = F.lit(None).cast("double")
    sizes = {f"{n}_{axis}": F.col(f"grid__{n}_{axis}_b") for axis in _AXES for n in ("lo", "hi")}
    every = left.select(*keys, F.lit(0).alias("mine"), *[none.alias(n) for n in sizes]).unionByName(right.select(*keys, F.lit(1).alias("mine"), *[c.alias(n) for n, c in sizes.items()]))
    sums = [F.count_if(F.col("mine") == k).alias(n) for k, n in ((0, "lefts"), (1, "rights"))]
    for axis in _AXES:
        lo, hi = F.col(f"lo_{axis}"), F.col(f"hi_{axis}")
        sums += [F.min(lo).alias(f"from_{axis}"), F.max(hi).alias(f"to_{axis}"), F.avg(hi - lo).alias(f"mean_{axis}")]
    crowded = every.groupBy(*keys).agg(*sums).where(F.col("lefts") * F.col("rights") > crowd)
    out = []
    for axis in _AXES:
        extent = F.col(f"to_{axis}") - F.col(f"from_{axis}")
        cell = F.greatest(F.col(f"mean_{axis}"), extent / F.sqrt("rights"), F.lit(1.0))
        out += [F.col(f"from_{axis}").alias(f"grid__from_{axis}"), extent.alias(f"grid__extent_{axis}"), cell.alias(f"grid__size_{axis}")]
    return crowded.select(*keys, *out)


def _celled(rows: DataFrame, frames: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``rows`` in each cell that they touch, with the first of these on each axis; keys without a grid are one cell."""
    rows = rows.join(frames, list(keys), "left")
    for axis in _AXES:
        start, extent, size = (F.col(f"grid__{n}_{axis}") for n in ("from", "extent", "size"))
        at = lambda n: F.coalesce(F.floor(F.least(F.greatest(F.col(f"grid__{n}_{axis}_{side}") - start, F.lit(0.0)), extent) / size), F.lit(0)).cast("int")  # noqa: E731, B023
        rows = rows.withColumn(f"grid__first_{axis}_{side}", at("lo")).withColumn(f"grid__cell_{axis}", F.explode(F.sequence(at("lo"), at("hi"))))
    return rows.drop(*[f"grid__{n}_{axis}" for n in ("from", "extent", "size") for axis in _AXES])


def touching(left: DataFrame, right: DataFrame, keys: Sequence[str], a: Column, b: Column, crowd: int = CROWD) -> DataFrame:
    """The rows of ``left`` and ``right`` of equal keys whose rectangles ``a`` and ``b`` (structs of x, y, cx, cy) touch or overlap,
    with the columns of both, whose other names must differ.

    The same rows as the join on keys with that condition, but the work follows the rectangles that are near each other, not
    the pairs of a key. Null rectangles and null keys meet nothing; repeated rows give a row for each pair.
    """
    left, right = _bounds(left, a, "a"), _bounds(right, b, "b")
    frames = grids(left, right, keys, crowd)
    cells = [f"grid__cell_{axis}" for axis in _AXES]
    pairs = _celled(left, frames, keys, "a").join(_celled(right, frames, keys, "b"), [*keys, *cells])
    for axis in _AXES:
        pairs = pairs.where(F.col(f"grid__cell_{axis}") == F.greatest(f"grid__first_{axis}_a", f"grid__first_{axis}_b"))
        pairs = pairs.where((F.col(f"grid__lo_{axis}_a") <= F.col(f"grid__hi_{axis}_b")) & (F.col(f"grid__lo_{axis}_b") <= F.col(f"grid__hi_{axis}_a")))
    return pairs.drop(*[c for c in pairs.columns if c.startswith("grid__")])
