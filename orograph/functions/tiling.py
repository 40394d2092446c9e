"""Tile arithmetic on the WGS84 quad pyramid: two square tiles at zoom 0, y from the north.

``z`` is at most 30, so that tile numbers and Morton codes fit in 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight neighbours as (name, dx, dy); y grows to the south.
DIRECTIONS = [("N", 0, -1), ("NE", 1, -1), ("E", 1, 0), ("SE", 1, 1), ("S", 0, 1), ("SW", -1, 1), ("W", -1, 0), ("NW", -1, -1)]
# Fixed value: how far a corner moves inwards before its tile is looked up.
NUDGE = 1e-11


def tile_columns(z: Column) -> Column:
    return F.pow(F.lit(2.0), z + 1).cast("long")


def tile_rows(z: Column) -> Column:
    return F.pow(F.lit(2.0), z).cast("long")


def tile_width(z: Column) -> Column:
    """Degrees on each side."""
    return F.lit(180.0) / F.pow(F.lit(2.0), z)


def tile_x(lon: Column, z: Column) -> Column:
    return F.floor((lon + 180.0) / tile_width(z)).cast("long")


def tile_y(lat: Column, z: Column) -> Column:
    return F.floor((F.lit(90.0) - lat) / tile_width(z)).cast("long")


def flip_y(y: Column, z: Column) -> Column:
    """Between rows counted from the north and from the south."""
    return tile_rows(z) - 1 - y


def left(x: Column, z: Column) -> Column:
    return F.lit(-180.0) + x * tile_width(z)


def top(y: Column, z: Column) -> Column:
    return F.lit(90.0) - y * tile_width(z)


def bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """Columns left, bottom, right, top in degrees."""
    w = tile_width(z)
    return {"left": left(x, z), "bottom": top(y, z) - w, "right": left(x, z) + w, "top": top(y, z)}


def in_matrix(z: Column, x: Column, y: Column) -> Column:
    return (x >= 0) & (x < tile_columns(z)) & (y >= 0) & (y < tile_rows(z))


def morton(x: Column, y: Column) -> Column:
    """Bits of x at even and of y at odd places, by spreading each with shifts and masks."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def clamp(l: Column, b: Column, r: Column, t: Column) -> dict[str, Column]:  # noqa: E741
    """The part of a box that lies in the world."""
    return {"left": F.greatest(l, F.lit(-180.0)), "bottom": F.greatest(b, F.lit(-90.0)), "right": F.least(r, F.lit(180.0)), "top": F.least(t, F.lit(90.0))}


def zoom_list(text: Column) -> Column:
    """Zooms from a list such as 5-6-7."""
    return F.transform(F.split(text, "-"), lambda s: F.trim(s).cast("long"))


def tile_range(z: Column, l: Column, b: Column, r: Column, t: Column) -> dict[str, Column]:  # noqa: E741
    """start_x, start_y, end_x, end_y (rows from the south) of the tiles that a box meets.

    The box is clamped to the world; its corners move inwards by NUDGE so that
    an edge shared with the next tile doesn't count.
    """
    l, b, r, t = clamp(l, b, r, t).values()  # noqa: E741
    x0, x1 = tile_x(l + NUDGE, z), tile_x(r - NUDGE, z)
    north, south = tile_y(t - NUDGE, z), tile_y(b + NUDGE, z)
    return {"start_x": F.least(x0, x1), "start_y": flip_y(F.greatest(north, south), z), "end_x": F.greatest(x0, x1), "end_y": flip_y(F.least(north, south), z)}


def intersects(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two boxes (left, bottom, right, top) meet; touching counts."""
    return ~((a[0] > b[2]) | (a[2] < b[0]) | (a[1] > b[3]) | (a[3] < b[1]))
