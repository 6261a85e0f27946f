"""How rasters are shown side by side; all of it stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least magnification that shows anything, and widths' ratio beyond which rasters are not alike.
USEFUL_SCALE, UNLIKE_WIDTHS = 1.05, 1.35


def _known(*sizes: Column) -> Column:
    out = F.lit(True)
    for s in sizes:
        out = out & F.coalesce(s > 0, F.lit(False))
    return out


def largest_scale(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """How far a raster that fits a box may be magnified until a pixel of it is one of the box; null if a size is unknown."""
    return F.when(_known(width, height, box_width, box_height), 1 / F.least(box_width / width, box_height / height))


def shared_scale(scales: Column) -> Column:
    """The scale that all of an array of largest scales allow; unknown ones do not count, none at all gives null."""
    return F.array_min(F.array_compact(scales))


def can_magnify(scales: Column) -> Column:
    return F.coalesce(shared_scale(scales) >= USEFUL_SCALE, F.lit(False))


def unlike_widths(widths: Column) -> Column:
    """Whether two known widths or more lie too far apart to be compared at one scale."""
    known = F.filter(widths, lambda w: w > 0)
    return (F.size(known) >= 2) & F.coalesce(F.array_max(known) > F.array_min(known) * F.lit(UNLIKE_WIDTHS), F.lit(False))


def pan_placement(width: Column, height: Column, box_width: Column, box_height: Column, scale: Column, x: Column, y: Column) -> Column:
    """Struct of width, height, left, top, x, y: a magnified raster in its box, centred on a point of the picture.

    The point is moved so that no gap opens; along a side that is not larger than the box the raster stands in the
    middle. Null if a size is unknown.
    """
    fit = F.least(box_width / width, box_height / height)

    def place(box: Column, drawn: Column, centre: Column) -> tuple[Column, Column]:
        left = F.least(F.lit(0.0), F.greatest(box - drawn, box / 2 - centre * drawn))
        return F.when(drawn <= box, (box - drawn) / 2).otherwise(left), F.when(drawn <= box, F.lit(0.5)).otherwise((box / 2 - left) / drawn)

    w, h = width * fit * scale, height * fit * scale
    (left, at_x), (top, at_y) = place(box_width, w, x), place(box_height, h, y)
    shown = F.struct(w.alias("width"), h.alias("height"), left.alias("left"), top.alias("top"), at_x.alias("x"), at_y.alias("y"))
    return F.when(_known(width, height, box_width, box_height), shown)
