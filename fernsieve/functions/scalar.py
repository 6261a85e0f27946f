"""Scalar expressions; all of them stay on the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0088
BEST_LUMA, LUMA_WIDTH, CLIP_PENALTY = 0.46, 0.18, 3.0
TILT_DECAY, CENTRE_DECAY, CUT_PENALTY = 6.0, 2.0, 4.0
DURATION_BANDS = ((5.0, "<5s"), (30.0, "5-30s"), (120.0, "30s-2m"), (None, ">2m"))
SIZE_BANDS = ((2, "2"), (4, "3-4"), (9, "5-9"), (None, "10+"))
LIKENESS = ((0.15, "near-identical"), (0.25, "very similar"), (0.33, "similar"), (None, "loosely similar"))
MARK_LENGTH_MM, MARK_GAP_MM = 4.0, 2.0
BLACK, WHITE = 3, 252  # luma up to and from which a pixel counts as clipped


def banded(value: Column, bands: Sequence[tuple[float | None, str]], inclusive: bool = False) -> Column:
    """Name of the first band whose bound lies above the value (or on it, if inclusive); null stays null."""
    out = F.lit(bands[-1][1])
    for bound, name in reversed(bands[:-1]):
        out = F.when(value <= bound if inclusive else value < bound, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def duration_band(seconds: Column) -> Column:
    return banded(seconds, DURATION_BANDS)


def size_band(size: Column) -> Column:
    return banded(size, SIZE_BANDS, inclusive=True)


def likeness(distance: Column) -> Column:
    return banded(distance, LIKENESS)


def clamp01(x: Column) -> Column:
    """Between 0 and 1; null stays null, which a bare least or greatest would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; vectors of different lengths raise."""
    square = lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    distance = F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(distance)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def exposure_score(luma: Column, shadows: Column, highlights: Column) -> Column:
    off = luma - BEST_LUMA
    return clamp01(F.exp(-(off * off) / (2 * LUMA_WIDTH**2)) * (1 - F.least(F.lit(1.0) + 0 * luma, CLIP_PENALTY * (shadows + highlights))))


def horizon_score(angle: Column) -> Column:
    return F.exp(-TILT_DECAY * F.abs(angle))


def eyes_score(faces: Column) -> Column:
    """The worst measured eye of all faces; eyes not measured do not count."""
    return F.array_min(F.transform(faces, lambda f: F.array_min(F.array(clamp01(f["left_eye_open"]), clamp01(f["right_eye_open"])))))


def smile_score(faces: Column) -> Column:
    return clamp01(F.array_min(F.transform(faces, lambda f: f["smiling"])) / 2 + 0.5)


def capture_score(faces: Column) -> Column:
    return clamp01(F.array_min(F.transform(faces, lambda f: f["capture_quality"])))


def framing_score(faces: Column) -> Column:
    """How central and how far inside the frame the largest face is; of equally large ones the first."""
    box = F.transform(faces, lambda f: f["bounding_box"])
    areas = F.transform(box, lambda b: b["w"] * b["h"])
    main = F.try_element_at(box, F.array_position(areas, F.array_max(areas)).cast("int"))
    x, y, w, h = (main[k] for k in "xywh")
    inside = F.least(x, y, 1 - (x + w), 1 - (y + h))
    centred = F.exp(-CENTRE_DECAY * F.sqrt(F.pow(x + w / 2 - 0.5, F.lit(2.0)) + F.pow(y + h / 2 - 0.5, F.lit(2.0))))
    return F.when(F.size(faces) > 0, centred * F.when(inside < 0, F.greatest(F.lit(0.0), 1 + CUT_PENALTY * inside)).otherwise(1.0))


def extent(points: Column, axis: str) -> Column:
    values = F.transform(points, lambda p: p[axis])
    return F.array_max(values) - F.array_min(values)


def eye_aspect_ratio(points: Column, box_aspect: Column) -> Column:
    """Height by width of an eye's outline; fewer than two points or no width: 0."""
    width = extent(points, "x")
    return F.when((F.size(points) >= 2) & (width > 0), extent(points, "y") / width * box_aspect).otherwise(0.0)


def smile_curvature(points: Column, box_aspect: Column) -> Column:
    """How far the corners of a mouth stand above its middle, by its width; fewer than three points or no width: 0."""
    width, xs = extent(points, "x"), F.transform(points, lambda p: p["x"])
    corner = lambda pick: F.element_at(points, F.array_position(xs, pick(xs)).cast("int"))["y"]
    middle = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(points)
    return F.when((F.size(points) >= 3) & (width > 0), ((corner(F.array_min) + corner(F.array_max)) / 2 - middle) / width * box_aspect).otherwise(0.0)


def weighted_total(weights: dict[str, float], values: dict[str, Column], used: dict[str, Column] | None = None) -> Column:
    """Mean of the values that are not null, by weight, in the order of the weights; no weight at all: 0."""
    parts = [(F.lit(w).cast("double"), F.when(used[n], values[n]) if used else values[n]) for n, w in weights.items() if n in values]
    up = reduce(lambda s, x: s + F.coalesce(x[0] * x[1], F.lit(0.0)), parts, F.lit(0.0))
    down = reduce(lambda s, x: s + F.when(x[1].isNotNull(), x[0]).otherwise(F.lit(0.0)), parts, F.lit(0.0))
    return F.when(down > 0, up / down).otherwise(F.lit(0.0))


def human_size(size: Column) -> Column:
    """Bytes in the largest unit that leaves less than 1024 of it, with one decimal from KB on."""
    out = F.format_string("%.1f TB", size / 1024.0**4)
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", size / 1024.0**k)).otherwise(out)
    return out


def trip_title(start: Column, end: Column) -> Column:
    """Dates of a range with what both ends share said once."""
    full, day, month = (lambda c, f=f: F.date_format(c, f) for f in ("MMM d, yyyy", "d, yyyy", "MMM d"))
    same = lambda f: F.date_format(start, f) == F.date_format(end, f)
    return (
        F.when(F.to_date(start) == F.to_date(end), full(start))
        .when(same("yyyyMM"), F.concat(month(start), F.lit(" - "), day(end)))
        .when(same("yyyy"), F.concat(month(start), F.lit(" - "), full(end)))
        .otherwise(F.concat(full(start), F.lit(" - "), full(end)))
    )


def mod_key(mod_date: Column) -> Column:
    """Text that two states of a photo are compared by: equal instants in other zones differ."""
    return F.coalesce(mod_date, F.lit(""))


def action_key(kind: Column, target: Column) -> Column:
    return F.concat_ws(":", kind, target)


def album_name(path: Column) -> Column:
    """The name in ``Cull/<name>``; any other path raises."""
    name = F.regexp_extract(path, r"^Cull/([^/]+)$", 1)
    return F.when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("not an album path: "), path)).cast("string"))


def half_even(x: Column) -> Column:
    return F.bround(x).cast("bigint")


def mm_to_px(mm: float, dpi: int) -> int:
    return round(mm / 25.4 * dpi)


def crop_rect(width: Column, height: Column, target_w: int, target_h: int, offset_x: Column, offset_y: Column) -> Column:
    """The largest part of an image in the target's proportions, moved within what is left over by the offsets."""
    ratio = target_w / target_h
    wide = (width / height) > ratio
    w = F.least(F.when(wide, half_even(height * ratio)).otherwise(width.cast("bigint")), width.cast("bigint"))
    h = F.least(F.when(wide, height.cast("bigint")).otherwise(half_even(width / ratio)), height.cast("bigint"))
    return F.struct(half_even((width - w) * clamp01(offset_x)).alias("x"), half_even((height - h) * clamp01(offset_y)).alias("y"), w.alias("width"), h.alias("height"))


def page_boxes(width: int, height: int, bleed_mm: float = 0.0, marks: bool = False, dpi: int = 300) -> dict[str, tuple[int, int, int, int]]:
    """(x, y, width, height) of the page, of the image with its bleed and of the trim, from the lower left."""
    bleed = mm_to_px(bleed_mm, dpi)
    margin = (mm_to_px(MARK_GAP_MM, dpi) + mm_to_px(MARK_LENGTH_MM, dpi)) if marks else 0
    image = (margin, margin, width + 2 * bleed, height + 2 * bleed)
    return {"page": (0, 0, image[2] + 2 * margin, image[3] + 2 * margin), "image": image, "trim": (margin + bleed, margin + bleed, width, height)}


def crop_marks(boxes: dict[str, tuple[int, int, int, int]], dpi: int = 300) -> list[tuple[int, int, int, int]]:
    """(x1, y1, x2, y2) of two marks at each corner of the trim, outside the image; none on a page without margin."""
    gap, long = mm_to_px(MARK_GAP_MM, dpi), mm_to_px(MARK_LENGTH_MM, dpi)
    (ix, iy, iw, ih), (tx, ty, tw, th) = boxes["image"], boxes["trim"]
    if not ix:
        return []
    rows = ((ty, iy - gap, iy - gap - long), (ty + th, iy + ih + gap, iy + ih + gap + long))
    columns = ((tx, ix - gap, ix - gap - long), (tx + tw, ix + iw + gap, ix + iw + gap + long))
    return [m for x, x1, x2 in columns for y, y1, y2 in rows for m in ((x, y1, x, y2), (x1, y, x2, y))]
