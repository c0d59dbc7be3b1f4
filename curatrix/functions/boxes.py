"""Boxes as expressions: clipping, normalizing, conversions, measures, flags and overlap.

COCO boxes are [x, y, width, height] in pixels, label boxes are center x, center y, width, height as shares of the image, corner boxes are
x1, y1, x2, y2 in pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGED = 1e-9


def parts(bbox: Column) -> list[Column]:
    """The four numbers of a box; null where it is shorter."""
    return [F.get(bbox, F.lit(k)) for k in range(4)]


def clip(bbox: Column, width: Column, height: Column) -> Column:
    """struct<bbox array<double>, changed boolean> of an [x, y, w, h] box cut to its image; null if it hasn't four numbers or no area is left."""
    x, y, w, h = parts(bbox)
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most.cast("double")))
    x1, y1, x2, y2 = inside(x, width), inside(y, height), inside(x + w, width), inside(y + h, height)
    cut = F.array(x1, y1, x2 - x1, y2 - y1)
    changed = F.exists(F.zip_with(cut, bbox, lambda a, b: F.abs(a - b) > CHANGED), lambda c: c)
    ok = (F.size(bbox) == 4) & (w > 0) & (h > 0) & (x2 > x1) & (y2 > y1)
    return F.when(ok, F.struct(cut.alias("bbox"), changed.alias("changed")))


def to_center(bbox: Column, width: Column, height: Column) -> list[Column]:
    """x_center, y_center, width, height as shares of the image, of a COCO box."""
    x, y, w, h = parts(bbox)
    return [(x + w / 2) / width, (y + h / 2) / height, w / width, h / height]


def label_line(class_id: Column, bbox: Column, width: Column, height: Column) -> Column:
    """`class x y w h` with 8 decimals; a share outside 0..1 is an error."""
    shares = to_center(bbox, width, height)
    out_of_range = F.lit(False)
    for s in shares:
        out_of_range = out_of_range | ~s.between(0, 1)
    text = F.format_string("%d %.8f %.8f %.8f %.8f", class_id, *shares)
    return F.when(out_of_range, F.raise_error(F.lit("a normalized box is outside 0..1"))).otherwise(text)


def center_to_corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [(x - w / 2) * width, (y - h / 2) * height, (x + w / 2) * width, (y + h / 2) * height]


def xywh_to_corners(bbox: Column) -> list[Column]:
    x, y, w, h = parts(bbox)
    return [x, y, x + w, y + h]


def corners_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1, y1, x2 - x1, y2 - y1)


def measures(bbox: Column, width: Column, height: Column) -> dict[str, Column]:
    """Sizes in pixels and as shares of the image, and the ratio of width to height."""
    _, _, w, h = parts(bbox)
    return {
        "width_px": w, "height_px": h, "area_px": w * h, "width_norm": w / width, "height_norm": h / height,
        "area_norm": w * h / (width * height), "aspect_ratio": F.try_divide(w, h),
    }


def edge_gap(bbox: Column, width: Column, height: Column) -> Column:
    """The least distance to an edge of the image as a share of it; below 0 if the box sticks out."""
    x, y, w, h = parts(bbox)
    return F.least(x / width, y / height, (width - x - w) / width, (height - y - h) / height)


# fixed values: the limits of the outlier flags
TINY_SIDE, TINY_AREA, LARGE_AREA, BOUNDARY_GAP, THIN_RATIO = 4.0, 1e-4, 0.25, 0.01, 10.0


def outlier_flags(bbox: Column, width: Column, height: Column) -> Column:
    """The flags that apply, in this order: TINY, LARGE, BOUNDARY, THIN_ASPECT. The limits of TINY and LARGE are exclusive, the others inclusive."""
    _, _, w, h = parts(bbox)
    area = w * h / (width * height)
    ratio = F.greatest(F.try_divide(w, h), F.try_divide(h, w))
    return F.array_compact(
        F.array(
            F.when((F.least(w, h) < TINY_SIDE) | (area < TINY_AREA), "TINY"),
            F.when(area > LARGE_AREA, "LARGE"),
            F.when(edge_gap(bbox, width, height) <= BOUNDARY_GAP, "BOUNDARY"),
            F.when(ratio >= THIN_RATIO, "THIN_ASPECT"),
        )
    )


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Overlap of two corner boxes; sides that are negative count as 0, and so does an overlap of boxes without any area."""
    size = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    both = size(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * size(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    whole = size(a[0], a[2]) * size(a[1], a[3]) + size(b[0], b[2]) * size(b[1], b[3]) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def signature(items: Column, decimals: int = 6) -> Column:
    """A sorted array of (class, rounded box) from an array of struct<class, bbox>; equal for the same annotations in any order.

    Rounding is half up on the decimal value, so it may differ in the last digit from one on the binary value, at exact halves only.
    """
    return F.array_sort(F.transform(items, lambda i: F.struct(i["class"].alias("class"), F.transform(i["bbox"], lambda v: F.round(v, decimals)).alias("bbox"))))


def normalized_items(items: Column, width: Column, height: Column) -> Column:
    """The same items with boxes as shares of the image."""
    scale = F.array(width, height, width, height)
    return F.transform(items, lambda i: F.struct(i["class"].alias("class"), F.zip_with(i["bbox"], scale, lambda v, s: v / s).alias("bbox")))


def close(a: Column, b: Column, atol: float = 2e-6, rtol: float = 1e-5) -> Column:
    """|a - b| <= atol + rtol * |b|."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)
