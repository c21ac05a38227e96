"""Bounding boxes ``array(y_min, x_min, y_max, x_max)`` and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(y_min: Column, x_min: Column, y_max: Column, x_max: Column) -> Column:
    return F.array(*[c.cast("double") for c in (y_min, x_min, y_max, x_max)])


def area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union."""
    height = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    width = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = height * width
    return F.try_divide(inter, area(a) + area(b) - inter)


def to_relative(b: Column, width: Column, height: Column) -> Column:
    """Pixels to shares of the image, clamped; null when the size is unknown."""
    zero, one = F.lit(0.0), F.lit(1.0)
    rel = F.array(
        F.greatest(zero, b[0] / height),
        F.greatest(zero, b[1] / width),
        F.least(one, b[2] / height),
        F.least(one, b[3] / width),
    )
    return F.when(b.isNotNull() & (width > 0) & (height > 0), rel)


def rotate(b: Column, width: Column, height: Column, angle: Column) -> Column:
    """Box after turning the image counter-clockwise by 90, 180 or 270 degrees."""
    quarter = F.array(b[1], height - b[2], b[3], height - b[0])
    half = F.array(height - b[2], width - b[3], height - b[0], width - b[1])
    three = F.array(width - b[3], b[0], width - b[1], b[2])
    return F.when(angle == 90, quarter).when(angle == 180, half).when(angle == 270, three).otherwise(b)


def crop(b: Column, width: Column, height: Column, angle: Column) -> Column:
    """Relative box to a rotated absolute crop."""
    absolute = F.array(b[0] * height, b[1] * width, b[2] * height, b[3] * width)
    return rotate(absolute, width, height, angle)


def union_box(boxes: Column, margin: float = 0.0) -> Column:
    """Envelope of an array of boxes, widened by ``margin`` on each side."""
    env = F.array(
        F.array_min(F.transform(boxes, lambda b: b[0])) - margin,
        F.array_min(F.transform(boxes, lambda b: b[1])) - margin,
        F.array_max(F.transform(boxes, lambda b: b[2])) + margin,
        F.array_max(F.transform(boxes, lambda b: b[3])) + margin,
    )
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) > 0, env)


def polygon_area(points: Column) -> Column:
    """Shoelace area of ``array<struct<x,y>>``."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def layout_box(points: Column, width: Column, height: Column, top: int = 999) -> Column:
    """Envelope of a word polygon on an integer 0..``top`` grid."""

    def scaled(value: Column, size: Column) -> Column:
        return F.least(F.greatest(F.floor(value * (top + 1) / size), F.lit(0)), F.lit(top)).cast("int")

    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(
        scaled(F.array_min(xs), width), scaled(F.array_min(ys), height),
        scaled(F.array_max(xs), width), scaled(F.array_max(ys), height),
    )


def rotation_angle(orientation: Column) -> Column:
    return (
        F.when(orientation.isin("up", "unknown"), 0)
        .when(orientation == "left", 90)
        .when(orientation == "down", 180)
        .when(orientation == "right", 270)
    )
