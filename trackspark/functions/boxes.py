"""Bounding-box expressions on structs with fields ``x1, y1, x2, y2`` (or plain columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _d(value: float) -> Column:
    return F.lit(float(value))


def box(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    def as_col(c):
        return (F.col(c) if isinstance(c, str) else c).cast("double")

    return F.struct(
        as_col(x1).alias("x1"), as_col(y1).alias("y1"), as_col(x2).alias("x2"), as_col(y2).alias("y2")
    )


def box_from_array(bbox: str | Column) -> Column:
    """``[x1, y1, x2, y2]`` to a struct."""
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    return box(*[F.get(b, F.lit(i)) for i in range(4)])


def box_from_xywh(x="x", y="y", w="w", h="h") -> Column:
    return box(x, y, F.col(x) + F.col(w), F.col(y) + F.col(h))


def area(b: Column) -> Column:
    """Box area, never negative."""
    return F.greatest((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]), _d(0))


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), _d(0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), _d(0))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(_d(0))


def centre_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def aspect_ratio(b: Column) -> Column:
    """Width over height; NULL without a positive height."""
    h = b["y2"] - b["y1"]
    return F.when(h > 0, (b["x2"] - b["x1"]) / h)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def separation_score(
    n: Column,
    min_distance: Column,
    clustering: Column,
    overlapping: Column,
    *,
    min_objects: int = 3,
    min_separation: float = 0.15,
) -> Column:
    """0 when a gate fails, else ``min(min_distance, 1) * (1 - clustering)``."""
    blocked = (
        (n < min_objects)
        | (overlapping > 0)
        | (min_distance == _d(INF))
        | (min_distance < _d(min_separation))
    )
    return F.when(blocked, _d(0)).otherwise(F.least(min_distance, _d(1)) * (_d(1) - clustering))


def finite_mean(c: str | Column) -> Column:
    """Mean over finite values; 0 when there are none."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(F.when(col < _d(INF), col)), _d(0))


def union_box(bbox: str | Column = "box") -> list[Column]:
    """Aggregates for the box that covers all boxes of a group, truncated to pixels."""
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    return [
        F.min(b["x1"]).cast("int").alias("ux1"),
        F.min(b["y1"]).cast("int").alias("uy1"),
        F.max(b["x2"]).cast("int").alias("ux2"),
        F.max(b["y2"]).cast("int").alias("uy2"),
    ]


def crop_origin(centre: Column, size: int, extent: int) -> Column:
    """Top/left of a ``size`` crop around ``centre`` that stays inside ``extent``."""
    return F.greatest(F.lit(0), F.least(centre - F.lit(size // 2), F.lit(extent - size))).cast("int")


def patch_bounds(lo: Column, hi: Column, origin: Column, size: int, grid: int) -> tuple[Column, Column]:
    """First and past-the-end patch of the cell grid that an interval touches inside a crop."""
    scale = _d(grid / size)
    start = F.greatest(F.lit(0), lo - origin)
    end = F.least(F.lit(size), hi - origin)
    return (start * scale).cast("int"), F.least(F.lit(grid), (end * scale).cast("int") + 1)
