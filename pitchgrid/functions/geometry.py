"""Column expressions over boxes (x1, y1, x2, y2 in pixels) and points. All stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """Box of the columns `<prefix>x1` .. `<prefix>y2`."""
        return cls(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    @classmethod
    def field(cls, struct: Column) -> Box:
        return cls(*[struct[c] for c in ("x1", "y1", "x2", "y2")])

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0.0), self.width) * F.greatest(F.lit(0.0), self.height)

    @property
    def diagonal(self) -> Column:
        return F.sqrt(self.width * self.width + self.height * self.height)

    @property
    def aspect(self) -> Column:
        """max(w/h, h/w); infinite for a degenerate box."""
        w, h = self.width, self.height
        return F.when((w <= 0) | (h <= 0), F.lit(float("inf"))).otherwise(F.greatest(F.try_divide(w, h), F.try_divide(h, w)))


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return w * h


def _ratio(part: Column, whole: Column) -> Column:
    return F.when((part <= 0) | (whole <= 0), F.lit(0.0)).otherwise(F.try_divide(part, whole))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    return _ratio(inter, a.area + b.area - inter)


def containment(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return _ratio(intersection(a, b), F.least(a.area, b.area))


def ball_overlap(ball: Box, other: Box) -> Column:
    return intersection(ball, other) / F.greatest(ball.area, F.lit(1.0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_in_box(x: Column, y: Column, box: Box, margin: float = 0.0) -> Column:
    return x.between(box.x1 - margin, box.x2 + margin) & y.between(box.y1 - margin, box.y2 + margin)


def boxes_overlap(a: Box, b: Box, margin: float = 0.0) -> Column:
    return (a.x2 + margin >= b.x1) & (b.x2 + margin >= a.x1) & (a.y2 + margin >= b.y1) & (b.y2 + margin >= a.y1)


def boxes_cross(a: Box, b: Box) -> Column:
    """Strict: touching edges do not count."""
    return (a.x2 > b.x1) & (b.x2 > a.x1) & (a.y2 > b.y1) & (b.y2 > a.y1)


def point_in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting: parity of the edges to the right of the point."""
    hits = []
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:] + vertices[:1]):
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            hits.append((spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax)).cast("int"))
    return reduce(lambda a, b: a + b, hits) % 2 == 1


def clip_box(box: Box, width: int, height: int, pad: float = 0.0) -> Box:
    """Whole pixels inside the frame, at least one pixel wide and high."""
    low = lambda v, top: F.least(F.greatest(F.lit(0.0), F.floor(v - pad).cast("double")), F.lit(float(top - 1)))
    x1, y1 = low(box.x1, width), low(box.y1, height)
    high = lambda v, a, top: F.greatest(a + 1, F.least(F.lit(float(top)), F.ceil(v + pad).cast("double")))
    return Box(x1, y1, high(box.x2, x1, width), high(box.y2, y1, height))


def expand_box(box: Box, dx: float, top: float, bottom: float, width: int, height: int) -> Box:
    return Box(
        F.greatest(F.lit(0.0), box.x1 - dx), F.greatest(F.lit(0.0), box.y1 - top),
        F.least(F.lit(float(width)), box.x2 + dx), F.least(F.lit(float(height)), box.y2 + bottom),
    )


def mirror_box(box: Box, field: Box) -> Box:
    """Across the field's long axis: up and down in a tall field, left and right in a wide one."""
    tall = field.height > field.width
    return Box(
        F.when(tall, box.x1).otherwise(field.x1 + field.x2 - box.x2), F.when(tall, field.y1 + field.y2 - box.y2).otherwise(box.y1),
        F.when(tall, box.x2).otherwise(field.x1 + field.x2 - box.x1), F.when(tall, field.y1 + field.y2 - box.y1).otherwise(box.y2),
    )


def line_side(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Signed distance of a point to the directed line a -> b, positive on its right in pixel coordinates (y down)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return (dx * (y - a[1]) - dy * (x - a[0])) / float(np.hypot(dx, dy))


def segment_ratio(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Where a point falls along the segment a -> b: 0 at a, 1 at b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    return ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)


@dataclass(frozen=True)
class Pitch:
    """Homography from image pixels to metres, and the pitch's grid."""

    matrix: tuple[float, ...]
    length_m: float
    width_m: float

    @classmethod
    def fit(cls, image: list[tuple[float, float]], field: list[tuple[float, float]], length_m: float, width_m: float) -> Pitch:
        """Least squares over at least four pairs, with the last entry fixed to 1."""
        if len(image) != len(field) or len(image) < 4:
            raise ValueError("at least four pairs of points are needed")
        rows, right = [], []
        for (x, y), (u, v) in zip(image, field):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            right += [u, v]
        h = np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0]
        return cls((*map(float, h), 1.0), length_m, width_m)

    def project(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Metres; null where the point lies on the horizon."""
        m = self.matrix
        w = x * m[6] + y * m[7] + m[8]
        fine = F.when(F.abs(w) >= 1e-9, w)
        return (x * m[0] + y * m[1] + m[2]) / fine, (x * m[3] + y * m[4] + m[5]) / fine


def grid_cell(value: Column, limit: float, cells: int) -> Column:
    return F.least(F.greatest((value / limit * cells).cast("long"), F.lit(0).cast("long")), F.lit(cells - 1).cast("long"))


def zone_name(row: Column, col: Column) -> Column:
    return F.concat(F.lit("r"), (row + 1).cast("string"), F.lit("c"), (col + 1).cast("string"))


def phase(x_m: Column, length_m: float, team: Column) -> Column:
    """Third of the pitch from the team's view; blue attacks the other way."""
    third = F.when(x_m < length_m / 3, 0).when(x_m < 2 * length_m / 3, 1).otherwise(2)
    own = F.when(team == "blue", 2 - third).otherwise(third)
    return F.when(own == 0, "defensive").when(own == 1, "middle").otherwise("attacking")


def lane(y_m: Column, width_m: float) -> Column:
    return F.when(y_m < width_m / 3, "left").when(y_m < 2 * width_m / 3, "center").otherwise("right")


def hash_bucket(key: Column) -> Column:
    """Leading 32 bits of sha256 as a share of their largest value."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0
