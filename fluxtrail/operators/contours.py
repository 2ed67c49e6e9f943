"""Borders of pixel components by border following, and the segments along their normals to the far side."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

SEGMENTS = "frame long, label long, k long, x long, y long, to_x double, to_y double, length double"
#: The eight neighbours of a pixel, in turn from the left one.
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))

Pixel = tuple[int, int]


def components(points: set[Pixel]) -> list[set[Pixel]]:
    """The 8-connected components, in order of their first pixel (least y, then x)."""
    out, left = [], set(points)
    for first in sorted(points, key=lambda p: (p[1], p[0])):
        if first not in left:
            continue
        own, todo = set(), [first]
        left.discard(first)
        while todo:
            x, y = todo.pop()
            own.add((x, y))
            for dx, dy in AROUND:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        out.append(own)
    return out


def border(own: set[Pixel]) -> list[Pixel]:
    """The outer border of a connected set, followed once around from its first pixel; a pixel passed twice is there twice.

    From each pixel the neighbours are looked at in turn, from the one after the background pixel last seen; the way ends
    where the first step would be taken again.
    """
    first = min(own, key=lambda p: (p[1], p[0]))
    out, at, back = [first], first, 0  # what lies left of the first pixel is background
    second = None
    while True:
        for k in range(1, 9):
            turn = (back + k) % 8
            step = (at[0] + AROUND[turn][0], at[1] + AROUND[turn][1])
            if step in own:
                break
        else:
            return out  # a lone pixel
        if at == first and step == second:
            return out[:-1]
        second = second or step
        seen = AROUND[(turn - 1) % 8]  # the background pixel looked at before
        behind = (at[0] + seen[0] - step[0], at[1] + seen[1] - step[1])
        at, back = step, AROUND.index(behind)
        out.append(at)


def inward(line: list[Pixel], k: int, own: set[Pixel], reach: int) -> tuple[float, float] | None:
    """The unit normal at the k-th border pixel that leads into the set, across the line through the pixels ``reach`` before and after."""
    (ax, ay), (bx, by) = line[(k - reach) % len(line)], line[(k + reach) % len(line)]
    length = math.hypot(bx - ax, by - ay)
    if not length:
        return None
    x, y = line[k]
    normals = [((ay - by) / length, (bx - ax) / length), ((by - ay) / length, (ax - bx) / length)]
    depth = [sum((math.floor(x + s * nx + 0.5), math.floor(y + s * ny + 0.5)) in own for s in (1, 2, 3)) for nx, ny in normals]
    return normals[0] if depth[0] >= depth[1] else normals[1]


def far_side(x: int, y: int, normal: tuple[float, float], own: set[Pixel], step: float = 0.25) -> tuple[float, float]:
    """The last point of the set on the way from a pixel along a normal."""
    n = 1
    while (math.floor(x + n * step * normal[0] + 0.5), math.floor(y + n * step * normal[1] + 0.5)) in own:
        n += 1
    return x + (n - 1) * step * normal[0], y + (n - 1) * step * normal[1]


def segments(pixels: DataFrame, every: int = 2, reach: int = 2) -> DataFrame:
    """SEGMENTS rows: of each component of pixels(frame, x, y) every ``every``-th border pixel, with the point where its normal
    leaves the component on the far side and their distance.

    A component is named by y * 65536 + x of its first pixel, its border pixels by their place along the border. A border
    that turns back on itself at a pixel has no normal there and a null far point. Repeated pixels count once; a frame,
    which the sensor bounds, is one task's rows.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out, frame = [], part["frame"].iloc[0]
        for own in components(set(zip(part["x"].tolist(), part["y"].tolist(), strict=True))):
            line = border(own)
            for k in range(0, len(line), every):
                x, y = line[k]
                normal = inward(line, k, own, reach)
                to = far_side(x, y, normal, own) if normal else (None, None)
                out.append((frame, line[0][1] * 65536 + line[0][0], k, x, y, *to, None if normal is None else math.hypot(to[0] - x, to[1] - y)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return pixels.select("frame", "x", "y").groupBy("frame").applyInPandas(run, SEGMENTS)
