"""Boxes in space behind boxes on the screen, under a perspective camera, with walls that stand in the way or in the view.

For an angle and a height, a box standing on the ground has four unknowns: its place, width and length. Each side of the
screen box is touched by the image of one of its eight corners, which is a linear equation in the unknowns; which corner it
is follows from the solution, so the corners are guessed, the equations solved, and the corners looked up anew until they stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxtrail.operators.folds import tasks

#: Half steps from the middle along width and length, and whether at the top, of the eight corners; base corners first, in turn.
CORNERS = np.array([(a, b, z) for z in (0, 1) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))], float) * (0.5, 0.5, 1)
SOLVED = "det_id long, k int, h double, x double, y double, w double, l double, rw double, rl double, rh double, hidden int, blocked boolean"
#: Angles in the first quarter turn, as a quarter turn more swaps width and length; at half of it both sides look alike.
ANGLES = tuple((k + 0.5) * np.pi / 20 for k in range(10))
HEIGHTS = (10.0, 20.0, 30.0, 40.0)
#: Ground segments x1, y1, x2, y2 with a height, as the scene's walls.
WALLS = ((150.0, 160.0, 330.0, 190.0, 25.0), (420.0, 260.0, 430.0, 420.0, 40.0))


def looking(place: Sequence[float], target: Sequence[float], focal: float, middle: tuple[float, float]) -> np.ndarray:
    """The 3 x 4 matrix of an upright camera at ``place`` that has ``target`` in the ``middle`` of the screen."""
    place = np.array(place, float)
    ahead = (np.array(target, float) - place) / np.linalg.norm(np.array(target, float) - place)
    right = np.cross(ahead, (0.0, 0.0, 1.0))
    right /= np.linalg.norm(right)
    turned = np.stack([right, np.cross(ahead, right), ahead])
    inner = np.array([[focal, 0, middle[0]], [0, focal, middle[1]], [0, 0, 1]])
    return inner @ turned @ np.concatenate([np.eye(3), -place[:, None]], 1)


#: A camera above the front of the scene; a unit on the ground is about a pixel wide in the middle of the screen.
CAMERA = looking((320, -920, 900), (320, 240, 0), 1468.0, (320, 240))


def camera_of(matrix: np.ndarray) -> np.ndarray:
    """The camera's place: the point that the matrix sends nowhere."""
    return np.linalg.solve(matrix[:, :3], -matrix[:, 3])


def corner_points(x: np.ndarray, y: np.ndarray, w: np.ndarray, l: np.ndarray, h: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """The corners (rows x 8 x 3) of boxes."""
    a, b = CORNERS[:, 0] * w[:, None], CORNERS[:, 1] * l[:, None]
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    return np.stack([x[:, None] + a * c - b * s, y[:, None] + a * s + b * c, CORNERS[:, 2] * h[:, None]], 2)


def projected(matrix: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image coordinates and depths of points (... x 3)."""
    u, v, d = np.moveaxis(points @ matrix[:, :3].T + matrix[:, 3], -1, 0)
    return u / d, v / d, d


def touching(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The corners (4 x rows) that touch the left, bottom, right and top side of the boxes' images, by their corners' coordinates (8 x rows)."""
    return np.stack([u.argmin(0), v.argmax(0), u.argmax(0), v.argmin(0)])


def solve(sides: np.ndarray, h: np.ndarray, angle: np.ndarray, matrix: np.ndarray, size: float = 20.0, most: int = 12) -> dict[str, np.ndarray]:
    """Boxes of heights ``h`` and ``angle`` whose images have the ``sides`` (rows x left, bottom, right, top), with corners guessed up to ``most`` times.

    ``ok``: width and length are positive, the box is before the camera, and its eight corners touch the four sides within
    half a pixel. ``corner``: the corner at each side. ``slope`` (rows x 2 x 4): how width and length change with each side.
    """
    n = len(sides)
    with np.errstate(all="ignore"):
        foot = np.linalg.solve(np.stack([matrix[0, :2] - sides[:, [0, 2]].mean(1)[:, None] * matrix[2, :2], matrix[1, :2] - sides[:, 1:2] * matrix[2, :2]], 1), -np.stack([matrix[0, 3] - sides[:, [0, 2]].mean(1) * matrix[2, 3], matrix[1, 3] - sides[:, 1] * matrix[2, 3]], 1)[:, :, None])[:, :, 0]
        c, s = np.cos(angle), np.sin(angle)
        # of the four sides: the row of the matrix less the side times the row of the depth; along the box's own width and length
        rows = np.stack([matrix[i % 2][:, None] - sides[:, i] * matrix[2][:, None] for i in range(4)])
        wide, long, up, rest = c * rows[:, 0] + s * rows[:, 1], c * rows[:, 1] - s * rows[:, 0], rows[:, 2] * h, rows[:, 3]
        along = np.stack([c * matrix[:, :1] + s * matrix[:, 1:2], c * matrix[:, 1:2] - s * matrix[:, :1], matrix[:, 2:3] * h])

        def images(unknowns: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Image coordinates and depths (8 x rows) of the corners, in the order of CORNERS."""
            x, y, w, l = unknowns
            aw, al, top = along[:, :, own]
            middle, half_w, half_l = aw * x + al * y + matrix[:, 3:], aw * (w / 2), al * (l / 2)
            low, high = middle - half_w, middle + half_w
            base = np.stack([low - half_l, high - half_l, high + half_l, low + half_l])
            u, v, d = np.moveaxis(np.concatenate([base, base + top]), 1, 0)
            return u / d, v / d, d

        every = np.arange(n)
        u, v, _ = images(np.stack([c * foot[:, 0] + s * foot[:, 1], c * foot[:, 1] - s * foot[:, 0], np.full(n, size), np.full(n, size)]), every)
        corner = touching(u, v)
        inverse, unknowns, flat = np.zeros((2, 4, n)), np.zeros((4, n)), np.zeros(n, bool)
        left, before = every, np.full((4, n), -1)  # whose corners have changed, and those that they had before
        for turn in range(most):
            own, rw, rl = corner[:, left], wide[:, left], long[:, left]
            half_w, half_l, top = np.moveaxis(CORNERS[own], 2, 0)
            det, inner = inverted(np.stack([rw, rl, half_w * rw, half_l * rl], 1))
            flat[left] = np.abs(det) < 1e-9
            inverse[:, :, left] = inner[2:]
            unknowns[:, left] = -(inner * (top * up[:, left] + rest[:, left])).sum(1)
            u, v, _ = images(unknowns[:, left], left)
            found = touching(u, v)
            going = (found != own).any(0) & ~flat[left]
            if (most - turn) % 2:  # an even number of turns is left: corners that alternate would end as they are
                going &= (found != before[:, left]).any(0)
            corner[:, left], before[:, left] = found, own
            left = left[going]
            if not len(left):
                break
        u, v, depth = images(unknowns, every)
        w, l = unknowns[2:]
        x, y = c * unknowns[0] - s * unknowns[1], s * unknowns[0] + c * unknowns[1]
        off = np.abs(np.stack([u.min(0), v.max(0), u.max(0), v.min(0)], 1) - sides).max(1)
        slope = np.abs(np.moveaxis(inverse * np.take_along_axis(depth, corner, 0), 2, 0))
    return {"x": x, "y": y, "w": w, "l": l, "corner": corner.T, "points": corner_points(x, y, w, l, h, angle), "slope": slope, "ok": ~flat & (w > 0) & (l > 0) & (depth > 0).all(0) & (off < 0.5)}


def inverted(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The determinants, and the inverses by 2 x 2 minors, of many small matrices (4 x 4 x rows), element by element."""
    two = {(i, j): (m[0, i] * m[1, j] - m[1, i] * m[0, j], m[2, i] * m[3, j] - m[3, i] * m[2, j]) for i in range(4) for j in range(i + 1, 4)}
    det = sum(sign * two[i][0] * two[j][1] for sign, i, j in ((1, (0, 1), (2, 3)), (-1, (0, 2), (1, 3)), (1, (0, 3), (1, 2)), (1, (1, 2), (0, 3)), (-1, (1, 3), (0, 2)), (1, (2, 3), (0, 1))))
    out, over = np.empty_like(m), 1 / det
    for k in range(4):
        i, j, l = (x for x in range(4) if x != k)
        for row, other in ((0, 1), (1, 0), (2, 3), (3, 2)):
            own = m[other, i] * two[j, l][row < 2] - m[other, j] * two[i, l][row < 2] + m[other, l] * two[i, j][row < 2]
            out[k, row] = own * over if (k + row) % 2 == 0 else -own * over
    return det, out


def crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where on a-b and on c-d, 0 to 1, the lines of both meet; not a number where they are parallel."""
    r, s, q = b - a, d - c, c - a
    cross = lambda p, o: p[..., 0] * o[..., 1] - p[..., 1] * o[..., 0]
    with np.errstate(all="ignore"):
        return cross(q, s) / cross(r, s), cross(q, r) / cross(r, s)


def hidden(points: np.ndarray, walls: Sequence[Sequence[float]], camera: np.ndarray) -> np.ndarray:
    """Whether a wall, a ground segment x1, y1, x2, y2 with a height, stands between the camera and each point (... x 3)."""
    out = np.zeros(points.shape[:-1], bool)
    for x1, y1, x2, y2, height in walls:
        t, s = crossing(camera[:2], points[..., :2], np.array([x1, y1]), np.array([x2, y2]))
        z = camera[2] + t * (points[..., 2] - camera[2])
        out |= (t > 0) & (t < 1 - 1e-9) & (s >= 0) & (s <= 1) & (z < height)
    return out


def blocked(points: np.ndarray, walls: Sequence[Sequence[float]]) -> np.ndarray:
    """Whether a wall cuts the base (the first four corners, in turn) or stands within it."""
    base, out = points[:, :4, :2], np.zeros(len(points), bool)
    for x1, y1, x2, y2, _ in walls:
        c, d = np.array([x1, y1]), np.array([x2, y2])
        for k in range(4):
            t, s = crossing(base[:, k], base[:, (k + 1) % 4], c, d)
            out |= (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
        turn = [(base[:, (k + 1) % 4, 0] - base[:, k, 0]) * (y1 - base[:, k, 1]) - (base[:, (k + 1) % 4, 1] - base[:, k, 1]) * (x1 - base[:, k, 0]) for k in range(4)]
        out |= (np.sign(turn) >= 0).all(0) | (np.sign(turn) <= 0).all(0)
    return out


def solids(boxes: DataFrame, walls: Sequence[Sequence[float]] = (), angles: Sequence[float] = ANGLES, heights: Sequence[float] = HEIGHTS, matrix: np.ndarray = CAMERA, screen: tuple[int, int] = (640, 480)) -> DataFrame:
    """SOLVED rows: the boxes in space of boxes(det_id, xleft, xright, ytop, ybottom) for each of the angles and heights that has one.

    A side counts as hidden (bits of ``hidden``: 1 left, 2 bottom, 4 right, 8 top) where it lies on the screen's border or a
    wall hides the corner that touches it. ``rw`` and ``rl`` are the shares of width and length that come from sides not
    hidden, by how much each changes them; ``rh`` is the share of top and bottom not hidden. ``blocked``: a wall stands in
    the base. Boxes with a null side have none; work and memory are bounded by a batch of rows.
    """
    at = camera_of(matrix)
    grid = [(k, float(a), float(h)) for k, a in enumerate(angles) for h in heights]
    names = [f.split()[0] for f in SOLVED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.dropna(subset=["xleft", "xright", "ytop", "ybottom"])
            for i in range(0, len(batch), 250):  # what a core's cache holds
                part = batch.iloc[i : i + 250]
                own = part[["xleft", "ybottom", "xright", "ytop"]].to_numpy(float)
                sides = np.repeat(own, len(grid), 0)
                k, angle, h = (np.tile(np.array(c), len(part)) for c in zip(*grid, strict=True))
                got = solve(sides, h, angle, matrix)
                ok = got["ok"]
                points, corner, slope = got["points"][ok], got["corner"][ok], got["slope"][ok]
                border = np.stack([own[:, 0] <= 0, own[:, 1] >= screen[1] - 1, own[:, 2] >= screen[0] - 1, own[:, 3] <= 0], 1).repeat(len(grid), 0)[ok]
                unseen = border | np.take_along_axis(hidden(points, walls, at), corner, 1)
                rw, rl = ((slope * ~unseen[:, None, :]).sum(2) / slope.sum(2)).T
                rh = 1 - unseen[:, [1, 3]].mean(1)
                columns = [part["det_id"].to_numpy().repeat(len(grid))[ok], k[ok], h[ok], *(got[c][ok] for c in ("x", "y", "w", "l")), rw, rl, rh, unseen @ (1, 2, 4, 8), blocked(points, walls)]
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    return boxes.select("det_id", "xleft", "xright", "ytop", "ybottom").repartition(tasks(boxes), "det_id").mapInPandas(run, SOLVED)


def searched(solved: DataFrame, models: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """det_id, class, k, h, w, l, p, r, hidden, and the columns ``keep``: of SOLVED rows the best of each box and class of models(class, mean, sigma, lo, hi).

    Boxes in space whose base a wall blocks, and those with a dimension outside the class's limits, are left out. ``p`` is
    the mean of the dimensions' Gaussian scores, weighted by their reliabilities, ``r`` the mean reliability; the highest
    p * r is the best, of equals the first angle and least height. A box and class without any have no row.
    """
    columns = ["k", "h", "w", "l", "p", "r", "hidden", *keep]
    best = scored(solved, models).groupBy("det_id", "class").agg(F.min(F.struct("worth", *columns)).alias("best"))
    return best.select("det_id", "class", *(F.col(f"best.{c}") for c in columns))


def scored(solved: DataFrame, models: DataFrame) -> DataFrame:
    """The SOLVED rows that are not blocked with each class whose limits they keep, their p and r, and ``worth``, which is least for the best."""
    score = lambda d: F.exp(-F.pow(F.col(d) - F.col("mean"), 2) / (2 * F.col("sigma") * F.col("sigma")))
    within = [F.col(d).between(F.col("lo"), F.col("hi")) for d in "wlh"]
    rows = solved.filter(~F.col("blocked")).join(F.broadcast(models), within[0] & within[1] & within[2])
    weight = F.col("rw") + F.col("rl") + F.col("rh")
    p = F.when(weight > 0, sum(F.col(f"r{d}") * score(d) for d in "wlh") / weight).otherwise(0.0)
    return rows.withColumn("p", p).withColumn("r", weight / 3).withColumn("worth", -F.round(F.col("p") * F.col("r"), 9))


def footprints(boxes: DataFrame, solved: DataFrame, models: DataFrame, matrix: np.ndarray = CAMERA, shift: float = 500.0) -> DataFrame:
    """boxes(det_id, xleft, xright, ybottom, ...) with class, height_ and gl, gr, gt, gb: the bounds on the ground, moved by ``shift``, of the
    base of each box's best shape among ``models``.

    A box without a shape is UNKNOWN, has no height_, and stands with a square base, as deep as it is wide, where the middle
    of its lower side meets the ground.
    """
    best = searched(solved, models, ("x", "y")).withColumn("nth", F.row_number().over(W.partitionBy("det_id").orderBy(F.desc(F.round(F.col("p") * F.col("r"), 9)), "class"))).filter("nth = 1")
    shape = best.select("det_id", "class", "k", "h", "x", "y", "w", "l").hint("merge")  # Spark takes what Python makes for as small as what it reads
    c, s = (F.abs(f(F.lit(ANGLES[0]) + (ANGLES[1] - ANGLES[0]) * F.col("k"))) for f in (F.cos, F.sin))
    rows = boxes.join(shape, "det_id", "left")
    u, v = (F.col("xleft") + F.col("xright")) / 2, F.col("ybottom")
    (a, b, e), (d, f, g) = ([float(matrix[i, k]) - side * float(matrix[2, k]) for k in (0, 1, 3)] for i, side in ((0, u), (1, v)))
    det, half = a * f - b * d, (F.col("xright") - F.col("xleft") + 1) / 2
    x, y = F.coalesce("x", (b * g - e * f) / det), F.coalesce("y", (e * d - a * g) / det)
    wide, deep = F.coalesce((F.col("w") * c + F.col("l") * s) / 2, half), F.coalesce((F.col("w") * s + F.col("l") * c) / 2, half)
    sides = {"gl": x - wide, "gr": x + wide, "gt": y - deep, "gb": y + deep}
    return rows.select(*(F.col(f"`{n}`") for n in boxes.columns), F.coalesce("class", F.lit("UNKNOWN")).alias("class"), F.col("h").alias("height_"), *((side + shift).alias(n) for n, side in sides.items()))


def coherent(solved: DataFrame, models: DataFrame, seen: DataFrame) -> DataFrame:
    """det_id, class, k, h, w, l, off: the box in space of each seen(det_id, object_id, t_us) that goes best with its track.

    The track's shape is the mean of the best shapes before, weighted by their reliability, with their deviations, of one
    unit at least. Of all shapes within the class's limits the one with the least sum of deviations is taken; at the
    first sight the best one, with no ``off``. A box's shapes, one an angle and height at most, go with it, so they are solved once.
    """
    shape = F.struct("k", "h", "w", "l")
    found = scored(solved, models).groupBy("det_id", "class").agg(F.min(F.struct("worth", "k", "h", "w", "l", "r")).alias("best"), F.collect_list(shape).alias("shapes"))
    before = W.partitionBy("object_id", "class").orderBy("t_us", "det_id").rowsBetween(W.unboundedPreceding, -1)
    weight = F.greatest(F.col("best.r"), F.lit(0.01))
    track = seen.join(found.hint("merge"), "det_id")  # Spark takes what Python makes for as small as what it reads
    for d in "wlh":
        mean = F.sum(F.col(f"best.{d}") * weight).over(before) / F.sum(weight).over(before)
        track = track.withColumn(f"m{d}", mean).withColumn(f"s{d}", F.greatest(F.lit(1.0), F.stddev_pop(f"best.{d}").over(before)))
    off = lambda s: F.round(sum(F.abs(s[d] - F.col(f"m{d}")) / F.col(f"s{d}") for d in "wlh"), 6)
    fit = lambda s, off: F.struct(off.alias("off"), *(s[c].alias(c) for c in "khwl"))
    nearest = F.when(F.col("mw").isNull(), fit(F.col("best"), F.lit(None).cast("double"))).otherwise(F.array_min(F.transform("shapes", lambda s: fit(s, off(s)))))
    rows = track.select("det_id", "class", nearest.alias("n")).groupBy("det_id", "class").agg(F.min("n").alias("n"))
    return rows.select("det_id", "class", *(F.col(f"n.{c}") for c in "khwl"), "n.off")
