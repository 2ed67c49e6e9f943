"""Images of class models and walls, static occlusion, polygons, and the supervised part."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtrail.operators import solid
from fluxtrail.plans import session

_WALLS = ", ".join(f"({k}, {x1}D, {y1}D, {x2}D, {y2}D, {z}D)" for k, (x1, y1, x2, y2, z) in enumerate(solid.WALLS))


def parallelepiped() -> str:
    """The image of a class's mean, least and largest box, standing with its middle at the box's foot, turned by its track's direction.

    The eight corners are sent through the scene's camera; ``base_width`` is the extent of the base along the screen's lower edge.
    """
    matrix = solid.CAMERA.tolist()
    row = lambda r, x, y, z: f"({r[0]}D*{x} + {r[1]}D*{y} + {r[2]}D*{z} + ({r[3]}D))"
    (a, b), (c, d) = ([f"({matrix[i][k]}D - {side}*({matrix[2][k]}D))" for k in range(2)] for i, side in ((0, "acx"), (1, "ab")))
    e, f = (f"({side}*({matrix[2][3]}D) - ({matrix[i][3]}D))" for i, side in ((0, "acx"), (1, "ab")))
    foot = f"({e}*{d} - {b}*{f})/({a}*{d} - {b}*{c}) AS x, ({a}*{f} - {e}*{c})/({a}*{d} - {b}*{c}) AS y"
    corners = ", ".join(f"({i}D, {k}D, {z}D)" for i in (-0.5, 0.5) for k in (-0.5, 0.5) for z in (0, 1))
    px, py = "(x + sx*n*co - sy*n*si)", "(y + sx*n*si + sy*n*co)"
    u, v = (f"{row(matrix[i], px, py, 'sz*n')}/{row(matrix[2], px, py, 'sz*n')}" for i in (0, 1))
    way = "sqrt(cast(greatest(1.0D, power(acx - bcx, 2) + power(acy - bcy, 2)) AS double))"
    return f"""f AS (SELECT det_id, {foot}, CASE WHEN acx = bcx AND acy = bcy THEN 1.0D ELSE (acx - bcx)/{way} END AS co, CASE WHEN acx = bcx AND acy = bcy THEN 0.0D ELSE (acy - bcy)/{way} END AS si FROM pairs),
 n AS (SELECT class, 'mean' AS which, mean AS n FROM models UNION ALL SELECT class, 'least', lo FROM models UNION ALL SELECT class, 'most', hi FROM models), k AS (SELECT * FROM (VALUES {corners}) AS k(sx, sy, sz)),
 q AS (SELECT det_id, class, which, sz, {u} AS u, {v} AS v FROM f CROSS JOIN n CROSS JOIN k)
--
SELECT det_id, class, which, round(max(CASE WHEN sz = 0 THEN u END) - min(CASE WHEN sz = 0 THEN u END), 4) AS base_width, round(min(u), 4) AS l, round(max(u), 4) AS r, round(min(v), 4) AS t, round(max(v), 4) AS b FROM q GROUP BY det_id, class, which"""


BODIES = {
    "geo_parallelepiped": parallelepiped(),
    "geo_wall_limits": f"h AS (SELECT * FROM (VALUES {_WALLS}) AS h(wall, x1, y1, x2, y2, height)), w AS (SELECT det_id, wall, acy, y1, y2, x1 + (acy - y1)*(x2 - x1)/(y2 - y1) AS wall_x, (acx - x1)*(y2 - y1) - (acy - y1)*(x2 - x1) AS f, (bcx - x1)*(y2 - y1) - (bcy - y1)*(x2 - x1) AS g, (x1 - bcx)*(acy - bcy) - (y1 - bcy)*(acx - bcx) AS p, (x2 - bcx)*(acy - bcy) - (y2 - bcy)*(acx - bcx) AS q FROM pairs CROSS JOIN h)\n--\nSELECT det_id, wall, round(wall_x, 4) AS wall_x, f < 0 AS before_wall, acy BETWEEN y1 AND y2 AS beside, sign(f)*sign(g) <= 0 AND sign(p)*sign(q) <= 0 AND NOT (f = 0 AND g = 0) AS crossed FROM w",
    "cls_static_occlusion": "SELECT det_id, zone, CASE WHEN ytop > y0 THEN 1 ELSE 0 END + CASE WHEN ybottom < y1 THEN 2 ELSE 0 END + CASE WHEN xleft > x0 THEN 4 ELSE 0 END + CASE WHEN xright < x1 THEN 8 ELSE 0 END AS flags FROM boxes JOIN zones ON xleft < x1 AND xright > x0 AND ytop < y1 AND ybottom > y0",
}


def clipped(pairs: DataFrame) -> DataFrame:
    """id, polygon, area: the intersection of convex polygons p and q (arrays of x, y structs in one turning sense).

    Cuts p by each edge of q in turn; null or fewer than three points give an empty polygon and area 0.
    """

    def cut(points: list, a: tuple, b: tuple) -> list:
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        out = []
        for k, p in enumerate(points):
            q = points[(k + 1) % len(points)]
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        return out

    def run(batches):
        for batch in batches:
            rows = []
            for number, p, q in zip(batch["id"], batch["p"], batch["q"], strict=True):
                p, q = ([] if x is None else [(v["x"], v["y"]) for v in x] for x in (p, q))
                points = p if len(p) > 2 and len(q) > 2 else []
                for a, b in zip(q, q[1:] + q[:1], strict=True):
                    points = cut(points, a, b) if points else []
                area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2
                rows.append((number, [{"x": x, "y": y} for x, y in points], area))
            yield pd.DataFrame(rows, columns=["id", "polygon", "area"])

    return pairs.select("id", "p", "q").mapInPandas(run, "id long, polygon array<struct<x double, y double>>, area double")


def hulls(contours: DataFrame) -> DataFrame:
    """id, hull, axis, area: convex hull, angle of the main axis and hull area of each contour(id, points), an array of x, y structs."""

    def hull(points: list) -> list:
        points = sorted(set(points))
        if len(points) < 3:
            return points
        halves = []
        for order in (points, points[::-1]):
            half: list = []
            for p in order:
                while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                    half.pop()
                half.append(p)
            halves += half[:-1]
        return halves

    def run(batches):
        for batch in batches:
            rows = []
            for number, points in zip(batch["id"], batch["points"], strict=True):
                own = hull([] if points is None else [(float(v["x"]), float(v["y"])) for v in points])
                axis = None
                if len(own) > 1:
                    spread = np.cov(np.array(own).T)
                    axis = round(float(0.5 * np.arctan2(2 * spread[0, 1], spread[0, 0] - spread[1, 1])), 6)
                area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(own, own[1:] + own[:1], strict=True))) / 2
                rows.append((number, [{"x": x, "y": y} for x, y in own], axis, area))
            yield pd.DataFrame(rows, columns=["id", "hull", "axis", "area"])

    return contours.select("id", "points").mapInPandas(run, "id long, hull array<struct<x double, y double>>, axis double, area double")


def principal(rows: DataFrame, features: str = "features", k: int = 2) -> DataFrame:
    """rows with ``pcs``, their first k principal components."""
    shaped = rows.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(shaped)
    return model.transform(shaped).withColumn("pcs", vector_to_array("_p")).drop("_v", "_p")


def clusters(rows: DataFrame, features: str = "pcs", k: int = 3, seed: int = 7, rounds: int = 100, starts: int = 10) -> DataFrame:
    """rows with ``cluster`` by k-means: the best of ``starts`` random starts. The rows are made once, for all starts, and checkpointed."""
    session.prepare(rows.sparkSession)
    shaped = rows.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))).checkpoint()
    each = [KMeans(k=k, seed=seed + i, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(shaped) for i in range(starts)]
    model = min(each, key=lambda m: m.summary.trainingCost)
    return model.transform(shaped).drop("_v")


def regressed(rows: DataFrame, folds: int = 10, rounds: int = 300, seed: int = 5) -> DataFrame:
    """id, y, guess of rows(id, features, y, weight): each row by a network m, m/2, 1 that learned from the other folds.

    A fold's training rows are one task's: this is for a labelled table of bounded size. With as many folds as ids, each row is
    left out alone. Steps follow the sign of the gradient with an adaptive size (resilient propagation).
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fold = part["fold"].iloc[0]
        own = part["own"].to_numpy() == fold
        x = np.array(part["features"].tolist(), float)
        y, w = part["y"].to_numpy(float), part["weight"].to_numpy(float)
        mean, scale = x[~own].mean(0), x[~own].std(0) + 1e-9
        x, centre, spread = (x - mean) / scale, y[~own].mean(), y[~own].std() + 1e-9
        target = (y - centre) / spread
        m = x.shape[1]
        inner, rng = max(1, m // 2), np.random.default_rng(seed)
        net = [rng.normal(0, 0.5, s) for s in ((m, inner), (inner,), (inner,), (1,))]
        size, last = [np.full(p.shape, 0.05) for p in net], [np.zeros(p.shape) for p in net]
        for _ in range(rounds):
            hidden = np.tanh(x[~own] @ net[0] + net[1])
            error = (hidden @ net[2] + net[3] - target[~own]) * w[~own]
            back = np.outer(error, net[2]) * (1 - hidden**2)
            for k, g in enumerate((x[~own].T @ back, back.sum(0), hidden.T @ error, np.array([error.sum()]))):
                turn = np.sign(g * last[k])
                size[k] = np.clip(np.where(turn > 0, size[k] * 1.2, np.where(turn < 0, size[k] * 0.5, size[k])), 1e-8, 1.0)
                last[k] = np.where(turn < 0, 0, g)
                net[k] = net[k] - np.sign(last[k]) * size[k]
        guess = (np.tanh(x[own] @ net[0] + net[1]) @ net[2] + net[3]) * spread + centre
        return pd.DataFrame({"id": part["id"][own], "y": y[own], "weight": w[own], "guess": guess})

    dealt = rows.select("id", "features", "y", "weight").withColumn("own", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int"))
    every = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    used = every.join(dealt.select(F.col("own").alias("fold")).distinct(), "fold", "left_semi")
    return used.groupBy("fold").applyInPandas(run, "id long, y double, weight double, guess double")
