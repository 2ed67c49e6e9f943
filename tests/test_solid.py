"""Boxes in space against boxes that were sent through the camera, and planted walls."""

import itertools
import math

import numpy as np
import pytest

from fluxtrail.operators import recursions, solid

BOXES = "det_id long, xleft double, xright double, ytop double, ybottom double"
MODELS = [("ANY", 20.0, 12.0, 4.0, 60.0)]


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    x, y, w, l, h = (rng.uniform(*r, n) for r in ((60, 580), (0, 450), (8, 40), (8, 60), (10, 40)))
    return x, y, w, l, h, rng.choice(solid.ANGLES, n)


def image(matrix, corners):
    """Left, bottom, right, top of the image of points, point by point."""
    seen = [[sum(matrix[i][k] * c for k, c in enumerate((*p, 1.0))) for i in range(3)] for p in corners]
    u, v = [a / d for a, _, d in seen], [b / d for _, b, d in seen]
    return min(u), max(v), max(u), min(v)


def standing(x, y, w, l, h, angle):
    c, s = math.cos(angle), math.sin(angle)
    return [(x + i * w / 2 * c - j * l / 2 * s, y + i * w / 2 * s + j * l / 2 * c, z) for i, j, z in itertools.product((-1, 1), (-1, 1), (0.0, h))]


@pytest.mark.parametrize("matrix", [solid.CAMERA, solid.looking((900, -400, 700), (320, 240, 0), 1000.0, (320, 240))])
def test_boxes_come_back(matrix):
    shapes = list(zip(*(a.tolist() for a in drawn(2000, 3)), strict=True))
    sides = np.array([image(matrix, standing(*b)) for b in shapes])
    got = solid.solve(sides, np.array([b[4] for b in shapes]), np.array([b[5] for b in shapes]), matrix)
    assert got["ok"].mean() > 0.99
    for k in np.flatnonzero(got["ok"])[:300]:
        found = image(matrix, standing(*(float(got[c][k]) for c in "xywl"), *shapes[k][4:]))
        assert all(abs(a - b) < 1e-6 for a, b in zip(found, sides[k], strict=True))
    same = np.abs(got["w"] - [b[2] for b in shapes]) + np.abs(got["l"] - [b[3] for b in shapes]) < 1e-6
    assert same.mean() > 0.99


def test_camera():
    assert np.allclose(solid.camera_of(solid.CAMERA), (320, -920, 900))
    u, v, d = solid.projected(solid.CAMERA, np.array([[320.0, 240.0, 0.0], [320.0, 240.0, 30.0], [330.0, 240.0, 0.0]]))
    assert np.allclose((u[0], v[0]), (320, 240)) and v[1] < v[0] and u[2] > u[0] and (d > 0).all()


def test_sides_of_real_boxes_are_touched(spark):
    """Every shape of every box has an image that touches all four sides within a pixel."""
    rows = spark.createDataFrame([(1, 100.0, 140.0, 200.0, 260.0), (2, 0.0, 30.0, 10.0, 40.0), (3, None, 5.0, 5.0, 5.0), (2, 0.0, 30.0, 10.0, 40.0), (4, 300.0, 300.0, 100.0, 100.0)], BOXES)
    found = solid.solids(rows).collect()
    by = {r.det_id: (r.xleft, r.ybottom, r.xright, r.ytop) for r in rows.collect()}
    assert {1, 2} <= {r.det_id for r in found} and 3 not in {r.det_id for r in found} and len(found) == len({(r.det_id, r.k, r.h) for r in found}) + sum(r.det_id == 2 for r in found) / 2
    for r in found:
        assert all(abs(a - b) < 1 for a, b in zip(image(solid.CAMERA, standing(r.x, r.y, r.w, r.l, r.h, solid.ANGLES[r.k])), by[r.det_id], strict=True))
        assert r.hidden & 1 == (r.det_id == 2)  # its left side is the screen's
    assert not solid.solids(rows.limit(0)).collect()


def test_hidden_and_blocked():
    """A wall of 50 between the camera and a point hides it up to where the sight passes over the wall."""
    wall, camera = [(-10.0, 5.0, 10.0, 5.0, 50.0)], np.array([0.0, -5.0, 100.0])
    points = np.array([[0.0, 15.0, 0.0], [0.0, 15.0, 30.0], [0.0, 0.0, 0.0], [40.0, 15.0, 0.0], [0.0, 2000.0, 0.0]])
    assert solid.hidden(points, wall, camera).tolist() == [False, False, False, False, False]  # sight at the wall is at 50, 65, -, -, 99.5
    assert solid.hidden(points, [(-10.0, 5.0, 10.0, 5.0, 60.0)], camera).tolist() == [True, False, False, False, False]
    at = lambda *b: np.array([[*standing(*b)]])
    base = solid.corner_points(*(np.array([v]) for v in (0.0, 0.0, 10.0, 20.0, 5.0, 0.3)))
    assert np.allclose(sorted(map(tuple, base[0].round(9))), sorted(map(tuple, at(0.0, 0.0, 10.0, 20.0, 5.0, 0.3)[0].round(9))))
    cases = {(0, 0, 1, 1): True, (-30, 1, 30, 2): True, (20, 20, 30, 30): False, (4, -40, 4, -20): False}
    for (x1, y1, x2, y2), want in cases.items():
        assert solid.blocked(base, [(x1, y1, x2, y2, 9.0)]).tolist() == [want]


def test_walls_flip_the_angle(spark):
    """A wall within the best shape's base, but not in another's, makes the search take another angle; one before it lowers its evidence."""
    models = spark.createDataFrame(MODELS, "class string, mean double, sigma double, lo double, hi double")
    sides = [float(v) for v in image(solid.CAMERA, standing(300.0, 200.0, 14.0, 30.0, 20.0, solid.ANGLES[2]))]
    box = spark.createDataFrame([(1, sides[0], sides[2], sides[3], sides[1])], BOXES)
    free = solid.solids(box)
    best = solid.searched(free, models).first()
    shapes = {(r.k, r.h): r for r in free.collect()}
    top = shapes[best.k, best.h]
    angle = solid.ANGLES[best.k]
    tip = [top.x + 0.45 * top.w * math.cos(angle) - 0.45 * top.l * math.sin(angle), top.y + 0.45 * top.w * math.sin(angle) + 0.45 * top.l * math.cos(angle)]
    walls = [(*tip, tip[0] + 0.01, tip[1] + 0.01, 1.0)]
    other = solid.searched(solid.solids(box, walls), models).first()
    assert (other.k, other.h) != (best.k, best.h) and other.p * other.r <= best.p * best.r
    before = [(200.0, 150.0, 400.0, 150.0, 60.0)]  # hides the lower side
    hidden = {(r.k, r.h): r for r in solid.solids(box, before).collect()}
    assert all(r.hidden & 2 and r.rh == 0.5 and r.rw < 1 or r.blocked for r in hidden.values())
    again = solid.searched(solid.solids(box, before), models).first()
    score = lambda d: math.exp(-((d - 20) ** 2) / 288)
    plain = {k: (r.rw * score(r.w) + r.rl * score(r.l) + r.rh * score(r.h)) / 3 for k, r in hidden.items() if not r.blocked and all(4 <= d <= 60 for d in (r.w, r.l, r.h))}
    assert math.isclose(again.p * again.r, max(plain.values()), rel_tol=1e-9) and again.p * again.r < best.p * best.r


def test_coherent_shapes(spark):
    """Of two shapes of one box the one like the track's is taken, not the one that is best alone."""
    models = spark.createDataFrame(MODELS, "class string, mean double, sigma double, lo double, hi double")
    shape = "det_id long, k int, h double, x double, y double, w double, l double, rw double, rl double, rh double, hidden int, blocked boolean"
    rows = [(d, 0, 20.0, 0.0, 0.0, 30.0, 12.0, 1.0, 1.0, 1.0, 0, False) for d in (1, 2)] + [(3, 0, 20.0, 0.0, 0.0, 20.0, 20.0, 1.0, 1.0, 1.0, 0, False), (3, 5, 20.0, 0.0, 0.0, 29.0, 12.0, 1.0, 1.0, 1.0, 0, False)]
    seen = spark.createDataFrame([(1, 7, 10), (2, 7, 20), (3, 7, 30), (9, 7, 40)], "det_id long, object_id long, t_us long")
    found = {r.det_id: (r.k, r.off) for r in solid.coherent(spark.createDataFrame(rows, shape), models, seen).collect()}
    assert found == {1: (0, None), 2: (0, 0.0), 3: (5, 1.0)}


SAMPLES = "object_id long, t_us long, det_id long, w double, l double, h double, alpha double, rw double, rl double, rh double"
HOUR = 3_600_000_000


def test_a_turning_object(spark):
    """An object that turns a tenth an hour through more than half a turn, seen with width and length swapped in every third row."""
    rows = []
    for k in range(60):
        angle, w, l = 0.1 * k, 10.0, 30.0
        if k % 3 == 2:
            angle, w, l = angle - math.pi / 2, l, w
        rows.append((1, k * HOUR, k, w, l, 20.0, angle % math.pi, 0.9, 0.7, 0.5))
    last = {r.det_id: r for r in recursions.mobile_shape(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert all(abs(r.w - 10) < 1e-3 and abs(r.l - 30) < 1e-3 and r.h == 20 for r in last.values())
    assert abs(last[59].turn - 0.1) < 0.01 and last[59].ra > 0.89
    assert math.isclose(last[59].cos2, math.cos(2 * 5.9), abs_tol=0.05) and math.isclose(last[59].sin2, math.sin(2 * 5.9), abs_tol=0.05)


def test_shapes_not_seen(spark):
    """Before a first shape all is null; without one later, values stay, reliability falls and the angle goes on turning."""
    rows = [(1, 0, 1, None, None, None, None, None, None, None)] + [(1, k * HOUR, k + 1, 10.0, 30.0, 20.0, 0.1 * k, 0.9, 0.7, 0.5) for k in range(1, 30)] + [(1, 30 * HOUR, 31, None, None, None, None, None, None, None), (None, 5, 90, 3.0, 4.0, 5.0, 0.0, 0.0, 0.0, 0.0)]
    found = {r.det_id: r for r in recursions.mobile_shape(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert found[1][1:] == (None,) * 10 and found[31].w == found[30].w and found[31].rw < found[30].rw and found[31].turn == found[30].turn
    turned = lambda r: math.atan2(r.sin2, r.cos2) / 2
    assert math.isclose((turned(found[31]) - turned(found[30])) % math.pi, found[30].turn, abs_tol=1e-3)
    assert (found[90].w, found[90].l, found[90].h, found[90].ra) == (3.0, 4.0, 5.0, 0.5)
    assert recursions.mobile_shape(spark.createDataFrame([], SAMPLES)).count() == 0


def test_footprints(spark):
    """A box's base on the ground is that of its best shape; a box too large for any class stands where its lower side meets the ground."""
    models = spark.createDataFrame(MODELS, "class string, mean double, sigma double, lo double, hi double")
    sides = [float(v) for v in image(solid.CAMERA, standing(300.0, 200.0, 20.0, 20.0, 20.0, solid.ANGLES[2]))]
    rows = spark.createDataFrame([(1, sides[0], sides[2], sides[3], sides[1]), (2, 100.0, 399.0, 20.0, 240.0)], BOXES)
    found = {r.det_id: r for r in solid.footprints(rows, solid.solids(rows), models, shift=0.0).collect()}
    best = solid.searched(solid.solids(rows), models).filter("det_id = 1").first()
    shape = next(r for r in solid.solids(rows).collect() if (r.det_id, r.k, r.h) == (1, best.k, best.h))
    base = standing(shape.x, shape.y, shape.w, shape.l, shape.h, solid.ANGLES[shape.k])
    want = min(p[0] for p in base), max(p[0] for p in base), min(p[1] for p in base), max(p[1] for p in base)
    assert np.allclose((found[1].gl, found[1].gr, found[1].gt, found[1].gb), want) and found[1]["class"] == "ANY" and found[1].height_ == best.h
    x, y = (found[2].gl + found[2].gr) / 2, (found[2].gt + found[2].gb) / 2
    assert np.allclose(image(solid.CAMERA, [(x, y, 0.0)])[:2], (249.5, 240.0)) and found[2]["class"] == "UNKNOWN" and found[2].gr - found[2].gl == 300


def test_inverses_by_minors():
    m = np.random.default_rng(3).normal(size=(4, 4, 200))
    det, inverse = solid.inverted(m)
    assert np.allclose(det, np.linalg.det(np.moveaxis(m, 2, 0))) and np.allclose(np.moveaxis(inverse, 2, 0), np.linalg.inv(np.moveaxis(m, 2, 0)))


def test_corners_that_alternate_are_solved_a_few_times(monkeypatch):
    """Most boxes have no shape at most angles, as their corners alternate; they end as they would after all turns."""
    rng, solved, inverted = np.random.default_rng(5), [], solid.inverted
    left, top = rng.uniform(0, 600, 500), rng.uniform(0, 440, 500)
    sides = np.stack([left, top + rng.uniform(8, 60, 500), left + rng.uniform(8, 48, 500), top], 1)
    h, angle = rng.choice(solid.HEIGHTS, 500), rng.choice(solid.ANGLES, 500)
    monkeypatch.setattr(solid, "inverted", lambda m: solved.append(m.shape[2]) or inverted(m))
    got = solid.solve(sides, h, angle, solid.CAMERA)
    assert 100 < got["ok"].sum() < 400 and sum(solved) < 4 * len(sides)
    for most in (13, 14):  # where corners alternate, an odd and an even number of turns end apart
        turns = solid.solve(sides, h, angle, solid.CAMERA, most=most)
        same = (turns["corner"] == got["corner"]).all(1)
        assert same.mean() < 0.9 if most == 13 else same.mean() > 0.99


def test_shapes_are_solved_once_for_a_track(spark):
    boxes = spark.createDataFrame([(k, 100 + 9 * k, 130 + 9 * k, 200, 240) for k in range(5)], "det_id long, xleft long, xright long, ytop long, ybottom long")
    models = spark.createDataFrame([("a", 20.0, 12.0, 4.0, 90.0)], "class string, mean double, sigma double, lo double, hi double")
    found = solid.coherent(solid.solids(boxes), models, boxes.selectExpr("det_id", "1 AS object_id", "det_id AS t_us"))
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInPandas") == 1
    assert sorted((r.det_id, r.off is None) for r in found.collect()) == [(k, k == 0) for k in range(5)]
