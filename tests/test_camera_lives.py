"""Camera statements against numbers worked out apart, and the folds of lives on planted cases."""

import pytest

from fluxtrail.functions import camera, scene
from fluxtrail.operators import lives
from fluxtrail.plans import catalog
from fluxtrail.sources import relations

SF = "/root/testdata/sf0.001"


def project(x, y, z):
    a, b, c = (r[0] * x + r[1] * y + r[2] * z + r[3] for r in scene.P)
    return a / c, b / c


def ground(u, v):
    """The point of the ground plane at an image point, by Gauss elimination of the projection."""
    (a, b, e), (c, d, f) = ([scene.P[i][k] - w * scene.P[2][k] for k in (0, 1, 3)] for i, w in ((0, u), (1, v)))
    det = a * d - b * c
    return (b * f - d * e) / det, (c * e - a * f) / det


@pytest.fixture(scope="module")
def boxes(spark):
    return {r.det_id: r for r in relations.run(spark, SF, "SELECT * FROM boxes").collect()}


def test_lowest_height_lies_on_a_border(spark, boxes):
    found = catalog.QUERIES["geo_lowest_height"](spark, SF).filter("h > 1").collect()
    assert found
    for r in found:
        u, v = project(float(boxes[r.det_id].cx), float(boxes[r.det_id].cy), r.h)
        assert min(abs(u), abs(u - camera.WIDTH), abs(v), abs(v - camera.HEIGHT)) < 0.05


def test_plane_and_back(spark, boxes):
    for r in catalog.QUERIES["geo_hom_to_img"](spark, SF).collect():
        assert (r.u, r.v) == (pytest.approx(float(boxes[r.det_id].cx), abs=1e-3), pytest.approx(float(boxes[r.det_id].cy), abs=1e-3))


def test_camera_position(spark, boxes):
    codes = {r.det_id: r.code for r in catalog.QUERIES["geo_camera_position"](spark, SF).collect()}
    places = {r.det_id: (r.x, r.y) for r in catalog.QUERIES["geo_est_3d_position"](spark, SF).collect()}
    assert set(codes) == set(places) == set(boxes)
    for key, b in boxes.items():
        tip = lambda u, v: project(*ground(u, v), 100.0)
        row = 0 if tip(b.xleft, b.ybottom)[1] <= b.ybottom else 1 if tip(b.xleft, b.ytop)[1] <= b.ytop else 2
        edge = b.ytop if row else b.ybottom
        column = 2 if tip(b.xleft, edge)[0] >= b.xleft else 0 if tip(b.xright, edge)[0] <= b.xright else 1
        assert codes[key] == 3 * row + column
        at = ground((b.xleft + b.xright) / 2, (b.ybottom, (b.ytop + b.ybottom) / 2, b.ytop)[row])
        assert places[key] == pytest.approx(at, rel=1e-4, abs=1e-2)


def test_blob_lives(spark):
    rows = [(1, t, t, c, f) for t, (c, f) in enumerate([(0.0, True), (0.0, True), (0.05, True), (0.5, True), (0.0, True), (None, True), (0.9, False), (0.0, True), (0.0, True)])]
    found = lives.blob_lives(spark.createDataFrame(rows, "object_id long, t_us long, det_id long, cover double, fits boolean")).orderBy("det_id").collect()
    assert [(r.life, r.bad, r.deleted) for r in found] == [(1, 0, False), (1, 1, False), (1, 2, False), (1, 0, False), (1, 1, False), (1, 2, False), (1, 5, True), (2, 0, False), (2, 1, False)]


def test_focus(spark):
    shape = "stream string, frame long, x double, y double, x1 double, y1 double, x2 double, y2 double, half1 double, half2 double, length double"
    hull = lambda x, wide: (x, 0.0, x - 14, 0.0, x + 14, 0.0, 5.0 if wide == 1 else 1.0, 3.0, 28.0)
    none = (None,) * 7
    rows = [("a", 0, *hull(0.0, 2)), ("a", 1, *hull(10.0, 1)), ("a", 2, 20.0, 0.0, *none), ("a", 3, None, None, *none)]
    rows += [("a", f, None, None, *none) for f in range(4, 10)]
    found = lives.focus(spark.createDataFrame(rows, shape)).orderBy("frame").collect()
    assert [r["mode"] for r in found] == ["insert", "insert", "move"] + ["keep"] * 5 + ["lost"] * 2
    assert [r.head_x for r in found[:4]] == [14.0, 24.0, 34.0, 44.0]  # the sure head stays in front although the other end is broad once
    assert [r.x for r in found[:8]] == [10.0 * k for k in range(8)]
    assert lives.focus(spark.createDataFrame([], shape)).count() == 0


def test_weighted_gaussians(spark):
    shape = "key string, t_us long, det_id long, x double, w double"
    found = lives.weighted_gaussians(spark.createDataFrame([("a", 1, 1, 10.0, 1.0), ("a", 2, 2, 40.0, 2.0), ("a", 3, 3, None, 1.0), ("b", 1, 4, 7.0, 0.5), ("c", 1, 5, 7.0, 0.0)], shape), 3.0).orderBy("key").collect()
    assert [(r.key, r.n, r.mean) for r in found] == [("a", 2, 30.0), ("b", 1, 7.0)]
    assert found[1].sigma == 3.0 and found[0].sigma == pytest.approx((1 / 3 * (9 + 2 * 900 / 3)) ** 0.5, abs=1e-4)


def test_planar_stops(spark, boxes):
    """Against a walk over each object's samples; the half interval at each turn belongs to the state that it leaves or enters."""
    tracks = {}
    for b in sorted(boxes.values(), key=lambda b: (b.t_us, b.det_id)):
        tracks.setdefault(b.object_id, []).append((b.t_us / 3.6e9, float(b.cx), float(b.cy)))
    want = {}
    for key, points in tracks.items():
        stops, still, moving, rest, way = 0, 0.0, 0.0, None, 0.0
        for (t0, x0, y0), (t1, x1, y1) in zip(points, points[1:], strict=False):
            gap, step = t1 - t0, ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
            way += step
            if step <= 30.0 * gap:
                moving += gap / 2 if rest is None else 0.0
                rest = gap / 2 if rest is None else rest + gap
            elif rest is None:
                moving += gap
            else:
                rest, moving = rest if rest >= 12.0 else rest + gap / 2, moving + gap / 2
                stops, still, moving = (stops + 1, still + rest, moving) if rest >= 12.0 else (stops, still, moving + rest)
                rest = None
        if rest is not None and rest >= 12.0:
            stops, still = stops + 1, still + rest
        if len(points) > 1:
            want[key] = (stops, still, moving, way / stops if stops else None)
    found = {r.object_id: (r.stops, r.t_still, r.t_mov, r.dist_interval) for r in catalog.QUERIES["win_planar_stops"](spark, SF).collect()}
    assert set(found) == set(want) and sum(v[0] for v in want.values()) > 0
    for key, value in want.items():
        assert found[key][0] == value[0] and found[key][1:3] == pytest.approx(value[1:3], abs=1e-4)
        assert found[key][3] == value[3] or found[key][3] == pytest.approx(value[3], abs=1e-3)
