"""The folds, components, tracker and learner on planted cases, and every query without SQL gives rows twice alike."""

import math
import random

import pytest

from fluxtrail.operators import components, folds, learner, tracker
from fluxtrail.plans import catalog, session, stateful

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(stateful.QUERIES) - set(stateful.SQL)))
def test_reruns_agree(spark, name):
    first, second = (sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()), key=repr) for _ in range(2))
    assert first == second and first


def test_background_truncates(spark):
    px = spark.createDataFrame([(0, 0, f, v) for f, v in enumerate((100, 109, 255, 0))], "x long, y long, frame long, v long")
    assert [r.bg for r in folds.background(px).orderBy("frame").collect()] == [100, 100, 115, 103]


def test_constant_velocity_and_missing_data():
    state = folds.Attribute(rate=0.1)
    for t in range(12):
        state.see(float(t), 5.0 * t, 1.0)
    assert math.isclose(state.parts[1]["value"], 5.0, rel_tol=1e-6)
    assert math.isclose(state.estimate(1.0), 60.0, abs_tol=2.0)
    before = state.parts[0]["acc"]
    state.see(12.0, None, 0.0)
    assert state.parts[0]["acc"] < before and math.isclose(state.parts[0]["value"], 60.0, abs_tol=2.0)


def test_attributes_first_sample_and_empty(spark):
    shape = "object_id long, det_id long, t double, data double, rd double"
    one = folds.attributes(spark.createDataFrame([(1, 1, 0.0, 4.0, 0.5)], shape)).first()
    assert (one.value, one.sd, one.rc, one.v, one.a) == (4.0, 0.0, 1.0, 0.0, 0.0)
    assert folds.attributes(spark.createDataFrame([], shape)).count() == 0


def flood(points):
    out, left = [], set(points)
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((y, x))
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append((min(y * 65536 + x for y, x in own), len(own)))
    return sorted(out)


def test_pixel_components_against_flood_fill(spark):
    rng = random.Random(1)
    points = {(rng.randrange(14), rng.randrange(14)) for _ in range(70)} | {(0, 0)}
    df = spark.createDataFrame([(0, x, y) for y, x in points] * 2, "frame long, x long, y long")
    assert sorted((r.label, r.n) for r in components.pixel_components(df).collect()) == flood(points)


def test_runs_skip_and_bridge():
    assert components.runs_of([0, 2, 6], 1, 1) == [(0, 2), (6, 6)]
    assert components.runs_of([4], 2, 1) == []  # a lone pixel between sampled columns is not seen
    assert components.runs_of([4, 5], 2, 1) == [(4, 5)]
    assert components.runs_of([0, 3], 1, 1) == [(0, 0), (3, 3)]


def test_groups_of_a_chain(spark):
    session.prepare(spark)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.grp for r in components.groups(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_set_partitions_are_bell_numbers():
    assert [sum(1 for _ in components.partitions(n)) for n in range(1, 7)] == [1, 2, 5, 15, 52, 203]


def boxes(spark, rows):
    return spark.createDataFrame([("s", f, i, "k", x, x + 20, y, y + 20) for f, i, x, y in rows], "stream string, frame long, id long, kind string, l long, r long, t long, b long")


def test_two_objects_keep_their_ids(spark):
    rows = [(f, 2 * f, 10 + 5 * f, 50) for f in range(10)] + [(f, 2 * f + 1, 300 - 5 * f, 300) for f in range(10) if f != 5]
    found = tracker.track(boxes(spark, rows)).collect()
    last = {r.object_id: (round(r.l), r.status) for r in found if r.frame == 9}
    assert len(last) == 2 and {r.object_id for r in found} == set(last)
    assert sorted(abs(v[0] - x) < 8 for v, x in zip(sorted(last.values()), (55, 255), strict=True)) == [True, True]
    assert any(r.status == "LOST" for r in found if r.frame == 5)


def test_every_box_is_used(spark):
    rng = random.Random(3)
    rows = [(f, f * 10 + i, rng.randrange(60), rng.randrange(60)) for f in range(12) for i in range(3)]
    seen = {}
    for r in tracker.track(boxes(spark, rows)).collect():
        for blob in filter(None, r.used.split(",")):
            seen[r.frame, blob] = seen.get((r.frame, blob), 0) + 1
    assert seen and {k[1] for k in seen} == {str(r[1]) for r in rows}


def test_hierarchy_invariants(spark):
    rng = random.Random(5)
    rows = [("c", i % 4, float(i), rng.choice((0.0, 100.0, 400.0)) + rng.random(), "u") for i in range(200)]
    df = spark.createDataFrame(rows, "context string, object_id long, t double, x double, s string")
    out = learner.learn(df, {"x": 3.0}, ["s"]).collect()
    states = {r.id: r for r in out if r.kind == "state"}
    root = next(r for r in states.values() if r.parent == 0)
    assert root.n == 200
    for r in states.values():
        below = [c for c in states.values() if c.parent == r.id]
        assert not below or sum(c.n for c in below) == r.n and math.isclose(sum(c.p for c in below), 1, abs_tol=1e-4)
        assert all(float(s) >= 3.0 for s in r.sigmas.split(","))
    means = [float(r.means) for r in states.values()]
    assert all(any(abs(m - c) < 3 for m in means) for c in (0.5, 100.5, 400.5))
    assert any(r.kind == "event" for r in out)


def test_learner_takes_in_what_is_near():
    """One leaf for each far cluster, however often its points come, and every count adds up."""
    tree, rng = learner.Hierarchy([5.0, 5.0]), random.Random(4)
    spots = [(0.0, 0.0), (200.0, 0.0), (0.0, 200.0), (200.0, 200.0)]
    for _ in range(400):
        x, y = rng.choice(spots)
        tree.learn([x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)], ["a"])
    nodes = [tree.root]
    for node in nodes:
        nodes += node.children
        assert not node.children or node.n == sum(c.n for c in node.children)
    leaves = sorted((round(c.mean[0] / 200), round(c.mean[1] / 200)) for c in nodes if not c.children)
    assert tree.root.n == 400 and leaves == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_quality_weighs_numbers_and_symbols_apart():
    one = learner.Concept(1, [2.0, 4.0], [0.0, 0.0], ["a"])
    assert math.isclose(one.quality(), 1 / learner.NORM + 1)
    one.add([0.0, 0.0], ["b"])
    assert math.isclose(one.quality(), 1 / learner.NORM + 0.5)


def test_joint_versions_against_all_of_them():
    """The best joint versions of small frames, by listing every one of them."""
    import itertools

    rng, s = random.Random(7), tracker.Settings(per_object=1000)
    for _ in range(60):
        choices = []
        for k in range(rng.randrange(1, 6)):
            own = [tracker.Mobile(k, "k", tracker.Box(0, 9, 0, 9), p=rng.random(), frames=2 + k, used=tuple(sorted(rng.sample(range(5), rng.randrange(3))))) for _ in range(rng.randrange(1, 4))]
            choices.append(sorted(own, key=lambda m: -m.p))
        found = tracker.best_first(choices, s)
        good = [pick for pick in itertools.product(*choices) if len(u := [i for m in pick for i in m.used]) == len(set(u))]
        total = sum(c[0].frames for c in choices)
        want = sorted((sum(m.frames * m.p for m in pick) / total for pick in good), reverse=True)[: s.retained]
        if good:
            assert [h.probability() for h in found] == pytest.approx(want)
        else:
            assert len(found) >= 1


def test_configurations_differ(spark):
    """The three give different rows, and a box of another size is not taken by the planar one."""
    rng = random.Random(2)
    rows = [(f, f * 10 + i, rng.randrange(90), rng.randrange(90)) for f in range(14) for i in range(7)]
    found = {n: sorted((r.frame, r.object_id, r.status) for r in tracker.track(boxes(spark, rows), c).collect()) for n, c in tracker.CONFIGURATIONS.items()}
    assert found["spatial"] != found["planar"] != found["multi_model"]
    wide = spark.createDataFrame([("s", f, f, "k", 100, 120 + 200 * (f == 5), 100, 120 + 200 * (f == 5)) for f in range(6)], "stream string, frame long, id long, kind string, l long, r long, t long, b long")
    last = {n: [r.status for r in tracker.track(wide, c).collect() if r.frame == 5] for n, c in tracker.CONFIGURATIONS.items()}
    assert "LOST" in last["planar"] and "LOST" not in last["multi_model"]


def test_runs_join_with_the_row_above_alone(spark):
    """Components of runs against joining every pair of runs of neighbouring rows."""
    rng = random.Random(4)
    points = sorted({(rng.randrange(12), rng.randrange(20)) for _ in range(110)})
    rows = {}
    for y, x in points:
        rows.setdefault(y, []).append(x)
    runs = [(y, a, b) for y in sorted(rows) for a, b in components.runs_of(rows[y], 2, 1)]
    sets = components.Forest(len(runs))
    for j, (y, a, b) in enumerate(runs):
        above = max((r[0] for r in runs if r[0] < y), default=-9)
        for i, (v, c, d) in enumerate(runs[:j]):
            if v == above and y - v <= 2 and a - d <= 1 and c - b <= 2:
                sets.join(i, j)
    want = {}
    for i, (y, a, b) in enumerate(runs):
        want.setdefault(sets.top(i), []).append((y, a, b))
    want = sorted((min(y * 65536 + a for y, a, _ in own), sum(b - a + 1 for _, a, b in own)) for own in want.values())
    df = spark.createDataFrame([(0, x, y) for y, x in points], "frame long, x long, y long")
    assert sorted((r.label, r.n) for r in components.run_components(df).collect()) == want


def test_greedy_pairs(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.1), (2, 1, 1, 0.2)], "frame long, a long, b long, score double")
    assert sorted((r.frame, r.a, r.b) for r in components.corresponding(pairs).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]


def test_clip_against_a_grid(spark):
    """Areas of the common part of slanted convex polygons, by counting the points of a fine grid in both."""
    from fluxtrail.operators import classify

    rng = random.Random(6)
    rows, want = [], {}

    def ring():
        cx, cy, size = rng.uniform(30, 50), rng.uniform(30, 50), rng.uniform(10, 30)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(6))
        return [(cx + size * math.cos(a), cy + size * math.sin(a)) for a in angles]

    def inside(p, x, y):
        return all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(p, p[1:] + p[:1], strict=True))

    for k in range(12):
        p, q = ring(), ring()
        rows.append((k, [{"x": x, "y": y} for x, y in p], [{"x": x, "y": y} for x, y in q]))
        want[k] = sum(inside(p, x / 4, y / 4) and inside(q, x / 4, y / 4) for x in range(0, 340) for y in range(0, 340)) / 16
    shape = "id long, p array<struct<x double, y double>>, q array<struct<x double, y double>>"
    for r in classify.clipped(spark.createDataFrame(rows, shape)).collect():
        assert abs(r.area - want[r.id]) < 0.02 * want[r.id] + 6


def test_hull_holds_every_point(spark):
    from fluxtrail.operators import classify

    rng = random.Random(3)
    points = [(rng.gauss(0, 10), rng.gauss(0, 4)) for _ in range(80)]
    hull = [(p.x, p.y) for p in classify.hulls(spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in points])], "id long, points array<struct<x double, y double>>")).first().hull]
    turn = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    sides = list(zip(hull, hull[1:] + hull[:1], strict=True))
    assert set(hull) <= set(points) and all(turn(a, b, p) >= -1e-9 for a, b in sides for p in points)


def test_block_states_step_by_step(spark):
    """A block that stays like the background, one that another thing rests on until it is background, and one that moves."""
    ramp, other = [float(v) for v in range(16)], [float(v) for v in range(16, 0, -1)]
    rows = [(0, 0, f, False, ramp) for f in range(3)]
    rows += [(1, 0, 0, False, ramp)] + [(1, 0, f, False, other) for f in range(1, 25)]
    rows += [(2, 0, 0, True, ramp), (2, 0, 1, False, ramp), (2, 0, 2, True, ramp), (2, 0, 3, True, other), (2, 0, 4, True, other)]
    found = {}
    for r in folds.block_states(spark.createDataFrame(rows, "bx long, by_ long, frame long, moving boolean, px array<double>")).orderBy("bx", "frame").collect():
        found.setdefault(r.bx, []).append(r.code)
    assert found[0] == [folds.BACKGROUND] * 3
    assert found[1][:4] == [folds.BACKGROUND, folds.STILL_OBJ, folds.STILL_OBJ + 1, folds.STILL_OBJ + 2] and found[1][21:23] == [folds.STILL_OBJ + 20, folds.BACKGROUND]
    assert found[2] == [folds.UNDEFINED, folds.BACKGROUND, folds.ILLUM_CHANGE, folds.MOVING_OBJ, folds.MOVING_OBJ + 1]


def test_principal_components_and_clusters(spark):
    import numpy as np

    from fluxtrail.operators import classify

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [5, 2, 1, 0.5] + np.repeat([[0.0], [30.0], [60.0]], 20, axis=0)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, features array<double>")
    found = {r.id: r for r in classify.clusters(classify.principal(rows)).collect()}
    _, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose([abs(found[k].pcs[0]) for k in range(60)], abs(x @ vectors[:, -1]), atol=1e-6)
    assert len({tuple(sorted(k // 20 for k in found if found[k].cluster == c)) for c in range(3)}) == 3 and all(len({found[k].cluster for k in range(g, g + 20)}) == 1 for g in (0, 20, 40))


def test_blobs_take_in_what_lies_inside(spark):
    rows = [(1, 1, 0, 99, 0, 99, "PERSON", 0.9), (1, 2, 10, 20, 10, 20, "UNKNOWN", 0.9), (1, 3, 30, 40, 30, 40, "PERSON", 0.9), (1, 4, 50, 60, 50, 60, "PERSON", 0.1), (1, 5, 91, 110, 0, 9, "UNKNOWN", 0.9), (1, 6, 95, 104, 0, 9, "UNKNOWN", 0.9)]
    df = spark.createDataFrame(rows, "frame long, id long, l long, r long, t long, b long, kind string, p double")
    found = {r.id: (r.l, r.r, r.absorbed) for r in components.reduced(df).collect()}
    assert found == {1: (0, 99, 2), 3: (30, 40, 0), 5: (91, 110, 1)}
