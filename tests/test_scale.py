"""Operators on crowded frames: the same rows as plain loops, with work that grows with the rows."""

import math
import random

from pyspark import TaskContext

from fluxtrail.operators import classify, components, folds, grid, learner, merging
from fluxtrail.plans import catalog, session


def test_nearest_looks_farther_only_where_nothing_is_near(spark):
    session.prepare(spark)
    rng = random.Random(1)
    points = [(k, rng.randrange(2), 6.0 * rng.randrange(20), float(rng.randrange(60))) for k in range(400)] + [(400, 0, 400.0, 400.0), (401, 1, 0.5, None)]
    places = [(k, k % 3, rng.uniform(0, 120), rng.uniform(0, 60)) for k in range(100)] + [(100, 0, 300.0, 300.0), (101, 0, 400.0, 251.0), (102, 0, 400.0, 249.0), (103, 1, None, 3.0)]
    shape = "det_id long, frame_id long, cx double, cy double"
    found = grid.nearest(spark.createDataFrame(places, shape), spark.createDataFrame(points, shape), (6, 30, 150))
    want = {}
    for k, frame, x, y in places:
        near = [((a - x) ** 2 + (b - y) ** 2, i) for i, f, a, b in points if f == frame and None not in (x, b)]
        if near and min(near)[0] <= 150**2:
            want[k] = min(near)[1]
    assert {r["det_id"]: r["nearest"] for r in found.collect()} == want and 100 in want and 102 not in want


def test_shapes_in_space_are_not_sent_to_the_driver(spark):
    """Spark takes what Python makes for as small as what it reads, and would broadcast the shapes of all boxes."""
    from fluxtrail.plans import stateful

    for found in (stateful.solid_tracks, stateful.bases, stateful.coherent):
        plan = found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert not joins, joins


def test_learner_tries_each_state_once_an_instance(monkeypatch):
    """A level's trials are the next one's, and the rows that an instance costs do not grow with what is asked again."""
    made = [0]
    first = learner.Concept.__init__

    def counted(self, *args):
        made[0] += 1
        first(self, *args)

    monkeypatch.setattr(learner.Concept, "__init__", counted)
    rng, tree = random.Random(3), learner.Hierarchy([6.0, 6.0])
    for _ in range(500):
        tree.learn([rng.choice((0, 20, 90, 200)) + rng.gauss(0, 4), rng.choice((0, 70)) + rng.gauss(0, 4)], [rng.choice("ab")])
    assert tree.states > 20 and made[0] <= 4 * tree.last_id + 500
    todo = [tree.root]
    while todo:  # what a trial foretells is what adding makes
        node = todo.pop()
        todo += node.children
        numbers = [x + 1 for x in node.mean]
        want = node.tried(numbers, ["a"])
        node.add(numbers, ["a"])
        node.known = None
        assert node.quality() == want[0] and abs(node.likelihood(numbers, ["a"]) - want[1]) < 1e-12


def test_learner_counts_events_without_pooling_them(monkeypatch):
    """A day's row has how many events there are, and makes none of them."""
    rng, tree = random.Random(5), learner.Hierarchy([6.0, 6.0])
    for k in range(600):
        found = tree.learn([rng.choice((0, 20, 90, 200)) + rng.gauss(0, 4), rng.choice((0, 70)) + rng.gauss(0, 4)], [rng.choice("ab")])
        tree.move(rng.randrange(9), found.id, float(k))
    want = len(tree.events())
    assert 50 < want < len(tree.edges)
    monkeypatch.setattr(learner.Dwell, "pool", None)
    assert tree.grown()[2:4] == (tree.states, want)


def test_learner_tries_an_instance_as_a_plain_loop_does():
    """A trial is written out for the counts of numbers and symbols; it gives the same to the last digit."""
    rng = random.Random(7)
    for count, symbols in ((0, 1), (1, 0), (2, 1), (3, 2)):
        assert learner.trial(count, symbols) is learner.trial(count, symbols)
        acuity = [rng.uniform(1, 5) for _ in range(count)]
        state = learner.Concept(1, acuity, [rng.uniform(0, 9) for _ in acuity], ["a"] * symbols)
        for _ in range(30):
            numbers, names = [rng.uniform(0, 9) for _ in acuity], [rng.choice("ab") for _ in range(symbols)]
            n, means, sigmas, sharp, pure = state.n + 1, [], [], 0.0, 0.0
            for x, m, s, a in zip(numbers, state.mean, state.sigma, acuity, strict=True):
                off = x - m
                means.append(m + off / n)
                sigmas.append(max(a, math.sqrt(state.n / n * (s * s + off * off / n))))
                sharp += a / sigmas[-1]
            for name, seen in zip(names, state.seen, strict=True):
                counts = dict(seen) | {name: seen.get(name, 0) + 1}
                pure += sum(v * v for v in counts.values()) / (n * n)
            want = sharp / learner.NORM / max(1, count) + pure / max(1, symbols)
            assert math.isclose(state.tried(numbers, names), want, rel_tol=1e-15)
            state.add(numbers, names)
            assert (list(state.mean), list(state.sigma), state.known) == (means, sigmas, state.sharper)
            assert [sum(v * v for v in seen.values()) for seen in state.seen] == state.squares


def test_ways_up_of_numbers_have_no_row_limit(spark):
    """As the recursive statement has them: with parents that are no nodes, without number 0 above others; and more than a million."""
    session.prepare(spark)
    ids = [0, 1, 2, 5, 11, 22, 40, -3]
    found = learner.numbered_ancestors(spark.createDataFrame([(k, int(k / 2)) for k in ids] + [(None, None)], "id long, parent long"))
    want = {(None, None, 0)}
    for k in ids:
        a, d = k, 0
        want.add((k, a, d))
        while a in ids and int(a / 2) > 0:
            a, d = a // 2, d + 1
            want.add((k, a, d))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    many = spark.range(1, 70_000).selectExpr("id", "id div 2 AS parent")
    assert learner.numbered_ancestors(many).count() == sum(k.bit_length() for k in range(1, 70_000)) > 1_000_000


def test_vibe_meets_earlier_frames_by_equal_keys(spark):
    plan = catalog.QUERIES["px_vibe"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_products_of_sets_are_whole(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:{k:02d}:00", k, "click" if k % 2 else "view", 10.0, '{"k": 9}') for k in range(26)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", frame["ts"].cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    assert catalog.QUERIES["join_hset_product"](spark, str(tmp_path)).count() == 13 * 13


def test_reduced_frames_equal_plain_loops(spark):
    """A crowded frame, in which boxes that grow take in others before and after them, in far fewer steps than pairs."""
    rng, rows = random.Random(7), []
    for k in range(500):
        l, t = rng.randrange(300), rng.randrange(200)
        rows.append((k % 2, k, l, l + rng.randrange(3, 60), t, t + rng.randrange(3, 60), rng.choice(("UNKNOWN", "PERSON")), rng.choice((0.1, 0.9))))
    want = []
    for frame in (0, 1):
        own = [[*r[:6], 0] for r in rows if r[0] == frame]
        limit = {r[1]: 0.8 if r[6] == "UNKNOWN" else 0.95 if r[7] < 0.3 else 1.0 for r in rows}
        gone = set()
        for a in own:
            grew = a[1] not in gone
            while grew:
                grew = False
                for b in own:
                    w, h = min(a[3], b[3]) - max(a[2], b[2]) + 1, min(a[5], b[5]) - max(a[4], b[4]) + 1
                    if a is not b and b[1] not in gone and w > 0 and h > 0 and w * h > limit[b[1]] * (b[3] - b[2] + 1) * (b[5] - b[4] + 1):
                        gone.add(b[1])
                        whole = [min(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), max(a[5], b[5])]
                        grew |= whole != a[2:6]
                        a[2:6], a[6] = whole, a[6] + 1
        want += [tuple(a) for a in own if a[1] not in gone]
    got = components.reduced(spark.createDataFrame(rows, "frame long, id long, l long, r long, t long, b long, kind string, p double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) < 400


def test_best_merges_equal_plain_choice():
    """Crowded boxes, some equal: at each step the best of all pairs is merged, as a plain search over all of them finds it."""
    rng = random.Random(5)
    p = lambda b: max(0.0, 1 - abs(b[1] - b[0] - 30) / 40) * max(0.0, 1 - abs(b[3] - b[2] - 30) / 40)
    for n in (0, 1, 12, 60):
        boxes = {}
        for k in rng.sample(range(1000), n):
            l, t = 6 * rng.randrange(30), rng.randrange(120)
            boxes[k] = rng.choice(list(boxes.values())) if boxes and rng.random() < 0.1 else (l, l + 7 + rng.randrange(20), t, t + 7 + rng.randrange(20))
        live = {k: (b, 1) for k, b in boxes.items()}
        while True:
            found = []
            for i in live:
                for j in live:
                    (a, _), (b, _) = live[i], live[j]
                    w, h = min(a[1], b[1]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[2], b[2]) + 1
                    small = min((c[1] - c[0] + 1) * (c[3] - c[2] + 1) for c in (a, b))
                    whole = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                    if i < j and w > 0 and h > 0 and w * h / small > 0.4:
                        found.append((0, -w * h / small, i, j, whole))
                    elif i < j and math.hypot(max(0, 1 - w), max(0, 1 - h)) < 10 and p(whole) > max(p(a), p(b)):
                        found.append((1, -p(whole), i, j, whole))
            if not found:
                break
            _, _, i, j, whole = min(found)
            live[i] = (whole, live[i][1] + live.pop(j)[1])
        assert merging.corresponding_merges(boxes, 0.4, 10.0, p) == live


def test_frames_are_matched_without_a_list_of_pairs(spark):
    """The greedy choice among all overlapping pairs of a frame and the one before; repeated ids, and more rivals than a box holds at once."""
    rng = random.Random(9)
    rows = [(f, k % 55, x, x + rng.choice((9, 14)), y, y + rng.choice((9, 14))) for f in (1, 2, 3, 5) for k in range(60) for x, y in [(3 * rng.randrange(8), 3 * rng.randrange(8))]]
    rows = [(*r, (r[3] - r[2] + 1) * (r[5] - r[4] + 1)) for r in rows]
    pairs = []
    for f, i, l, r, t, b, area in rows:
        for f2, j, l2, r2, t2, b2, area2 in rows:
            if f2 == f - 1 and max(l, l2) < min(r, r2) and max(t, t2) < min(b, b2):
                pairs.append((f, i, j, (min(r, r2) - max(l, l2) + 1) * (min(b, b2) - max(t, t2) + 1) / max(area, area2)))
    want = components.corresponding(spark.createDataFrame(pairs, "frame long, a long, b long, score double")).collect()
    found = components.matched(spark.createDataFrame([*rows, (2, 99, None, 5, 0, 5, 30)], "frame long, id long, l long, r long, t long, b long, area long")).collect()
    assert len(pairs) > 2000 and len(want) > 90 and sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_heavy_keys_have_a_task_each(spark):
    """By hash, view and error meet in one task."""
    kinds = ("view", "click", "error", "purchase", "signup")
    rows = spark.range(2000).selectExpr(f"element_at(array{kinds}, cast(id % 5 + 1 AS int)) AS kind", "id")

    def task(state, row):
        return [(row.kind, TaskContext.get().partitionId())]

    found = {tuple(r) for r in folds.ordered_fold(rows, ["kind"], ["id"], "kind string, task long", dict, task, heavy=True).collect()}
    assert {kind for kind, _ in found} == set(kinds) and len(found) == len({task for _, task in found}) == 5


def test_clusters_make_their_rows_once(spark):
    """All random starts read the same rows, which are not made anew for each."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(60).selectExpr("id", "array(id % 3 * 10.0D, id / 100.0D) AS pcs").mapInPandas(counted, "id long, pcs array<double>")
    found = classify.clusters(rows, starts=4).collect()
    assert len({(r.id % 3, r.cluster) for r in found}) == 3 and made.value <= 120
