"""Partitions of groups and fewest merges against full enumeration; joins through the grid against all pairs."""

import itertools
import math
import random

import numpy as np

from fluxtrail.operators import components, grid, merging
from fluxtrail.operators.merging import Group, bits

SHAPE = "grp long, id long, l long, r long, t long, b long"


def drawn(rng, n, spread, most=30):
    return [(x, x + rng.randrange(5, most), y, y + rng.randrange(5, most)) for x, y in ((rng.randrange(spread), rng.randrange(spread)) for _ in range(n))]


def enumerated(group):
    """All partitions into connected, un-nested parts, from all set partitions."""
    n, out = len(group.boxes), set()
    for split in components.partitions(n):
        parts = [sum(1 << i for i in range(n) if split[i] == k) for k in range(max(split) + 1)]

        def whole(part):
            sets = components.Forest(n)
            for i, j in itertools.permutations(bits(part), 2):
                if group.apart(group.boxes[i], group.boxes[j]) < 8:
                    sets.join(i, j)
            return len({sets.top(i) for i in bits(part)}) == 1

        if all(map(whole, parts)) and not any(group.nested(p, q) for p, q in itertools.permutations(parts, 2)):
            out.add(tuple(parts))
    return out


def test_partitions_against_enumeration():
    rng = random.Random(8)
    for n in (1, 2, 4, 6, 7):
        for _ in range(4):
            group = Group(drawn(rng, n, 50), 8)
            found = [tuple(sorted(p, key=lambda x: x & -x)) for p in group.partitions(group.whole)]
            assert len(found) == len(set(found)) and set(found) == enumerated(group)


def test_partitions_of_a_long_chain(spark):
    """A chain of 14 squares has a partition for each set of its 13 links: none is left out, and all branches give each once."""
    rows = [(9, k, 30 * k, 30 * k + 22, 0, 22) for k in range(14)] + [(3, 50, 0, 5, 0, 5)]
    found = merging.merge_partitions(spark.createDataFrame(rows, SHAPE), near=10, rows=500)
    assert found.filter("grp = 9").count() == found.filter("grp = 9").distinct().count() == 2**13
    assert [tuple(r) for r in found.filter("grp = 3").collect()] == [(3, "0", 1)]
    assert not merging.merge_partitions(spark.createDataFrame([], SHAPE)).collect()


def test_partitions_are_of_the_frames_of_all_queries(spark, tmp_path):
    """Boxes of an hour are one frame however many detections lie between them, and those of two hours never meet."""
    from fluxtrail.plans import catalog

    rows = [(0, "2024-01-01 00:05:00", 9), (1, "2024-01-01 00:06:00", 60), (2, "2024-01-01 01:05:00", 9), (700, "2024-01-01 00:50:00", 11), (1400, "2024-01-01 01:50:00", 11)]
    frame = spark.createDataFrame([(k, at, k, "view", 10.0, f'{{"k": {x}}}') for k, at, x in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", frame["ts"].cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    found = sorted(map(tuple, catalog.QUERIES["merge_partitions"](spark, str(tmp_path)).collect()))
    assert {r[0] for r in found} == {0, 2} and {r[1:] for r in found if r[0] == 0} == {("0,0", 1), ("0,1", 2)}


def test_links_are_those_that_make_the_groups(spark, tmp_path):
    """Boxes that are near each way are one group, so they may be one part, with a corner between them too."""
    from fluxtrail.plans import catalog

    rows = [(0, 0, "2024-01-01 00:05:00", 10.0, 9), (41, 1, "2024-01-01 00:06:00", 26.0, 11)]  # eight to the right of, and eight below
    frame = spark.createDataFrame([(k, u, at, "view", v, f'{{"k": {x}}}') for k, u, at, v, x in rows], "event_id long, user_id long, ts string, event_type string, value double, props string")
    frame.withColumn("ts", frame["ts"].cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(tuple, catalog.QUERIES["merge_partitions"](spark, str(tmp_path)).collect())) == [(0, "0,0", 1), (0, "0,1", 2)]
    assert [(r.nth, r.partition) for r in catalog.QUERIES["trk_new_objects"](spark, str(tmp_path)).orderBy("nth").collect()] == [(0, "0,0"), (1, "0,1")]


def test_ways_to_keep_two_parts_apart_leave_out_no_way():
    """A part of its own that each of two others must not hold: the ways are those of all pairs, and come without growing many parts."""
    rng = random.Random(6)
    for _ in range(40):
        group = Group(drawn(rng, 7, 45), 8)
        found = [tuple(sorted(p, key=lambda x: x & -x)) for p in group.ranked()]
        assert len(found) == len(set(found)) and set(found) == enumerated(group)
    hole = Group([(25 * x, 25 * x + 20, 25 * y, 25 * y + 20) for x in range(10) for y in range(10) if not 4 <= x <= 5 or not 4 <= y <= 5] + [(122, 124, 122, 124)], 10)
    found = list(itertools.islice(hole.ranked(), 4))
    assert [sorted(p.bit_count() for p in parts) for parts in found] == [[1, 48, 48]] * 2 + [[1, 5, 43, 48], [1, 6, 43, 47]]


def test_fewest_merges_against_enumeration():
    rng = random.Random(2)
    for k in range(60):
        group = Group(drawn(rng, 2 + k % 7, 40), 8)
        fits = lambda b: b[1] - b[0] >= 24 and b[3] - b[2] >= 24
        sizes = [len(p) for p in enumerated(group) if all(fits(group.box(x)) for x in p)]
        linked = group.whole == 1 or len(list(group.partitions(group.whole))) and any(len(p) == 1 for p in group.partitions(group.whole))
        if not linked:  # groups are connected
            continue
        parts = merging.fewest_merges(group, fits)
        assert (parts and len(parts)) == (max(sizes) if sizes else None)
        assert parts is None or tuple(sorted(parts, key=lambda x: x & -x)) in enumerated(group)


def test_fewest_merges_of_large_groups(spark):
    """31 boxes in a chain of pairs that fit together, of which the last has to join another pair."""
    rows = [(1, k, 20 * k, 20 * k + 15, 0, 39) for k in range(31)] + [(2, 1, 0, 19, 0, 39), (2, 2, 20, 45, 0, 39), (2, 3, 46, 80, 0, 39), (3, 4, 0, 50, 0, 50), (4, 5, 0, 5, 0, 5)]
    found = {r.grp: (r.partition, r.merges) for r in merging.merge_search(spark.createDataFrame(rows, SHAPE)).collect()}
    assert found.keys() == {1, 2, 3} and found[1][1] == 16 and found[2] == ("0,0,1", 1) and found[3] == ("0", 0)
    assert not merging.merge_search(spark.createDataFrame([], SHAPE)).collect()


def test_grid_finds_each_pair_once(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, *((x, x + rng.randrange(0, 90), y, y + rng.randrange(0, 90)) if k % 17 else (None,) * 4)) for k in range(150) for x, y in [(rng.randrange(-200, 300), rng.randrange(-200, 300))]]
    spark.createDataFrame(rows, "id long, frame_id long, xleft long, xright long, ytop long, ybottom long").createOrReplaceTempView("grid_boxes")
    for reach in (0, 35):
        found = [tuple(r) for r in spark.sql(f"SELECT a.id, b.id FROM {grid.joined('grid_boxes', 'grid_boxes', reach=reach)} AND a.xleft - b.xright <= {reach} AND b.xleft - a.xright <= {reach} AND a.ytop - b.ybottom <= {reach} AND b.ytop - a.ybottom <= {reach}").collect()]
        want = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] is not None and b[2] is not None and a[2] - b[3] <= reach and b[2] - a[3] <= reach and a[4] - b[5] <= reach and b[4] - a[5] <= reach]
        assert sorted(found) == sorted(want)
    spark.catalog.dropTempView("grid_boxes")


def test_ranked_partitions():
    """All partitions come, once each, those of fewest parts first; the first few of a long chain come without the others."""
    rng = random.Random(5)
    for n in (1, 3, 5, 7):
        group = Group(drawn(rng, n, 40), 8)
        found = [tuple(sorted(p, key=lambda x: x & -x)) for p in group.ranked()]
        assert len(found) == len(set(found)) and set(found) == enumerated(group) and [len(p) for p in found] == sorted(map(len, found))
    chain = Group([(30 * k, 30 * k + 22, 0, 22) for k in range(60)], 10)
    assert [len(p) for p in itertools.islice(chain.ranked(), 62)] == [1] + [2] * 59 + [3] * 2


def test_first_ways_of_a_crowded_group():
    """The first ways come without the many that are not ways: no part in another, and as in the order of all where these can be listed."""
    rng = random.Random(4)
    crowd = Group([(x, x + rng.randrange(8, 49), y, y + rng.randrange(8, 53)) for x, y in ((6 * rng.randrange(25), rng.randrange(120)) for _ in range(25)) for _ in range(48)], 10)
    found = list(itertools.islice(crowd.ranked(), 10))
    assert [len(p) for p in found] == [1] + [2] * 9 and len(set(found)) == 10
    for parts in found:
        assert sum(parts) == crowd.whole and all(crowd.pieces(p) == [p] for p in parts) and not any(crowd.nested(p, q) for p, q in itertools.permutations(parts, 2))
    covered = Group([(0, 9 + k, 0, 9 + k) for k in range(60)], 10)
    assert list(covered.ranked()) == [(covered.whole,)]
    pair = Group([(0, 9 + k, 0, 9) for k in range(30)] + [(47 + k, 90, 18, 29) for k in range(25)], 10)  # two pieces by distance
    assert list(itertools.islice(pair.ranked(), 1)) == [(sum(1 << k for k in range(30)), sum(1 << k for k in range(30, 55)))]
    for n in (3, 5, 7):  # the order is that of growing all connected parts one by one
        group = Group(drawn(rng, n, 40), 8)

        def listed(left, n, parts, group=group):
            if n == 1:
                if group.pieces(left) == [left] and not any(group.nested(left, p) or group.nested(p, left) for p in parts):
                    yield (*parts, left)
                return
            for part in group.firsts(left):
                rest = left & ~part
                if rest.bit_count() >= n - 1 and not any(group.nested(part, p) or group.nested(p, part) for p in parts):
                    yield from listed(rest, n - 1, (*parts, part))

        assert list(group.ranked()) == [p for k in range(1, n + 1) for p in listed(group.whole, k, ())]


def test_stars_connect_what_pairs_connect(spark):
    """At most one edge a box, where a crowded frame has hundreds of pairs; a repeated or null id, and boxes 9 apart each way."""
    rng = random.Random(6)
    rows = [(k % 3, "ab"[k % 2], k, *box) for k, box in enumerate(drawn(rng, 240, 150))] + [(9, "a", 500, 0, 5, 0, 5), (9, "a", 501, 14, 20, 14, 20), (9, "a", 502, 30, 35, 0, 5), (9, "a", 500, 30, 32, 0, 5), (9, "a", None, 20, 30, 0, 9)]
    boxes = spark.createDataFrame(rows, "frame long, kind string, node long, l long, r long, t long, b long")
    edges = components.stars(boxes, components.closer(10), ["l", "r", "t", "b"])
    pairs = [(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[:2] == b[:2] and None not in (a[2], b[2]) and a[2] != b[2] and max(a[3] - b[4], b[3] - a[4], a[5] - b[6], b[5] - a[6]) < 10]
    assert len(pairs) > 400 and edges.count() <= len(rows)
    from fluxtrail.plans import session

    session.prepare(spark)
    want = components.groups(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, components.groups(edges).collect())) == sorted(map(tuple, want.collect()))


def test_new_objects(spark):
    rows = [(1, 1, 0, 19, 0, 39), (1, 2, 20, 45, 0, 39), (1, 3, 46, 80, 0, 39), (2, 4, 0, 50, 0, 50)]
    found = sorted((r.grp, r.nth, r.partition, r.p) for r in merging.new_objects(spark.createDataFrame(rows, SHAPE), retained=3).collect())
    assert found == [(1, 0, "0,0,0", 1.0), (1, 1, "0,1,1", 0.925), (1, 2, "0,0,1", 0.925), (2, 0, "0", 1.0)]


def test_merges_by_correspondence(spark):
    """The heap with its changing table against looking through all pairs after each merge."""
    rng = random.Random(12)
    models = [(20.0, 12.0, 4.0, 45.0)]
    p = lambda b: math.exp(-((b[1] - b[0] - 19) ** 2 + (b[3] - b[2] - 19) ** 2) / 288) if 4 <= min(b[1] - b[0], b[3] - b[2]) + 1 and max(b[1] - b[0], b[3] - b[2]) + 1 <= 45 else 0.0
    area = lambda a: (a[1] - a[0] + 1) * (a[3] - a[2] + 1)
    rows, want = [], []
    for frame in range(25):
        live = {10 * k: (box, 1) for k, box in enumerate(drawn(rng, rng.randrange(1, 12), 60, 20))}
        rows += [(frame, i, *box) for i, (box, _) in live.items()]
        while True:
            options = []
            for i, j in itertools.combinations(sorted(live), 2):
                a, b = live[i][0], live[j][0]
                both = max(0, min(a[1], b[1]) - max(a[0], b[0]) + 1) * max(0, min(a[3], b[3]) - max(a[2], b[2]) + 1)
                one = (min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]))
                if both / min(area(a), area(b)) > 0.4:
                    options.append((0, -both / min(area(a), area(b)), i, j, one))
                elif Group.apart(a, b) < 10 and p(one) > max(p(a), p(b)):
                    options.append((1, -p(one), i, j, one))
            if not options:
                break
            _, _, i, j, one = min(options)
            live[i] = (one, live[i][1] + live.pop(j)[1])
        want += [(frame, i, *box, n) for i, (box, n) in live.items()]
    found = merging.merged_by_correspondence(spark.createDataFrame(rows, SHAPE.replace("grp", "frame")), models).collect()
    assert sorted(map(tuple, found)) == sorted(want) and any(r.made > 2 for r in found)


def test_boxes_that_merge_are_connected_by_an_edge_each(spark):
    """The numpy condition links what the statement's does, and a crowded frame has an edge a box, not one a pair."""
    from fluxtrail.operators import objects
    from fluxtrail.plans import stateful

    rng = random.Random(3)
    rows = [(k, k % 2, l, r, t, b, r - l + 1, b - t + 1, (l + r + 1) / 2) for k, (l, r, t, b) in enumerate(drawn(rng, 120, 200))]
    boxes = spark.createDataFrame(rows, "det_id long, frame_id long, xleft long, xright long, ytop long, ybottom long, width long, height long, cx double")
    inside = f"NOT ({objects.OUTSIDE.format('boxes')})"
    pairs = spark.sql(f"WITH boxes AS (SELECT * FROM {{rows}}) SELECT a.det_id, b.det_id FROM {objects.SAME} AND {objects.MERGEABLE}", rows=boxes).collect()
    named = spark.sql(f"WITH boxes AS (SELECT * FROM {{rows}}) SELECT frame_id AS frame, 0 AS kind, det_id AS node, xleft AS l, xright AS r, ytop AS t, ybottom AS b, width AS w, height AS h, {inside} AS inside FROM boxes", rows=boxes)
    edges = components.stars(named, stateful.mergeable, ["l", "r", "t", "b", "w", "h", "inside"]).collect()
    part = named.toPandas()
    of = {c: part[c].to_numpy() for c in ("l", "r", "t", "b", "w", "h", "inside")}
    found = {(i, j) for i in range(120) for j in range(i + 1, 120) if i % 2 == j % 2 and stateful.mergeable(i, np.array([j]), of)[0]}
    assert found == {(a, b) for a, b in pairs} and len(found) > 120 >= len(edges)
