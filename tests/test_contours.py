"""Borders against flood fills, normals across known shapes, and the consensus background against a plain loop."""

import math
import random

import numpy as np
import pytest

from fluxtrail.operators import consensus, contours


def outer(own):
    """Pixels beside (4-neighbours) the background around the set, found by flooding it from outside."""
    xs, ys = [p[0] for p in own], [p[1] for p in own]
    lo, hi = (min(xs) - 1, min(ys) - 1), (max(xs) + 1, max(ys) + 1)
    seen, todo = {lo}, [lo]
    while todo:
        x, y = todo.pop()
        for q in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
            if lo[0] <= q[0] <= hi[0] and lo[1] <= q[1] <= hi[1] and q not in own and q not in seen:
                seen.add(q)
                todo.append(q)
    return {(x, y) for x, y in own if any(q in seen for q in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)))}


@pytest.mark.parametrize("seed", range(6))
def test_borders_of_random_blobs(seed):
    rng = random.Random(seed)
    for share in (0.2, 0.45, 0.6, 0.85):
        points = {(x, y) for x in range(18) for y in range(14) if rng.random() < share}
        parts = contours.components(points)
        assert sum(map(len, parts)) == len(points) and set().union(*parts) == points
        for own in parts:
            line = contours.border(own)
            assert line[0] == min(own, key=lambda p: (p[1], p[0])) and set(line) == outer(own)
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(line, line[1:] + line[:1], strict=True)) or len(own) == 1


def test_border_of_a_square_goes_round_once():
    square = {(x, y) for x in range(4) for y in range(3)}
    assert contours.border(square) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (2, 2), (1, 2), (0, 2), (0, 1)]
    assert contours.border({(5, 5)}) == [(5, 5)] and contours.border({(0, 0), (1, 1)}) == [(0, 0), (1, 1)]


def test_normals_cross_a_band(spark):
    """In a band six pixels high and turned by 30 degrees, normals of the long sides are about six long and at right angles."""
    turn = math.radians(30)
    band = [(x, y) for x in range(-40, 90) for y in range(-40, 90) if 0 <= x * math.cos(turn) + y * math.sin(turn) <= 60 and 0 <= -x * math.sin(turn) + y * math.cos(turn) <= 6]
    rows = spark.createDataFrame([(1, *p) for p in band] * 2 + [(2, 3, 4)], "frame long, x long, y long")
    found = contours.segments(rows, every=1, reach=4).collect()
    middle = [r for r in found if r.frame == 1 and 10 < r.x * math.cos(turn) + r.y * math.sin(turn) < 50]
    assert len(middle) > 60 and all(5 <= r.length <= 8.5 for r in middle)
    assert sum(abs(abs(math.atan2(r.to_y - r.y, r.to_x - r.x)) - math.radians(120 if r.to_y > r.y else 60)) < 0.25 for r in middle) > 0.9 * len(middle)
    alone = [r for r in found if r.frame == 2]
    assert [(r.label, r.k, r.x, r.y, r.to_x, r.length) for r in alone] == [(4 * 65536 + 3, 0, 3, 4, None, None)]
    assert not contours.segments(rows.limit(0)).collect()


def plain_consensus(frames, n, radius, least, rate, seed):
    """Frame by frame and pixel by pixel; decisions first, then replacements in order."""
    draw = lambda f, x, y, p: int(consensus.drawn(seed, f, np.array([x]), np.array([y]), p)[0])
    kept, out = {}, []
    for f, held in frames:
        order = sorted(held, key=lambda p: (p[1], p[0]))
        for x, y in order:
            if (x, y) not in kept:
                turns = [draw(f, x, y, 100 + i) % 9 for i in range(n)]
                kept[x, y] = [held.get((x + t % 3 - 1, y + t // 3 - 1), held[x, y]) for t in turns]
        near = {p: sum(abs(s - held[p]) <= radius for s in kept[p]) for p in order}
        out += [(f, *p, near[p], int(near[p] < least)) for p in order]
        for x, y in order:
            if near[x, y] >= least and draw(f, x, y, 1) % rate == 0:
                kept[x, y][draw(f, x, y, 3) % n] = held[x, y]
        for x, y in order:
            if near[x, y] >= least and draw(f, x, y, 2) % rate == 0:
                t = draw(f, x, y, 4) % 8
                t += t >= 4
                if (x + t % 3 - 1, y + t // 3 - 1) in kept:
                    kept[x + t % 3 - 1, y + t // 3 - 1][draw(f, x, y, 5) % n] = held[x, y]
    return out


def test_consensus_against_a_plain_loop(spark):
    rng = random.Random(9)
    frames = [(f, {(x, y): (120 if (x, y) != (3 + f % 4, 2) else 250) + rng.randrange(-15, 16) for x in range(8) for y in range(6) if f != 4 or x > 2}) for f in range(12)]
    frames[0][1].pop((5, 5))  # seen later
    rows = [(c, f, x, y, v) for c in (1, 2) for f, held in frames for (x, y), v in held.items()] + [(1, 0, 0, 0, -99), (3, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "clip long, frame long, x long, y long, v long")
    found = consensus.foreground(df, samples=6, radius=20, least=2, rate=3, seed=5).collect()
    want = plain_consensus(frames, 6, 20, 2, 3, 5)
    for clip in (1, 2):
        assert sorted(tuple(r)[1:] for r in found if r.clip == clip) == sorted(want)
    assert {r.clip for r in found} == {1, 2} and 0 < sum(r.fg for r in found) < len(found) / 2
    assert not consensus.foreground(df.limit(0)).collect()


def test_what_an_object_uncovers_is_learned(spark):
    """Where an object stood at first, the scene behind it is foreground, until samples have spread in from around it."""
    rows = [(1, f, x, y, 250 if f == 0 and 2 <= x < 8 and 2 <= y < 7 else 100) for f in range(90) for x in range(10) for y in range(9)]
    found = consensus.foreground(spark.createDataFrame(rows, "clip long, frame long, x long, y long, v long"), samples=8, rate=2).collect()
    share = lambda f: sum(r.fg for r in found if r.frame == f)
    assert share(0) < 5 and share(1) >= 8 and share(89) == 0
