"""The learned hierarchy: events are kept whatever happens to states, and measures of the tree against plain walks through it."""

import collections
import math
import random

import pytest

from fluxtrail.operators import learner
from fluxtrail.plans import session


def leaves(node):
    return [node.id] if not node.children else [x for c in node.children for x in leaves(c)]


def numbered(node):
    return {node.id: node} | {k: v for c in node.children for k, v in numbered(c).items()}


@pytest.mark.parametrize("seed", range(8))
def test_no_event_is_lost(seed):
    """After any run of insertions, merges and splits: the events are the changes of state, their ends have no states below,
    and each pair's moments are those of its dwell times, kept one by one."""
    rng, tree = random.Random(seed), learner.Hierarchy([4.0, 4.0])
    at, times = {}, []
    for k in range(400):
        key, t = rng.randrange(5), float(k)
        numbers = [rng.choice((0, 10, 40, 90)) + rng.gauss(0, 3), rng.choice((0, 30)) + rng.gauss(0, 3)]
        found = tree.learn(numbers, [rng.choice("ab")]).id
        if key in at:
            old, since, dwell = at[key]
            if tree.now(old) != found:
                times.append((old, found, dwell + (t - since) / 2))
            at[key] = (found, t, (t - since) / 2 if tree.now(old) != found else dwell + t - since)
        else:
            at[key] = (found, t, 0.0)
        tree.move(key, found, t)
        if k % 97 == 0:
            assert sum(e.n for e in tree.events().values()) == len(times)
    ends = set(leaves(tree.root))
    pairs = collections.defaultdict(list)
    for a, b, d in times:
        pairs[tree.now(a), tree.now(b)].append(d)
    events = tree.events()
    assert len(times) > 100 and events.keys() == pairs.keys() and all({a, b} <= ends for a, b in events)
    for pair, ds in pairs.items():
        e, mean = events[pair], sum(ds) / len(ds)
        assert (e.n, e.lo, e.hi) == (len(ds), min(ds), max(ds)) and math.isclose(e.mean, mean) and math.isclose(e.square, sum((d - mean) ** 2 for d in ds), rel_tol=1e-9, abs_tol=1e-6)


TREE = {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 5, 7: 5, 8: 7, 9: 8, 10: 9, 11: 10}
SHARES = {1: 1.0, 2: 0.7, 3: 0.3, 4: 0.2, 5: 0.8, 6: 0.5, 7: 0.5, 8: 1.0, 9: 1.0, 10: 0.1, 11: 1.0}


@pytest.fixture(scope="module")
def tree(spark):
    session.prepare(spark)
    rows = [("c", k, p, SHARES[k]) for k, p in TREE.items()] + [("d", 1, 0, 1.0)]
    states = spark.createDataFrame(rows, "context string, id long, parent long, p double")
    return states, learner.ancestors(states).cache()


def way(k):
    return [] if k == 0 else [k, *way(TREE[k])]


def test_ancestors(spark, tree):
    want = {("c", k, a, d) for k in TREE for d, a in enumerate(way(k))} | {("d", 1, 1, 0)}
    found = [tuple(r) for r in tree[1].collect()]
    assert len(found) == len(want) and set(found) == want
    assert not learner.ancestors(tree[0].limit(0)).collect()


def test_steps_to_a_leaf(tree):
    below = {k: [c for c in TREE if TREE[c] == k] for k in TREE}
    steps = lambda k: 1 + min(map(steps, below[k])) if below[k] else 0
    found = {(r.context, r.id): (r.to_leaf, r.below) for r in learner.leaf_steps(tree[1]).collect()}
    assert found == {("c", k): (steps(k), sum(k in way(x) for x in TREE)) for k in TREE} | {("d", 1): (0, 1)}


def test_kinship(spark, tree):
    pairs = [("c", x, y) for x in TREE for y in TREE] + [("c", 4, 6)] * 2 + [("d", 1, 1), ("d", 1, 7)]
    found = {(r.context, r.x, r.y): (r.common, r.up_x, r.up_y) for r in learner.kinship(tree[1], spark.createDataFrame(pairs, "context string, x long, y long")).collect()}
    want = {("d", 1, 1): (1, 0, 0)}
    for x in TREE:
        for y in TREE:
            common = next(a for a in way(x) if a in way(y))
            want["c", x, y] = (common, way(x).index(common), way(y).index(common))
    assert found == want


def test_likely_states(tree):
    def ends(k, least):
        below = [c for c in TREE if TREE[c] == k]
        if not any(SHARES[c] >= least for c in below):
            return {k}
        return {e for c in below for e in (ends(c, least) if SHARES[c] >= least else {c})}

    for least in (0.0, 0.25, 0.4, 0.6, 0.75, 1.1):
        found = [(r.context, r.id) for r in learner.likely_states(*tree, least).collect()]
        assert len(found) == len(set(found)) and set(found) == {("c", k) for k in ends(1, least)} | {("d", 1)}


def test_events_of_each_level(spark, tree):
    rng = random.Random(3)
    moves = [(rng.choice((3, 4, 6, 11)), rng.choice((3, 4, 6, 11)), rng.uniform(1, 9)) for _ in range(300)]
    moves = [m for m in moves if m[0] != m[1]]
    pairs = collections.defaultdict(list)
    for a, b, d in moves:
        pairs[a, b].append(d)
    sd = lambda ds: math.sqrt(sum((d - sum(ds) / len(ds)) ** 2 for d in ds) / len(ds))
    rows = [("c", a, b, len(ds), sum(ds) / len(ds), sd(ds), min(ds), max(ds)) for (a, b), ds in pairs.items()]
    events = spark.createDataFrame(rows, "context string, src long, dst long, n long, mean double, sigma double, lo double, hi double")
    found = {(r.level, r.src, r.dst): r for r in learner.lifted(events, tree[1]).collect()}
    want = collections.defaultdict(list)
    for a, b, d in moves:
        for level in range(min(len(way(a)), len(way(b)))):
            x, y = way(a)[::-1][level], way(b)[::-1][level]
            if x != y:
                want[level, x, y].append(d)
    assert found.keys() == want.keys()
    for key, ds in want.items():
        r = found[key]
        assert (r.n, r.lo, r.hi) == (len(ds), min(ds), max(ds)) and math.isclose(r.mean, sum(ds) / len(ds)) and math.isclose(r.sigma, sd(ds), abs_tol=1e-6)
        assert math.isclose(r.p, len(ds) / sum(len(v) for k, v in want.items() if k[:2] == key[:2]))


def test_growth_ends_with_the_tree(spark):
    rng = random.Random(2)
    rows = [("c", k % 4, float(k), rng.choice((0.0, 50.0, 200.0)) + rng.gauss(0, 4), "u") for k in range(150)]
    out = learner.learn(spark.createDataFrame(rows, "context string, object_id long, t double, x double, s string"), {"x": 3.0}, ["s"]).collect()
    days = sorted((r.n, r.id, r.parent) for r in out if r.kind == "growth")
    assert [d for d, _, _ in days] == list(range(7))
    assert days[-1][1:] == (sum(r.kind == "state" for r in out), sum(r.kind == "event" for r in out)) and days[0][1] < days[-1][1]


def option(tree, node, numbers, symbols):
    """The choice as its text has it: every option with its worth and likelihood, in order."""

    def likely(c):
        return c.tried(numbers, symbols) and c.likelihood(numbers, symbols)

    share = lambda c, quality, more=0: (c.n + more) / node.n * quality
    own = node.children
    k, base = len(own), tree.root.quality()
    gains = [share(c, c.tried(numbers, symbols), 1) - share(c, c.quality()) for c in own]
    order = sorted(range(k), key=lambda i: (-gains[i], -likely(own[i]), own[i].id))
    worth = sum(share(c, c.quality()) for c in own)
    one, two = own[order[0]], own[order[1]]
    stay = (worth + gains[order[0]] - base) / k
    both = one.pooled(two, 0)
    options = [("new", (worth + 1 / node.n * learner.Concept(0, tree.acuity, tree.acuity, symbols).quality() - base) / (k + 1), -1.0)]
    if k > 2:
        options.append(("merge", (worth - share(one, one.quality()) - share(two, two.quality()) + share(both, both.tried(numbers, symbols), 1) - base) / (k - 1), likely(both)))
    options.append(("best", stay, likely(one)))
    if one.children:
        more, p = max((share(c, c.tried(numbers, symbols), 1) - share(c, c.quality()), likely(c)) for c in one.children)
        options.append(("split", (worth - share(one, one.quality()) + sum(share(c, c.quality()) for c in one.children) + more - base) / (k - 1 + len(one.children)), p))
    taken = options[0]
    for o in options[1:]:
        if o[1] - taken[1] > learner.TIE or abs(o[1] - stay) <= learner.TIE and o[2] > taken[2]:
            taken = o
    return taken[0], one, two


@pytest.mark.parametrize("seed", range(4))
def test_choices_are_those_of_all_options(seed, monkeypatch):
    """Each choice against all options written out, also with ties; likelihoods, which ties need, are seldom made."""
    rng, tree, taken, made, inside = random.Random(seed), learner.Hierarchy([4.0, 4.0]), collections.Counter(), [], []
    choice, exp = learner.Hierarchy.choice, math.exp

    def counted(x):
        if inside:
            made.append(x)
        return exp(x)

    def checked(self, node, numbers, symbols):
        inside.append(1)
        found = choice(self, node, numbers, symbols)
        inside.clear()
        want = option(self, node, numbers, symbols)
        assert found[0] == want[0] and found[1] is want[1] and (found[0] != "merge" or found[2] is want[2])
        taken[found[0]] += 1
        return found

    monkeypatch.setattr(learner.math, "exp", counted)
    monkeypatch.setattr(learner.Hierarchy, "choice", checked)
    for _ in range(500):
        spread = 3 if seed < 2 else rng.choice((0, 3))
        tree.learn([rng.choice((0, 10, 40, 90)) + rng.gauss(0, spread), rng.choice((0, 30)) + rng.gauss(0, spread)], [rng.choice("abc"), rng.choice("xy")])
    assert taken["best"] > 500 and (seed > 1 or len(made) < 2 * sum(taken.values()))
