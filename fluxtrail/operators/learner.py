"""Incremental learning of a hierarchy of states and of the events between them, one context at a time.

Events join the states of the time that have none below. A state that is divided hands its events on to the one below it that
keeps its instances, so the ends of events always are such states, and no event is lost when states are merged or divided.
Events between the states of a level above are those of the states below, added up; that is done on the finished tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from math import sqrt
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtrail.operators.folds import ordered_fold

CONCEPTS = "context string, kind string, id long, parent long, level int, n long, p double, means string, sigmas string"
#: Fixed value: twice the root of pi.
NORM = 3.544907701811032
#: Fixed value: scores that differ by no more are tied.
TIE = 1e-7


class Concept:
    """A state: a Gaussian for each number, a histogram for each symbol, and the states below it."""

    __slots__ = ("id", "acuity", "n", "mean", "sigma", "seen", "squares", "children", "known", "asked", "sharper", "means", "sigmas")

    def __init__(self, number: int, acuity: list[float], numbers: list[float], symbols: list[str]) -> None:
        self.id, self.acuity, self.n = number, acuity, 1
        self.mean, self.sigma = list(numbers), list(acuity)
        self.seen, self.squares = [{s: 1} for s in symbols], [1] * len(symbols)  # the counts of each symbol, and the sum of their squares
        self.children: list[Concept] = []
        self.known: float | None = None  # the quality since the last instance
        self.asked: list[float] | None = None  # the instance tried last; the next three are what it would make

    def copy(self, number: int) -> Concept:
        out = Concept(number, self.acuity, self.mean, [])
        out.n, out.sigma = self.n, list(self.sigma)
        out.seen, out.squares = [dict(s) for s in self.seen], list(self.squares)
        return out

    def add(self, numbers: list[float], symbols: list[str]) -> None:
        if self.asked is not numbers:
            self.tried(numbers, symbols)
        self.known, self.mean, self.sigma = self.sharper, self.means, self.sigmas
        self.asked = None
        self.n += 1
        k = 0
        for s in symbols:
            seen = self.seen[k]
            count = seen.get(s, 0)
            seen[s] = count + 1
            self.squares[k] += 2 * count + 1
            k += 1

    def pooled(self, other: Concept, number: int) -> Concept:
        out = self.copy(number)
        total = self.n + other.n
        for k in range(len(self.mean)):
            mean = (self.n * self.mean[k] + other.n * other.mean[k]) / total
            square = sum(c.n * (c.sigma[k] ** 2 + (c.mean[k] - mean) ** 2) for c in (self, other)) / total
            out.mean[k], out.sigma[k] = mean, max(self.acuity[k], math.sqrt(square))
        for own, more in zip(out.seen, other.seen, strict=True):
            for s, n in more.items():
                own[s] = own.get(s, 0) + n
        out.n, out.squares = total, [sum(n * n for n in seen.values()) for seen in out.seen]
        return out

    def quality(self) -> float:
        """How sharp the numbers are on average, and how pure the symbols."""
        if self.known is None:
            sharp = sum([a / s for a, s in zip(self.acuity, self.sigma)]) / NORM / max(1, len(self.mean))  # noqa: B905  of equal length
            self.known = sharp + sum([q / (self.n * self.n) for q in self.squares]) / max(1, len(self.seen))
        return self.known

    def tried(self, numbers: list[float], symbols: list[str]) -> float:
        """The quality with the instance in it. It is kept for the same lists, as ``add`` and the next level ask again."""
        if self.asked is numbers:
            return self.sharper
        return trial(len(numbers), len(symbols))(self, numbers, symbols)

    def near(self, numbers: list[float], symbols: list[str]) -> bool:
        close = all(abs(x - m) <= a for x, m, a in zip(numbers, self.mean, self.acuity, strict=True))
        return close and all(seen.get(s, 0) / self.n >= 0.99 for s, seen in zip(symbols, self.seen, strict=True))

    def likelihood(self, numbers: list[float], symbols: list[str]) -> float:
        """That of the instance, with it in the state: only ties ask for it."""
        self.tried(numbers, symbols)
        parts = [math.exp(-((x - m) ** 2) / (2 * s * s)) for x, m, s in zip(numbers, self.means, self.sigmas, strict=True)]
        parts += [(seen.get(s, 0) + 1) / (self.n + 1) for s, seen in zip(symbols, self.seen, strict=True)]
        return sum(parts) / len(parts)


#: The functions of ``trial`` that were asked for; a plain table, as this module's functions travel to the tasks by value.
TRIALS: dict[tuple[int, int], Callable[[Concept, list[float], list[str]], float]] = {}


def trial(numbers: int, symbols: int) -> Callable[[Concept, list[float], list[str]], float]:
    """The function that puts an instance of so many numbers and symbols to a state and keeps what it would make of it.

    It runs some twenty times an instance, so it is written out for the numbers and symbols instead of looping over them.
    """
    if (numbers, symbols) in TRIALS:
        return TRIALS[numbers, symbols]
    each, every = range(numbers), range(symbols)
    listed = lambda name, of: "".join(f"{name}{k}, " for k in of)
    lines = ["n = c.n + 1", "share = c.n / n"]
    for name, of, source in (("x", each, "numbers"), ("m", each, "c.mean"), ("s", each, "c.sigma"), ("a", each, "c.acuity"), ("y", every, "symbols"), ("seen", every, "c.seen"), ("q", every, "c.squares")):
        lines += [f"{listed(name, of)} = {source}"] if of else []
    for k in each:  # the deviation is updated with the old mean
        lines += [f"off = x{k} - m{k}", f"m{k} += off / n", f"s{k} = sqrt(share * (s{k} * s{k} + off * off / n))", f"if s{k} < a{k}: s{k} = a{k}"]
    sharp = " + ".join(f"a{k} / s{k}" for k in each) or "0.0"
    pure = " + ".join(f"(q{k} + 2 * seen{k}.get(y{k}, 0) + 1) / (n * n)" for k in every) or "0.0"
    lines += ["c.asked = numbers", f"c.means, c.sigmas = ({listed('m', each)}), ({listed('s', each)})"]
    lines += [f"c.sharper = quality = ({sharp}) / NORM / {numbers or 1} + ({pure}) / {symbols or 1}", "return quality"]
    made: dict[str, Any] = {"sqrt": sqrt, "NORM": NORM}
    exec("def put(c, numbers, symbols):\n    " + "\n    ".join(lines), made)  # noqa: S102  of two counts alone
    return TRIALS.setdefault((numbers, symbols), made["put"])


class Dwell:
    """Count, mean, sum of squared deviations and bounds of dwell times."""

    __slots__ = ("n", "mean", "square", "lo", "hi")

    def __init__(self) -> None:
        self.n, self.mean, self.square, self.lo, self.hi = 0, 0.0, 0.0, math.inf, -math.inf

    def add(self, d: float) -> None:
        self.n += 1
        off = d - self.mean
        self.mean += off / self.n
        self.square += off * (d - self.mean)
        self.lo, self.hi = min(self.lo, d), max(self.hi, d)

    def pool(self, other: Dwell) -> None:
        total, off = self.n + other.n, other.mean - self.mean
        self.square += other.square + off * off * self.n * other.n / total
        self.mean += off * other.n / total
        self.n, self.lo, self.hi = total, min(self.lo, other.lo), max(self.hi, other.hi)


class Hierarchy:
    """The tree of one context, the current state of each object, and the edges between states."""

    def __init__(self, acuity: list[float]) -> None:
        self.acuity, self.root, self.last_id, self.name = acuity, None, 0, None
        self.at: dict[Any, tuple[int, float, float]] = {}
        self.edges: dict[tuple[int, int], Dwell] = {}
        self.heir: dict[int, int] = {}
        self.states, self.day = 0, None
        self.single: float | None = None
        self.put: Callable[[Concept, list[float], list[str]], float] | None = None

    def grown(self) -> tuple:
        """A row with how many states and events there are at the end of the day."""
        home = {state: self.now(state) for state in {x for pair in self.edges for x in pair}}
        return self.name, "growth", self.states, len({(home[a], home[b]) for a, b in self.edges}), 0, self.day, 1.0, "", ""

    def now(self, state: int) -> int:
        """The state that has taken over what ``state`` held."""
        while state in self.heir:
            if self.heir[state] in self.heir:
                self.heir[state] = self.heir[self.heir[state]]
            state = self.heir[state]
        return state

    def events(self) -> dict[tuple[int, int], Dwell]:
        """The events between the states that now hold their ends; those of one pair are one."""
        out: dict[tuple[int, int], Dwell] = {}
        for (a, b), edge in self.edges.items():
            out.setdefault((self.now(a), self.now(b)), Dwell()).pool(edge)
        return out

    def lone(self, symbols: list[str]) -> float:
        """The quality of a state with one instance, which is the same for each."""
        if self.single is None:
            self.single = Concept(0, self.acuity, self.acuity, symbols).quality()
        return self.single

    def number(self) -> int:
        self.last_id += 1
        return self.last_id

    def fresh(self, numbers: list[float], symbols: list[str]) -> Concept:
        return Concept(self.number(), self.acuity, numbers, symbols)

    def learn(self, numbers: list[float], symbols: list[str]) -> Concept:
        """The state that takes the instance in, with the tree changed by the best of new, merge, best and split."""
        if self.root is None:
            self.root, self.states, self.put = self.fresh(numbers, symbols), 1, trial(len(numbers), len(symbols))
            return self.root
        node, taken = self.root, False
        while True:
            if not node.children:
                if not node.near(numbers, symbols):
                    node.children = [node.copy(self.number()), self.fresh(numbers, symbols)]
                    self.heir[node.id] = node.children[0].id
                    self.states += 2
                node.add(numbers, symbols)
                return node.children[1] if node.children else node
            if not taken:
                node.add(numbers, symbols)
            action, one, two = self.choice(node, numbers, symbols)
            taken = False
            if action == "new":
                node.children.append(self.fresh(numbers, symbols))
                self.states += 1
                return node.children[-1]
            if action == "merge":
                both = one.pooled(two, self.number())
                both.children = [one, two]
                self.states += 1
                node.children = [c for c in node.children if c is not one and c is not two] + [both]
                node = both
            elif action == "split":
                node.children = [c for c in node.children if c is not one] + one.children
                self.states -= 1
                taken = True
            else:
                node = one

    def choice(self, node: Concept, numbers: list[float], symbols: list[str]) -> tuple[str, Concept, Concept | None]:
        """What to do with the instance at a node that has counted it, and the two children that it suits best.

        Each option is worth the children's mean quality by share beyond that of the root, with the instance in them. Of
        options in the order new, merge, best, split a better one is taken, and one that ties with best if the instance is
        likelier in it than in the one taken; new counts as least likely, so that it never goes before best, which ties with itself.
        """
        base, children, total = self.root.known or self.root.quality(), node.children, node.n
        k, put = len(children), self.put
        if k == 2:  # nearly always, so without lists
            a, b = children
            left, right = a.n / total * (a.known or a.quality()), b.n / total * (b.known or b.quality())
            more = (a.n + 1) / total * (a.sharper if a.asked is numbers else put(a, numbers, symbols)) - left
            most = (b.n + 1) / total * (b.sharper if b.asked is numbers else put(b, numbers, symbols)) - right
            every = left + right
            if more > most or more == most and (-a.likelihood(numbers, symbols), a.id) < (-b.likelihood(numbers, symbols), b.id):
                one, two, own, most = a, b, left, more
            else:
                one, two, own = b, a, right
        else:
            every, gain, worths = 0.0, [], []
            for c in children:
                worth = c.n / total * (c.known or c.quality())
                every += worth
                worths.append(worth)
                gain.append((c.n + 1) / total * (c.sharper if c.asked is numbers else put(c, numbers, symbols)) - worth)
            tied = len(set(gain)) < k
            order = sorted(range(k), key=lambda i: (-gain[i], -children[i].likelihood(numbers, symbols) if tied else 0.0, children[i].id))
            first = order[0]
            one, two = children[first], children[order[1]] if k > 1 else None
            own, most = worths[first], gain[first]
        stay = (every + most - base) / k
        action, value, taken = "best", stay, one
        if k > 2:
            both = one.pooled(two, 0)
            rest = every - own - two.n / total * two.quality()
            merged = (rest + (both.n + 1) / total * both.tried(numbers, symbols) - base) / (k - 1)
            new = (every + 1 / total * self.lone(symbols) - base) / (k + 1)
            if (merged - new > TIE or abs(merged - stay) <= TIE) and stay - merged <= TIE and one.likelihood(numbers, symbols) <= both.likelihood(numbers, symbols):
                action, value, taken = "merge", merged, both
        if one.children:
            inside, most = 0.0, -math.inf
            for c in one.children:
                worth = c.n / total * (c.known or c.quality())
                inside += worth
                more = (c.n + 1) / total * (c.sharper if c.asked is numbers else put(c, numbers, symbols)) - worth
                if more > most:
                    most = more
            split = (every - own + inside + most - base) / (k - 1 + len(one.children))
            if split - value > TIE or abs(split - stay) <= TIE and self.likeliest(one, total, numbers, symbols) > taken.likelihood(numbers, symbols):
                action = "split"
        return action, one, two

    @staticmethod
    def likeliest(node: Concept, total: int, numbers: list[float], symbols: list[str]) -> float:
        """The likelihood of the instance in the child of ``node`` that gains most by it; of equals the greatest."""
        return max(((c.n + 1) / total * c.tried(numbers, symbols) - c.n / total * c.quality(), c.likelihood(numbers, symbols)) for c in node.children)[1]

    def move(self, key: Any, state: int, t: float) -> None:
        """Dwell times: half a gap on arrival and on leaving, whole gaps within."""
        if key in self.at:
            old, since, dwell = self.at[key]
            old, gap = self.now(old), t - since
            if old != state:
                self.edges.setdefault((old, state), Dwell()).add(dwell + gap / 2)
                self.at[key] = (state, t, gap / 2)
            else:
                self.at[key] = (state, t, dwell + gap)
        else:
            self.at[key] = (state, t, 0.0)

    def rows(self) -> list[tuple]:
        show = lambda xs: ",".join(f"{x:.6f}" for x in xs)
        out, todo = [], [(self.root, 0, 0, 1.0)] if self.root else []
        while todo:
            node, parent, level, p = todo.pop()
            out.append((self.name, "state", node.id, parent, level, node.n, round(p, 6), show(node.mean), show(node.sigma)))
            todo += [(c, node.id, level + 1, c.n / node.n) for c in node.children]
        if self.day is not None:
            out.append(self.grown())
        events, leaving = sorted(self.events().items()), {}
        for (a, _), e in events:
            leaving[a] = leaving.get(a, 0) + e.n
        for (a, b), e in events:
            out.append((self.name, "event", a, b, 0, e.n, round(e.n / leaving[a], 6), show([e.mean, e.lo, e.hi]), show([math.sqrt(e.square / e.n)])))
        return out


def learn(instances: DataFrame, numbers: dict[str, float], symbols: list[str]) -> DataFrame:
    """States and events of each context from instances(context, object_id, t, ...), in order of t and object_id.

    ``numbers`` maps each numeric column to its acuity; at or below 0 that is 1. A state's row has its parent (0 for a root),
    level, count and share of its parent; an event's has the states it joins, its count and probability, and its dwell
    time's mean, least and greatest in ``means``. Rows of kind ``growth`` have, for each day (24 units of t) with instances, the
    number of states in ``id``, of events in ``parent``, and the day in ``n``. Rows with a null number are passed over. A context's state is its tree.
    """
    acuity = [a if a > 0 else 1.0 for a in numbers.values()]

    def step(tree: Hierarchy, row: Any) -> list[tuple]:
        day = int(row.t // 24)
        out = [tree.grown()] if tree.day is not None and day > tree.day else []
        tree.name, tree.day = row.context, day
        found = tree.learn([float(getattr(row, c)) for c in numbers], [str(getattr(row, c)) for c in symbols])
        tree.move(row.object_id, found.id, float(row.t))
        return out

    used = instances.select("context", "object_id", "t", *numbers, *symbols).dropna(subset=list(numbers))
    return ordered_fold(used, ["context"], ["t", "object_id"], CONCEPTS, lambda: Hierarchy(acuity), step, Hierarchy.rows, heavy=True)


def ancestors(states: DataFrame, most_rounds: int = 40) -> DataFrame:
    """context, id, a, d: each of states(context, id, parent) with all states a above it, d steps up; itself at 0.

    By pointer doubling: in each round a state's ancestors are joined with those of its farthest one, so a tree of depth
    n takes log n rounds of one shuffle join, each cut by a checkpoint. A parent that is no state ends the way up.
    """
    own = states.select("context", "id", F.col("id").alias("a"), F.lit(0).alias("d"))
    known = states.select("context", F.col("id").alias("parent"))
    found = own.union(states.join(known, ["context", "parent"]).select("context", "id", F.col("parent").alias("a"), F.lit(1).alias("d"))).checkpoint()
    reach = 1
    for _ in range(most_rounds):
        far = found.filter(F.col("d") == reach).select("context", F.col("id").alias("low"), F.col("a").alias("mid"))
        more = far.join(found.select("context", F.col("id").alias("mid"), "a", "d").filter("d > 0"), ["context", "mid"])
        new = more.select("context", F.col("low").alias("id"), "a", (F.col("d") + reach).alias("d")).checkpoint()
        if not new.take(1):
            return found
        found, reach = found.union(new).checkpoint(), 2 * reach
    raise RuntimeError("the parents go round in a circle")


def numbered_ancestors(nodes: DataFrame) -> DataFrame:
    """id, a, d: the ways up of nodes(id, parent). A way ends at a parent that is no node, with it, or before one not above 0."""
    above = nodes.select("id", F.when(F.col("parent") > 0, F.col("parent")).alias("parent"))
    missing = above.select(F.col("parent").alias("id")).filter("id IS NOT NULL").distinct().join(nodes, "id", "left_anti").select("id")
    states = above.union(missing.select("id", F.lit(None).cast("long"))).withColumn("context", F.lit(""))
    return ancestors(states).join(missing, "id", "left_anti").select("id", "a", "d")


def leaf_steps(above: DataFrame) -> DataFrame:
    """context, id, to_leaf, below: the steps from each state down to the nearest one without any below, and how many are below, itself included."""
    inner = above.filter("d = 1").select("context", F.col("a").alias("id")).distinct()
    leaves = above.filter("d = 0").select("context", "id").join(inner, ["context", "id"], "left_anti")
    rows = above.join(leaves.withColumn("leaf", F.lit(True)), ["context", "id"], "left")
    return rows.groupBy("context", F.col("a").alias("id")).agg(F.min(F.when(F.col("leaf"), F.col("d"))).alias("to_leaf"), F.count(F.lit(1)).alias("below"))


def kinship(above: DataFrame, pairs: DataFrame) -> DataFrame:
    """context, x, y, common, up_x, up_y: the nearest state above both of pairs(context, x, y), and the steps to it from each.

    A state is above itself. The ways up of both are joined on context, pair and ancestor, so work grows with pairs times
    depth. Repeated pairs are one; a pair without a common state has no row.
    """
    pairs = pairs.select("context", "x", "y").distinct()
    one = pairs.join(above.select("context", F.col("id").alias("x"), "a", F.col("d").alias("up_x")), ["context", "x"])
    both = one.join(above.select("context", F.col("id").alias("y"), "a", F.col("d").alias("up_y")), ["context", "y", "a"])
    return both.groupBy("context", "x", "y").agg(F.min(F.struct("up_x", "up_y", "a")).alias("n")).select("context", "x", "y", F.col("n.a").alias("common"), "n.up_x", "n.up_y")


def likely_states(states: DataFrame, above: DataFrame, least: float = 0.4) -> DataFrame:
    """context, id: where the way down from the root ends, if only states with a share p of ``least`` or more are gone into.

    States(context, id, parent, p). A state that is gone into ends the way if none below it has that share; else those below
    it that have less are ends too.
    """
    unlikely = states.filter((F.col("p") < least) & (F.col("parent") != 0)).select("context", F.col("id").alias("a")).withColumn("bad", F.lit(True))
    closed = above.join(unlikely, ["context", "a"], "left").groupBy("context", "id").agg(F.max("bad").alias("bad"))
    rows = states.select("context", "id", "parent").join(closed, ["context", "id"])
    opened = rows.filter("bad IS NULL")
    gone_into = opened.filter("parent <> 0").select("context", F.col("parent").alias("id")).distinct()
    ends = opened.select("context", "id").join(gone_into, ["context", "id"], "left_anti")
    beside = rows.filter("bad").select("context", "id", F.col("parent").alias("over")).join(gone_into.withColumnRenamed("id", "over"), ["context", "over"])
    return ends.union(beside.join(opened.select("context", F.col("id").alias("over")), ["context", "over"]).select("context", "id"))


def lifted(events: DataFrame, above: DataFrame) -> DataFrame:
    """context, level, src, dst, n, p, mean, sigma, lo, hi: events between the states of each level, the root's being 0.

    Of events(context, src, dst, n, mean, sigma, lo, hi) those whose ends lie below two different states of a level are
    one event of these two: counts are added, means and deviations pooled by count. An end above the level has no state there.
    """
    depth = above.groupBy("context", "id").agg(F.max("d").alias("depth"))
    levels = above.join(depth, ["context", "id"]).select("context", "id", "a", (F.col("depth") - F.col("d")).alias("level"))
    ends = lambda n: levels.select("context", F.col("id").alias(n), "level", F.col("a").alias(f"{n}_at"))
    rows = events.join(ends("src"), ["context", "src"]).join(ends("dst"), ["context", "dst", "level"]).filter("src_at <> dst_at")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    square = F.sum(F.col("n") * (F.pow("sigma", F.lit(2)) + F.pow("mean", F.lit(2)))) / n
    out = rows.groupBy("context", "level", F.col("src_at").alias("src"), F.col("dst_at").alias("dst")).agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sigma"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaving = out.groupBy("context", "level", "src").agg(F.sum("n").alias("left_"))
    return out.join(leaving, ["context", "level", "src"]).select("context", "level", "src", "dst", "n", (F.col("n") / F.col("left_")).alias("p"), "mean", "sigma", "lo", "hi")
