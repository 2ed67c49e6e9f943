"""Connected pixels, runs and boxes, and what is done with the groups."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = "frame long, label long, n long, l long, r long, t long, b long"


class Forest:
    """Disjoint sets of 0..n-1, each named by its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.top(i), self.top(j)))
        self.up[j] = i


def described(frame: int, label: np.ndarray, x0: np.ndarray, x1: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    """One row per label: pixels and bounds. A label is the smallest y * 65536 + x of its pixels."""
    parts = pd.DataFrame({"top": label, "x0": x0, "x1": x1, "y": y, "n": x1 - x0 + 1, "first": y * 65536 + x0})
    out = parts.groupby("top").agg(label=("first", "min"), n=("n", "sum"), l=("x0", "min"), r=("x1", "max"), t=("y", "min"), b=("y", "max"))
    return out.reset_index(drop=True).assign(frame=frame)[[c.split()[0] for c in LABELS.split(", ")]]


def pixel_components(fg: DataFrame) -> DataFrame:
    """8-connected components of fg(frame, x, y). A task holds one frame, which the sensor bounds; repeated pixels count once."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        points = part[["y", "x"]].drop_duplicates().sort_values(["y", "x"])
        y, x = points["y"].to_numpy(), points["x"].to_numpy()
        at = {p: i for i, p in enumerate(zip(y.tolist(), x.tolist(), strict=True))}
        sets = Forest(len(at))
        for (py, px), i in at.items():
            for q in ((py, px - 1), (py - 1, px - 1), (py - 1, px), (py - 1, px + 1)):
                if q in at:
                    sets.join(at[q], i)
        return described(part["frame"].iloc[0], np.array([sets.top(i) for i in range(len(at))]), x, x, y)

    return fg.select("frame", "x", "y").groupBy("frame").applyInPandas(run, LABELS)


def runs_of(xs: list[int], step: int, tolerance: int) -> list[tuple[int, int]]:
    """Runs of one row's ascending foreground columns: gaps up to ``tolerance`` stay within; found only if a sampled column hits."""
    closed: list[list[int]] = []
    for x in xs:
        if closed and x - closed[-1][-1] <= tolerance + 1:
            closed[-1].append(x)
        else:
            closed.append([x])
    found, at = [], step - 1
    for run in closed:
        if at < run[0]:
            at += -(-(run[0] - at) // step) * step
        hits = set(run)
        while at <= run[-1] and at not in hits:
            at += step
        if at in hits:
            found.append((run[0], run[-1]))
            at = run[-1] + 1 + tolerance
    return found


def run_components(fg: DataFrame, step: int = 2, tolerance: int = 1) -> DataFrame:
    """Components of the runs of fg(frame, x, y); rows and columns join up to ``tolerance`` apart. Pixels in n include bridged gaps."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        runs = []
        for y, row in part[["y", "x"]].drop_duplicates().sort_values(["y", "x"]).groupby("y")["x"]:
            runs += [(int(y), a, b) for a, b in runs_of(row.tolist(), step, tolerance)]
        if not runs:
            return pd.DataFrame(columns=[c.split()[0] for c in LABELS.split(", ")])
        sets, above, first = Forest(len(runs)), range(0), 0
        for j, (y, a, b) in enumerate(runs):
            if y != runs[first][0]:  # a new row: the one that ends here is the row above
                above, first = range(first, j) if y - runs[first][0] <= tolerance + 1 else range(0), j
            for i in above:
                _, c, d = runs[i]
                if c - b > tolerance + 1:
                    break
                if a - d <= tolerance:
                    sets.join(i, j)
        y, a, b = np.array(runs).T
        return described(part["frame"].iloc[0], np.array([sets.top(i) for i in range(len(runs))]), a, b, y)

    return fg.select("frame", "x", "y").groupBy("frame").applyInPandas(run, LABELS)


def groups(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, grp (its smallest node) of edges(a, b), which join only nodes of one frame.

    Stars are contracted by turns: neighbours above a node go to its least neighbour, then those below. Each round is a
    few hash shuffles of the edges and its result is checkpointed; the number of rounds grows with the logarithm of a
    group's size, and no group is gathered in one task. An empty relation gives no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().checkpoint()
    mark = lambda rows: rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        high = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = high.groupBy("u").agg(F.min("v").alias("m"))
        tied = high.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = tied.union(low.select("u", "m")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        now = mark(edges)
        if now == before:
            leaf = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("grp"))
            return leaf.union(leaf.select(F.col("grp").alias("node"), "grp").distinct())
        before = now
    raise RuntimeError("the groups did not settle")


#: Which of some boxes are linked to one: its number, theirs, and the columns of all boxes.
Links = Callable[[int, np.ndarray, dict[str, np.ndarray]], np.ndarray]


def closer(reach: int) -> Links:
    """Boxes (l, r, t, b) that lie closer than ``reach`` each way."""

    def links(i: int, own: np.ndarray, of: dict[str, np.ndarray]) -> np.ndarray:
        l, r, t, b = (of[c] for c in "lrtb")
        return (l[own] < r[i] + reach) & (r[own] > l[i] - reach) & (t[own] < b[i] + reach) & (b[own] > t[i] - reach)

    return links


def stars(boxes: DataFrame, links: Links, columns: list[str]) -> DataFrame:
    """a, b: edges that connect the same boxes(frame, kind, node, columns) as all pairs of a frame and kind that are linked.

    A box is linked with the least node of its group; so there is an edge a box at most, where pairs grow with the square
    of a frame's boxes. Each box looks once, at those of its frame that are in no group yet; no pair is kept. A frame and
    kind is one task's rows, which the sensor bounds. A box with a null in any column is linked with nothing.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        node = part["node"].to_numpy()
        of = {c: part[c].to_numpy() for c in columns}
        least, left = node.copy(), np.arange(len(node))
        while len(left):
            todo, group, left = [left[0]], [left[:1]], left[1:]
            while todo and len(left):
                hit = links(todo.pop(), left, of)
                if hit.any():
                    group.append(left[hit])
                    todo += group[-1].tolist()
                    left = left[~hit]
            own = np.concatenate(group)
            least[own] = node[own].min()
        return pd.DataFrame({"a": node, "b": least})[node != least]

    names = ["frame", "kind", "node", *columns]
    return boxes.select(*names).dropna(subset=names).groupBy("frame", "kind").applyInPandas(run, "a long, b long")


def connected(edges: DataFrame, members: DataFrame) -> DataFrame:
    """frame, connected: whether the members(frame, node) of a frame are one group of edges(a, b); one member is."""
    named = members.join(groups(edges), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    return named.groupBy("frame").agg((F.min("grp") == F.max("grp")).alias("connected"))


def partitions(n: int) -> Iterator[tuple[int, ...]]:
    """All set partitions of n items: items with the same number are together, numbers appear in order."""
    rows: list[tuple[int, ...]] = [()]
    for _ in range(n):
        rows = [(*row, k) for row in rows for k in range(max(row, default=-1) + 2)]
    yield from rows


def corresponding(pairs: DataFrame) -> DataFrame:
    """frame, a, b, score: of pairs(frame, a, b, score) the ones that a greedy choice keeps: the best pair, then the best of
    blobs still free, and so on; ties by a, then b. A frame's pairs are one task's rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, out = set(), set(), []
        for row in part.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
            if row.a not in used_a and row.b not in used_b:
                used_a.add(row.a)
                used_b.add(row.b)
                out.append(row)
        return pd.DataFrame(out, columns=["frame", "a", "b", "score"])

    return pairs.select("frame", "a", "b", "score").groupBy("frame").applyInPandas(run, "frame long, a long, b long, score double")


def best_matches(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> list[tuple[int, int, float]]:
    """``corresponding`` of the pairs of two frames' boxes (id, l, r, t, b, area) that overlap, by the share of the larger box that both cover.

    A box of ``a`` holds its best few free boxes of ``b`` and looks anew when they are taken, so no list of pairs is made.
    """
    order = np.argsort(b["l"], kind="stable")
    b = {c: v[order] for c, v in b.items()}
    free, widest, found = np.ones(len(b["l"]), bool), int((b["r"] - b["l"]).max(initial=0)), []
    held: dict[int, list[tuple[float, int, int]]] = {}
    todo: list[tuple[float, int, int, int, int]] = []
    done: set[int] = set()

    def enter(i: int) -> None:
        """The best free pair of i; those found last that are not taken are still the best."""
        while held.get(i):
            score, other, k = held[i].pop()
            if free[k]:
                heapq.heappush(todo, (score, int(a["id"][i]), other, i, k))
                return
        low, high = np.searchsorted(b["l"], a["l"][i] - widest), np.searchsorted(b["l"], a["r"][i])
        own = low + np.flatnonzero(free[low:high] & (b["r"][low:high] > a["l"][i]) & (b["t"][low:high] < a["b"][i]) & (b["b"][low:high] > a["t"][i]))
        l, r, t, d = np.maximum(a["l"][i], b["l"][own]), np.minimum(a["r"][i], b["r"][own]), np.maximum(a["t"][i], b["t"][own]), np.minimum(a["b"][i], b["b"][own])
        hit = (l < r) & (t < d)
        own, both = own[hit], ((r - l + 1) * (d - t + 1))[hit]
        if len(own):
            score = both.astype(float) / np.maximum(a["area"][i], b["area"][own])
            best = np.lexsort((b["id"][own], -score))[:16][::-1]
            held[i] = [(-float(score[k]), int(b["id"][own[k]]), int(own[k])) for k in best.tolist()]
            enter(i)

    for i in range(len(a["l"])):
        enter(i)
    while todo:
        score, one, other, i, k = heapq.heappop(todo)
        if one in done:  # a repeated id is taken once
            continue
        if free[k]:
            free[b["id"] == other] = False
            done.add(one)
            found.append((one, other, -score))
        else:
            enter(i)
    return found


def matched(boxes: DataFrame) -> DataFrame:
    """frame, a, b, score: ``best_matches`` of the boxes(frame, id, l, r, t, b, area) of each frame and of the one before.

    Two frames' boxes are one task's rows, which the sensor bounds. A box with a null is in no pair.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        one, other = ({c: p[c].to_numpy() for c in names[1:]} for p in (part[part["now"]], part[~part["now"]]))
        out = pd.DataFrame(best_matches(one, other), columns=["a", "b", "score"])
        return out.assign(frame=part["frame"].iloc[0])[["frame", "a", "b", "score"]]

    names = ["frame", "id", "l", "r", "t", "b", "area"]
    boxes = boxes.select(*names).dropna()
    rows = boxes.withColumn("now", F.lit(True)).union(boxes.withColumn("frame", F.col("frame") + 1).withColumn("now", F.lit(False)))
    return rows.groupBy("frame").applyInPandas(run, "frame long, a long, b long, score double")


def reduced(blobs: DataFrame, overlap: float = 0.8, sure: float = 0.95, least: float = 0.3) -> DataFrame:
    """frame, id, l, r, t, b, absorbed: blobs(frame, id, l, r, t, b, kind, p) after each took in those mostly inside it.

    A blob of UNKNOWN kind is taken in with more than ``overlap`` of it inside, one of a known kind with more than ``sure``
    if its probability is below ``least``. A blob that grew looks at all others anew; in order of id, until none is taken.
    A frame's blobs are one task's rows.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        l, r, t, b = (part[c].to_numpy(np.int64).copy() for c in "lrtb")
        limit = np.array([overlap if k == "UNKNOWN" else sure if p < least else 1.0 for k, p in zip(part["kind"], part["p"], strict=True)])
        n = len(part)
        there, absorbed, left = np.ones(n, bool), np.zeros(n, np.int64), np.arange(n)  # left: those not taken in, with some that were lately
        least_area = limit * (r - l + 1) * (b - t + 1)
        for i in range(n):
            grew = there[i]
            while grew:
                grew, since = False, 0
                while since < len(left):  # those after the one that made it grow see it grown
                    own = left[since:]
                    w = np.minimum(r[i], r[own]) - np.maximum(l[i], l[own]) + 1
                    h = np.minimum(b[i], b[own]) - np.maximum(t[i], t[own]) + 1
                    hits = np.flatnonzero((w > 0) & (h > 0) & (w * h > least_area[own]) & there[own] & (own != i))
                    since = len(left)
                    for k in hits.tolist():
                        j = own[k]
                        there[j] = False
                        absorbed[i] += 1
                        if l[j] < l[i] or r[j] > r[i] or t[j] < t[i] or b[j] > b[i]:
                            l[i], r[i], t[i], b[i] = min(l[i], l[j]), max(r[i], r[j]), min(t[i], t[j]), max(b[i], b[j])
                            least_area[i] = limit[i] * (r[i] - l[i] + 1) * (b[i] - t[i] + 1)
                            grew, since = True, len(left) - len(own) + k + 1
                            break
                if grew:
                    left = left[there[left]]
            if i % 64 == 0:
                left = left[there[left]]
        return pd.DataFrame({"frame": part["frame"].to_numpy(), "id": part["id"].to_numpy(), "l": l, "r": r, "t": t, "b": b, "absorbed": absorbed})[there]

    return blobs.select("frame", "id", "l", "r", "t", "b", "kind", "p").groupBy("frame").applyInPandas(run, "frame long, id long, l long, r long, t long, b long, absorbed long")
