"""Groups of boxes: their partitions, as a stream, and the fewest merges that make every part classifiable."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import operator
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxtrail.operators.folds import tasks

#: l, r, t, b of a box.
Box = tuple[int, int, int, int]


class Group:
    """The boxes of a group in order of id; a part is a set of their bits. ``links``, if not by distance, has the neighbours of each."""

    def __init__(self, boxes: list[Box], near: float, links: list[int] | None = None) -> None:
        self.boxes, self.whole = boxes, (1 << len(boxes)) - 1
        self.links = links if links is not None else linked(boxes, near)
        self.box, self.around = cache(self._box), cache(self._around)

    @staticmethod
    def apart(a: Box, b: Box) -> float:
        dx, dy = max(0, a[0] - b[1], b[0] - a[1]), max(0, a[2] - b[3], b[2] - a[3])
        return (dx * dx + dy * dy) ** 0.5

    def _box(self, part: int) -> Box:
        l, r, t, b = zip(*(self.boxes[i] for i in bits(part)), strict=True)
        return min(l), max(r), min(t), max(b)

    def _around(self, part: int) -> int:
        """The boxes that are linked to one of the part, without it."""
        found = 0
        for i in bits(part):
            found |= self.links[i]
        return found & ~part

    def nested(self, p: int, q: int) -> bool:
        a, b = self.box(p), self.box(q)
        return a[0] <= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] >= b[3]

    def grown(self, part: int, open_: int, left: int, hopeless: Callable[[int, int], bool] = lambda part, left: False) -> Iterator[int]:
        """Each connected set that holds ``part`` and else boxes of ``left``, once; ``open_`` are those that may be added next.

        None is made from a part and what is left for it, if these are ``hopeless``. The way down is a list, as it may be as
        long as there are boxes.
        """
        if hopeless(part, left):
            return
        yield part
        way = [(part, open_, left)]
        while way:
            part, open_, left = way.pop()
            if not open_:
                continue
            one = open_ & -open_
            left ^= one
            if open_ ^ one and not hopeless(part, left):
                way.append((part, open_ ^ one, left))
            if not hopeless(part | one, left):
                yield part | one
                way.append((part | one, (open_ | self.links[one.bit_length() - 1]) & left, left))

    def firsts(self, left: int, hopeless: Callable[[int, int], bool] = lambda part, left: False) -> Iterator[int]:
        """The parts that the least box of ``left`` may be in."""
        one = left & -left
        yield from self.grown(one, self.links[one.bit_length() - 1] & left & ~one, left & ~one, hopeless)

    def spans(self, some: int, inside: int) -> int:
        """A connected set of boxes of ``inside`` that holds those of ``some``, which are of it; 0 if there is none."""
        seen = todo = some & -some
        taken = some
        while some & ~seen:
            if not todo:
                return 0
            one = 1 << todo.bit_length() - 1
            found = self.links[one.bit_length() - 1] & inside & ~seen
            taken |= one
            seen |= found
            todo = todo ^ one | found
        return taken

    def holds(self, held: int, some: int, inside: int) -> int:
        """A set as of ``spans``: ``held``, which is connected, with what is linked to it, or a new one."""
        if held and not held & ~inside:
            for i in bits(some & ~held):
                if not self.links[i] & held:
                    break
                held |= 1 << i
            else:
                return held
        return self.spans(some, inside)

    def extremes(self, whole: int) -> list[int]:
        """The boxes that reach farthest to each of the four sides, of those of ``whole``."""
        box, out = self.box(whole), [0, 0, 0, 0]
        for i in bits(whole):
            for side in range(4):
                if self.boxes[i][side] == box[side]:
                    out[side] |= 1 << i
        return out

    def halved(self, whole: int, sides: list[tuple[int, int]], parts: tuple[int, ...], one: bool) -> Callable[[int, int], bool]:
        """Whether no un-nested pair of connected parts of ``whole`` comes of a part that may only take what is left for it; but all of it, if ``one``.

        Of such a pair each has all the boxes that reach farthest to some side, by a pair of ``sides``. These and what it
        has already must be connected without those of the other one. With a pair all of ``parts`` stay, so neither may hold one or lie in one.
        """
        ways = self.kept_apart(whole, sides, parts)
        held = [[0, 0] for _ in ways]  # connected sets with what each part must have, found last
        first = [0]  # the way that went last

        def hopeless(part: int, left: int) -> bool:
            other = whole & ~part & ~left
            if one and not other:
                return False
            if any(self.nested(part, p) or self.nested(p, part | left) or other and (self.nested(other, p) or self.nested(p, other | left)) for p in parts):
                return True
            for k in range(first[0], first[0] + len(ways)):
                k %= len(ways)
                (a, b), sets = ways[k], held[k]
                if not a & other and not b & part:
                    sets[0] = self.holds(sets[0], other | b, whole & ~part & ~a)
                    if sets[0]:
                        sets[1] = self.holds(sets[1], part | a, whole & ~other & ~b)
                        if sets[1]:
                            first[0] = k
                            return False
            return True

        return hopeless

    def kept_apart(self, whole: int, sides: list[tuple[int, int]], parts: tuple[int, ...], most: int = 64) -> list[tuple[int, int]]:
        """What one and what the other of two parts that make up ``whole`` must have, in each way in which neither holds one of ``parts``.

        A part holds p only if it reaches as far as p to each of the four sides; so for some side all boxes that do are of
        the other one. Such sets are added to each of ``sides`` and only the least are kept, for as many of ``parts`` as have ``most`` ways at most.
        """
        ways = sides
        for p in parts:
            box = self.box(p)
            beyond = [0, 0, 0, 0]
            for i in bits(whole):
                for side in range(4):
                    if (self.boxes[i][side] >= box[side]) if side % 2 else (self.boxes[i][side] <= box[side]):
                        beyond[side] |= 1 << i
            more = {(a | x, b | y) for a, b in ways for x, y in itertools.product(beyond, repeat=2) if not (a | x) & (b | y)}
            least: list[tuple[int, int]] = []
            for a, b in sorted(more, key=lambda w: (w[0].bit_count() + w[1].bit_count(), w)):
                if all(x & ~a or y & ~b for x, y in least):
                    least.append((a, b))
            if len(least) > most:
                break
            ways = least
        return ways

    def partitions(self, left: int, parts: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
        """The partitions that go on from ``parts`` with connected parts of ``left`` of which none lies in another."""
        if not left:
            yield parts
            return
        for part in self.firsts(left):
            if not any(self.nested(part, p) or self.nested(p, part) for p in parts):
                yield from self.partitions(left & ~part, (*parts, part))

    def pieces(self, left: int) -> list[int]:
        """The connected pieces of a set of boxes."""
        out = []
        while left:
            piece, edge = 0, left & -left
            while edge:
                piece |= edge
                edge = self.around(piece) & left
            out.append(piece)
            left &= ~piece
        return out

    def ranked(self) -> Iterator[tuple[int, ...]]:
        """The partitions into connected, un-nested parts as they are asked for, those of fewest parts first."""
        for n in range(1, len(self.boxes) + 1):
            yield from self.of_parts(self.whole, n, ())

    def of_parts(self, left: int, n: int, parts: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """The partitions that go on from ``parts`` with ``n`` of ``left``: each of its pieces has one at least, the first one ``most``."""
        first, *more = self.pieces(left)
        most = n - len(more)
        apart = lambda x: not any(self.nested(x, p) or self.nested(p, x) for p in parts)
        if most == 1:
            if all(map(apart, (first, *more))) and not any(self.nested(p, q) for p, q in itertools.permutations((first, *more), 2)):
                yield (*parts, first, *more)
            return
        if most < 1:
            return
        far = self.extremes(first)
        covered = functools.reduce(operator.and_, far)  # one box covers all, and so the part that it is in
        if covered and not more:
            return
        if most == 2:
            sides = [(a, b) for a, b in itertools.permutations(far, 2) if not a & b]
            for part in self.firsts(first, self.halved(first, sides, (*parts, *more), bool(more))):
                rest = first & ~part
                if not apart(part):
                    continue
                if not rest:
                    yield from self.of_parts(left & ~part, n - 1, (*parts, part)) if more else ()
                elif any(not a & rest and not b & part for a, b in sides) and self.spans(rest, rest):
                    yield from self.of_parts(left & ~part, n - 1, (*parts, part))
            return
        for part in self.firsts(first, self.crowded(first, most, parts, bool(more))) if not covered else (first,):
            rest = left & ~part
            if rest.bit_count() >= n - 1 >= len(self.pieces(rest)) and apart(part):
                yield from self.of_parts(rest, n - 1, (*parts, part))

    def crowded(self, whole: int, n: int, parts: tuple[int, ...], one: bool) -> Callable[[int, int], bool]:
        """Whether no ``n`` or fewer parts of ``whole``, of which none lies in another or in one of ``parts``, come of a part that may only take what is left for it; but all of it, if ``one``."""

        def hopeless(part: int, left: int) -> bool:
            other = whole & ~part & ~left
            if one and not other:
                return False
            if not other | left or self.nested(part, other | left) or any(self.nested(part, p) or self.nested(p, part | left) for p in parts):
                return True
            apart = [p for p in self.pieces(other | left) if p & other]
            return len(apart) > n - 1 or any(self.nested(part, x) for x in apart)

        return hopeless

    def text(self, parts: tuple[int, ...]) -> str:
        """The parts' numbers, in order of their least box, box by box."""
        of = {i: k for k, part in enumerate(sorted(parts, key=lambda p: p & -p)) for i in bits(part)}
        return ",".join(str(of[i]) for i in range(len(self.boxes)))


def linked(boxes: list[Box], near: float, each_way: bool = False) -> list[int]:
    """The boxes that lie closer than ``near`` to each, but itself; ``each_way``: along both axes apart, as in components.closer."""
    l, r, t, b = np.array(boxes, np.float64).reshape(-1, 4).T
    out = []
    for i in range(len(boxes)):
        dx, dy = np.maximum(0, np.maximum(l - r[i], l[i] - r)), np.maximum(0, np.maximum(t - b[i], t[i] - b))
        close = (np.maximum(dx, dy) if each_way else np.sqrt(dx * dx + dy * dy)) < near
        close[i] = False
        out.append(int.from_bytes(np.packbits(close, bitorder="little").tobytes(), "little"))
    return out


def bits(part: int) -> Iterator[int]:
    while part:
        one = part & -part
        yield one.bit_length() - 1
        part ^= one


def gathered(blobs: DataFrame) -> DataFrame:
    """grp, boxes: the boxes of each group in order of id. A group lies in one frame, so the sensor bounds it."""
    return blobs.repartition(tasks(blobs), "grp").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("id", "l", "r", "t", "b"))).alias("boxes"))


def groups_of(batch: pa.RecordBatch, near: float, each_way: bool) -> Iterator[Group]:
    for rows in batch["boxes"].to_pylist():
        boxes = [(x["l"], x["r"], x["t"], x["b"]) for x in rows]
        yield Group(boxes, near, linked(boxes, near, each_way))


def merge_partitions(blobs: DataFrame, near: float = 10.0, rows: int = 10_000, each_way: bool = False) -> DataFrame:
    """grp, partition, parts: all partitions of each group of blobs(grp, id, l, r, t, b) into connected, un-nested parts.

    A partition is written as the parts' numbers in order of id. A group's work is dealt out by the part that holds its
    least box, so that a large group goes to many tasks; a task makes its partitions as they are asked for, ``rows`` at a
    time, and holds no list of them. Only connected parts are made, by links as of ``linked``; with ``each_way`` these are
    the links that make the groups. Their number may grow exponentially with a group; none is left out.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int64()), ("branch", pa.string()), ("boxes", pa.list_(pa.struct([(c, pa.int64()) for c in ("id", "l", "r", "t", "b")])))])
        for batch in batches:
            held = []
            for grp, boxes, group in zip(batch["grp"].to_pylist(), batch["boxes"].to_pylist(), groups_of(batch, near, each_way), strict=True):
                for part in group.firsts(group.whole):
                    held.append({"grp": grp, "branch": f"{part:x}", "boxes": boxes})
                    if len(held) == rows:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
            yield pa.RecordBatch.from_pylist(held, schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int64()), ("partition", pa.string()), ("parts", pa.int32())])
        for batch in batches:
            held = []
            for grp, branch, group in zip(batch["grp"].to_pylist(), batch["branch"].to_pylist(), groups_of(batch, near, each_way), strict=True):
                first = int(branch, 16)
                for parts in group.partitions(group.whole & ~first, (first,)):
                    held.append({"grp": grp, "partition": group.text(parts), "parts": len(parts)})
                    if len(held) == rows:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
            yield pa.RecordBatch.from_pylist(held, schema)

    branches = gathered(blobs).mapInArrow(dealt, "grp long, branch string, boxes array<struct<id:long,l:long,r:long,t:long,b:long>>")
    return branches.repartition(tasks(blobs, 4), "grp", "branch").mapInArrow(listed, "grp long, partition string, parts int")


def fewest_merges(group: Group, fits: Callable[[Box], bool]) -> tuple[int, ...] | None:
    """The parts after the fewest merges that leave only parts that fit and of which none lies in another; None where none do.

    Best first over sequences of merges, without repeated states. A merge only ever joins the least part that does not fit
    (or, where all do, one of the first two nested parts) with a linked one: in any solution that part has to grow. Parts
    that do not fit cost a merge each, but for a final part made of such alone, which saves one and takes two of them at
    least; so at most half of each linked set of such parts is saved, and none where the whole set does not fit.
    """
    good = cache(lambda part: fits(group.box(part)))
    if not group.boxes or not good(group.whole):  # what does not fit does not fit in part either
        return None

    def bound(small: list[int]) -> int:
        total, left = len(small), sum(small)
        while left:
            at = next(p for p in small if p & left)
            own, edge, n = 0, at, 0
            while edge:
                own |= edge
                reach = group.around(own)
                edge = sum(p for p in small if p & reach and p & left and not p & own)
            n = sum(1 for p in small if p & own)
            total -= n // 2 if good(own) else 0
            left &= ~own
        return total

    start = tuple(1 << i for i in range(len(group.boxes)))
    todo, seen = [(0, 0, start)], {start}
    while todo:
        _, minus, parts = heapq.heappop(todo)
        small = [p for p in parts if not good(p)]
        if small:
            grow = small[:1]
        else:
            grow = next(([p, q] for p in parts for q in parts if p != q and group.nested(p, q)), None)
            if grow is None:
                return parts
        for p in grow:
            reach = group.around(p)
            for q in parts:
                if q & reach:
                    state = tuple(sorted([x for x in parts if x not in (p, q)] + [p | q], key=lambda x: x & -x))
                    if state not in seen:
                        seen.add(state)
                        merges = 1 - minus
                        heapq.heappush(todo, (merges + bound([x for x in state if not good(x)]), -merges, state))
    return None


def merge_search(blobs: DataFrame, least: float = 30.0, near: float = 10.0, each_way: bool = False) -> DataFrame:
    """grp, partition, merges: the fewest merges after which every part of a group of blobs(grp, id, l, r, t, b) is wide and
    high enough to be classified, ``least`` each way; no row where no partition into connected, un-nested parts is.

    Exact for groups of any size; of as few merges, the sequence found first, in order of the boxes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int64()), ("partition", pa.string()), ("merges", pa.int64())])
        for batch in batches:
            held = []
            for grp, group in zip(batch["grp"].to_pylist(), groups_of(batch, near, each_way), strict=True):
                parts = fewest_merges(group, lambda b: b[1] - b[0] + 1 >= least and b[3] - b[2] + 1 >= least)
                if parts is not None:
                    held.append({"grp": grp, "partition": group.text(parts), "merges": len(group.boxes) - len(parts)})
            yield pa.RecordBatch.from_pylist(held, schema)

    return gathered(blobs).mapInArrow(run, "grp long, partition string, merges long")


def new_objects(blobs: DataFrame, retained: int = 10, near: float = 10.0, each_way: bool = False) -> DataFrame:
    """grp, nth, partition, p: how the boxes of each group of blobs(grp, id, l, r, t, b) may begin as new objects, the
    ``retained`` likeliest ways, made as they are needed.

    A part with all boxes of its group has probability 1, a lone box of several 0.9, others by their share of boxes between
    them; a way's ``p`` is the mean of its parts', so ways of fewer objects come first, then in order of the boxes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int64()), ("nth", pa.int32()), ("partition", pa.string()), ("p", pa.float64())])
        for batch in batches:
            held = []
            for grp, group in zip(batch["grp"].to_pylist(), groups_of(batch, near, each_way), strict=True):
                for k, parts in enumerate(itertools.islice(group.ranked(), retained)):
                    held.append({"grp": grp, "nth": k, "partition": group.text(parts), "p": round(sum(likely(p.bit_count(), len(group.boxes)) for p in parts) / len(parts), 6)})
            yield pa.RecordBatch.from_pylist(held, schema)

    return gathered(blobs).mapInArrow(run, "grp long, nth int, partition string, p double")


def likely(boxes: int, of: int) -> float:
    """The probability of a new object that takes so many boxes of its group."""
    return 0.9 + 0.1 * (boxes - 1) / (of - 1) if of > 1 else 1.0


def corresponding_merges(boxes: dict[int, Box], overlap: float, near: float, p: Callable[[Box], float]) -> dict[int, tuple[Box, int]]:
    """The boxes of a frame after the best pairs were merged one after another, each by its least id, with how many it is made of.

    A pair corresponds if one box covers more than ``overlap`` of the other, or if both lie closer than ``near`` and are one
    more probably than either alone. Pairs that overlap go first, by the share covered, then those of the highest
    probability, then the least ids. A merge drops the pairs of both boxes and enters those of the new one, until none is left.
    """
    ids = np.array(sorted(boxes), np.int64)
    box = np.array([boxes[i] for i in ids.tolist()], np.int64).reshape(-1, 4)
    made, age, there = np.ones(len(ids), np.int64), [0] * len(ids), np.ones(len(ids), bool)
    known = cache(p)
    alone = np.array([known(tuple(x)) for x in box.tolist()])
    todo: list[tuple] = []
    live = np.arange(len(ids))  # those left, with some merged lately
    first = np.full((len(ids), 2), np.inf)  # kind and value below 0 of the first entry of each

    def pairs(i: int, own: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``own`` correspond to i, with the kind and the value of each pair; close ones, unless ``every``, only where none overlap."""
        one, other = box[i], box[own]
        w, h = np.minimum(one[1], other[:, 1]) - np.maximum(one[0], other[:, 0]) + 1, np.minimum(one[3], other[:, 3]) - np.maximum(one[2], other[:, 2]) + 1
        area = np.minimum((one[1] - one[0] + 1) * (one[3] - one[2] + 1), (other[:, 1] - other[:, 0] + 1) * (other[:, 3] - other[:, 2] + 1))
        value = np.where((w > 0) & (h > 0), w * h / area, 0.0)
        kind = np.where(value > overlap, 0, 2)
        dx, dy = np.maximum(0, 1 - w), np.maximum(0, 1 - h)
        open_ = (kind > 0) & ((dx * dx + dy * dy) ** 0.5 < near) & (first[own, 0] > 0) if every else (kind > 0) & ((dx * dx + dy * dy) ** 0.5 < near) & bool(kind.all())
        for k in np.flatnonzero(open_).tolist():
            a, b = one, other[k]
            joint = known((int(min(a[0], b[0])), int(max(a[1], b[1])), int(min(a[2], b[2])), int(max(a[3], b[3]))))
            if joint > max(alone[i], alone[own[k]]):
                kind[k], value[k] = 1, joint
        found = np.flatnonzero(kind < 2)
        return own[found], kind[found], value[found]

    def best(i: int) -> None:
        """Enters the best pair of i with a box of a higher id; the others wait until that one has gone."""
        own = live[np.searchsorted(live, i, "right") :]
        own, kind, value = pairs(i, own[there[own]], False)
        first[i] = np.inf
        if len(own):
            k = np.lexsort((own, -value, kind))[0]
            first[i] = kind[k], -value[k]
            heapq.heappush(todo, (int(kind[k]), -float(value[k]), i, int(own[k]), age[i], age[own[k]]))

    for i in range(len(ids)):
        best(i)
    while todo:
        _, _, i, j, age_i, age_j = heapq.heappop(todo)
        if not there[i] or age[i] != age_i:
            continue
        if not there[j] or age[j] != age_j:
            best(i)
            continue
        there[j] = False
        a, b = box[i], box[j]
        box[i] = min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])
        made[i], age[i], alone[i] = made[i] + made[j], age[i] + 1, known(tuple(box[i].tolist()))
        if 2 * there[live].sum() < len(live):
            live = live[there[live]]
        best(i)
        below = live[: np.searchsorted(live, i)]
        own, kind, value = pairs(i, below[there[below]], True)
        better = (kind < first[own, 0]) | (kind == first[own, 0]) & (-value <= first[own, 1])  # else its first entry comes before, and looks anew if it is void
        for k, kind_k, value_k in zip(own[better].tolist(), kind[better].tolist(), value[better].tolist(), strict=True):
            first[k] = kind_k, -value_k
            heapq.heappush(todo, (kind_k, -value_k, k, i, age[k], age[i]))
    return {int(ids[i]): (tuple(box[i].tolist()), int(made[i])) for i in np.flatnonzero(there)}


def merged_by_correspondence(blobs: DataFrame, models: list[tuple[float, float, float, float]], overlap: float = 0.4, near: float = 10.0) -> DataFrame:
    """frame, id, l, r, t, b, made: blobs(frame, id, l, r, t, b) after the merges of ``corresponding_merges``.

    A box's probability is that of the best of ``models`` (mean, sigma, lo, hi of width and height alike), 0 outside all
    limits. Ids are unique within a frame, which the sensor bounds and which is one task's rows.
    """

    def p(box: Box) -> float:
        w, h = box[1] - box[0] + 1, box[3] - box[2] + 1
        fits = (math.exp(-((w - m) ** 2 + (h - m) ** 2) / (2 * s * s)) for m, s, lo, hi in models if lo <= min(w, h) and max(w, h) <= hi)
        return max(fits, default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("frame", "id", "l", "r", "t", "b", "made")])
        for batch in batches:
            held = []
            for frame, boxes in zip(batch["grp"].to_pylist(), batch["boxes"].to_pylist(), strict=True):
                found = corresponding_merges({x["id"]: (x["l"], x["r"], x["t"], x["b"]) for x in boxes}, overlap, near, p)
                held += [dict(zip(schema.names, (frame, i, *box, n), strict=True)) for i, (box, n) in sorted(found.items())]
            yield pa.RecordBatch.from_pylist(held, schema)

    return gathered(blobs.withColumnRenamed("frame", "grp")).mapInArrow(run, "frame long, id long, l long, r long, t long, b long, made long")
