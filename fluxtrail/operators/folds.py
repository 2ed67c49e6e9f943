"""Ordered recursions with bounded memory: rows are hash-partitioned by key, sorted within, and folded as they stream by.

A key's history is never gathered into one value, so a key that holds a third of all rows costs time but no memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: (state, row) -> output rows; (key) -> state; (state) -> last output rows.
Step = Callable[[Any, Any], list[tuple]]


def tasks(df: DataFrame, each: int = 2) -> int:
    """Partitions for few rows with long work, which Spark's own count, made for many rows with little work, would put together."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * spark.sparkContext.defaultParallelism)


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[], Any], step: Step, finish: Callable[[Any], list[tuple]] | None = None, heavy: bool = False) -> DataFrame:
    """The output rows of ``step`` over each key's rows in order, then those of ``finish``.

    ``start`` makes the mutable state of a key. Rows with a null key form one key. An empty table gives no rows. ``heavy``
    is for few keys with long work: they are dealt by range to more tasks than there are keys, so that each has a task of its
    own (by hash two may meet in one, as view and error do); a range's bounds are a sample of the rows, which are read twice.
    """
    names = [f.strip().split()[0].strip(":") for f in schema.split(",")]
    dealt = df.repartitionByRange(tasks(df, 8), *keys) if heavy else df.repartition(*keys)
    rows = dealt.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(None if pd.isna(v) else v for v in (getattr(row, k) for k in keys))
                if key != now:
                    if finish and now is not None:
                        out.extend(finish(state))
                    now, state = key, start()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)
        if finish and now is not None:
            yield pd.DataFrame(finish(state), columns=names)

    return rows.mapInPandas(run, schema)


def background(pixels: DataFrame, alpha: float = 0.1) -> DataFrame:
    """x, y, frame, bg: the running background of a channel ``v`` after each frame, truncated to a byte each time."""

    def step(state: dict, row: Any) -> list[tuple]:
        old = state.get("bg")
        state["bg"] = int(row.v) if old is None else min(255, max(0, int((1 - alpha) * old + alpha * row.v + 1e-9)))
        return [(row.x, row.y, row.frame, state["bg"])]

    return ordered_fold(pixels, ["x", "y"], ["frame"], "x long, y long, frame long, bg long", dict, step)


# The codes of a block's state; the counters of still and moving blocks count up from theirs.
UNDEFINED, BACKGROUND, STILL_OBJ, ILLUM_CHANGE, MOVING_OBJ = 0, 2, 49, 250, 253


def block_states(blocks: DataFrame, correlation: float = 0.5, still: int = 20, keep: float = 0.95) -> DataFrame:
    """bx, by_, frame, code, bg: state and background of each block after each frame.

    ``blocks`` has bx, by_, frame, moving (boolean) and ``px``, the block's pixels in row order. A still block that
    correlates with the background is BACKGROUND, else STILL_OBJ and counted; a moving one that does is ILLUM_CHANGE, else
    MOVING_OBJ. BACKGROUND and ILLUM_CHANGE blend into the background, a block still for ``still`` frames replaces it, and
    a block that moves twice does where its own inner edges are smoother. Blocks of constant pixels correlate fully with
    any constant and with nothing else. A null pixel is one that the frame does not have: it is left out where blocks are
    compared, and the background keeps what it knows of it.
    """

    def correlated(a: list, b: list) -> float:
        both = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
        if not both:
            return 1.0
        a, b = zip(*both, strict=True)
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        va, vb = sum((x - ma) ** 2 for x in a), sum((x - mb) ** 2 for x in b)
        if va == 0 or vb == 0:
            return float(va == vb)
        return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(va * vb)

    def rough(a: list) -> float:
        side = max(1, math.isqrt(len(a)))
        return sum((x - y) ** 2 for x, y in zip(a, a[side:], strict=False) if x is not None and y is not None)

    def filled(new: list, old: list) -> list:
        return [y if x is None else x for x, y in zip(new, old, strict=True)]

    def step(state: dict, row: Any) -> list[tuple]:
        own, before = [None if v is None or v != v else float(v) for v in row.px], state.get("code", UNDEFINED)
        bg = state.get("bg", own)
        if before == UNDEFINED and row.moving:
            code = UNDEFINED
        else:
            like = correlated(own, bg) > correlation
            if row.moving:
                code = ILLUM_CHANGE if like else MOVING_OBJ + (MOVING_OBJ <= before <= MOVING_OBJ + 1)
            elif like:
                code = BACKGROUND
            else:
                code = min(STILL_OBJ + still, before + 1) if STILL_OBJ <= before <= STILL_OBJ + still else STILL_OBJ
            taken = before == UNDEFINED and code in (BACKGROUND, STILL_OBJ) or code == STILL_OBJ + still
            if taken or code == MOVING_OBJ + 1 and rough(own) < rough(bg):
                bg = filled(own, bg)
            elif code in (BACKGROUND, ILLUM_CHANGE):
                bg = [v if b is None else b if v is None else keep * b + (1 - keep) * v for b, v in zip(bg, own, strict=True)]
        state.update(code=code, bg=bg)
        known = [b for b in bg if b is not None]
        return [(row.bx, row.by_, row.frame, code, round(sum(known) / len(known), 6) if known else None)]

    return ordered_fold(blocks, ["bx", "by_"], ["frame"], "bx long, by_ long, frame long, code int, bg double", dict, step)


class Attribute:
    """Value, velocity and acceleration of one attribute, each with deviation, coherence and accumulated reliability."""

    def __init__(self, acuity: float = 3.0, rate: float = 0.1, least: float = 0.1) -> None:
        self.acuity, self.rate, self.least = acuity, rate, least
        self.t = self.seen = self.seen_t = None
        self.weight = 0.0
        self.parts = [{"value": 0.0, "sd": 0.0, "rc": 0.0, "rd": 0.0, "acc": 0.0} for _ in range(3)]
        self.last_v = None

    def estimate(self, dt: float) -> float:
        att, v, a = self.parts
        if a["rc"] >= self.least and v["rc"] >= self.least:
            return att["value"] + v["value"] * dt + 0.5 * a["value"] * dt * dt
        return att["value"] + (v["value"] * dt if v["rc"] >= self.least else 0.0)

    def blend(self, part: dict, data: float, guess: float, rd: float, cool: float, acuity: float) -> None:
        old = part["acc"]
        part["acc"] = rd + cool * old
        if part["acc"] <= 0:
            return
        part["rd"] = min(1.0, max(0.0, part["acc"] / self.weight))
        part["sd"] = math.sqrt(cool * old / part["acc"] * (part["sd"] ** 2 + rd * (data - guess) ** 2 / max(part["rd"], 1e-9)))
        part["rc"] = 0.0 if old == 0 else (1.0 if part["sd"] <= acuity else acuity / part["sd"])
        part["value"] = (data * rd + cool * old * guess) / part["acc"]

    def see(self, t: float, data: float | None, rd: float) -> None:
        """A sample at time t; no data decays the reliability and leaves the estimate."""
        dt = 0.0 if self.t is None else t - self.t
        cool = math.exp(-self.rate * dt)
        self.weight = 1.0 if self.t is None else 1.0 + cool * self.weight
        guess, (att, v, a) = self.estimate(dt), self.parts
        self.t = t
        if data is None:
            if att["rc"] < 1e-7:
                att.update(rc=0.0, rd=0.0, acc=0.0, sd=max(att["sd"], self.acuity))
            else:
                att.update(acc=att["acc"] * cool, sd=math.sqrt(att["sd"] ** 2 + self.acuity**2 / max(att["rd"], 1e-9)), value=guess)
                att["rd"] = min(1.0, att["acc"] / self.weight)
            return
        first = self.seen is None
        self.blend(att, data, data if first else guess, rd, cool, self.acuity)
        if first:
            att["rc"] = 1.0
        elif t > self.seen_t:
            gap = t - self.seen_t
            speed, old_v = (data - self.seen) / gap, v["value"]
            self.blend(v, speed, old_v if v["acc"] else speed, rd, cool, self.acuity / gap)
            if self.last_v is not None:
                self.blend(a, (speed - self.last_v) / gap, a["value"], rd, cool, self.acuity / gap**2)
            self.last_v = speed
        if first or t > self.seen_t:
            self.seen, self.seen_t = data, t


ATTRIBUTE = "object_id long, det_id long, value double, sd double, rc double, rd double, v double, a double"


def attributes(samples: DataFrame, acuity: float = 3.0, rate: float = 0.1) -> DataFrame:
    """The full reliability recursion over samples(object_id, det_id, t, data, rd): one row per sample; null data is no data."""

    def step(state: Attribute, row: Any) -> list[tuple]:
        state.see(row.t, None if pd.isna(row.data) else row.data, row.rd)
        att, v, a = state.parts
        return [(row.object_id, row.det_id, *(round(float(x), 6) for x in (att["value"], att["sd"], att["rc"], att["rd"], v["value"], a["value"])))]

    return ordered_fold(samples, ["object_id"], ["t", "det_id"], ATTRIBUTE, lambda: Attribute(acuity, rate), step)


def cooled_probability(samples: DataFrame, rate: float = 6.0) -> DataFrame:
    """object_id, det_id, p: the cooled running mean of rd over samples(object_id, det_id, t, rd)."""

    def step(state: dict, row: Any) -> list[tuple]:
        cool = math.exp(-rate * (row.t - state.get("t", row.t))) if state else 0.0
        state.update(t=row.t, acc=row.rd + cool * state.get("acc", 0.0), n=1 + cool * state.get("n", 0.0))
        return [(row.object_id, row.det_id, round(state["acc"] / state["n"], 6))]

    return ordered_fold(samples, ["object_id"], ["t", "det_id"], "object_id long, det_id long, p double", dict, step)
