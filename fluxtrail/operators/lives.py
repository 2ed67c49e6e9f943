"""Lives of blobs under a foreground test, the one focus object of a stream, and weighted Gaussians with a floor, as folds."""

from __future__ import annotations

import math
from collections import deque
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from fluxtrail.operators.folds import ordered_fold

#: Frames' worth of bad evidence that a blob survives; a blob too small or out of the image adds 3, any other bad one 1.
PATIENCE = 3


def blob_lives(evidence: DataFrame, least: float = 0.1) -> DataFrame:
    """object_id, det_id, life, bad, deleted over evidence(object_id, t_us, det_id, cover, fits), in order of time.

    A blob's first frame begins a life unchecked. A frame whose foreground cover is above ``least`` clears the count;
    others add to it (a null cover is none), and a blob with more than PATIENCE is deleted, so that the next sight of the
    object is a new life. An empty table gives no rows.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        if state.get("deleted", True):
            state.update(life=state.get("life", 0) + 1, bad=0, deleted=False)
        else:
            seen = row.fits and not pd.isna(row.cover) and row.cover > least
            state["bad"] = 0 if seen else state["bad"] + (1 if row.fits else 3)
            state["deleted"] = state["bad"] > PATIENCE
        return [(row.object_id, row.det_id, state["life"], state["bad"], state["deleted"])]

    return ordered_fold(evidence, ["object_id"], ["t_us", "det_id"], "object_id long, det_id long, life int, bad int, deleted boolean", dict, step)


def weighted_gaussians(samples: DataFrame, acuity: float) -> DataFrame:
    """key, n, mean, sigma of samples(key, t_us, det_id, x, w): weighted moments whose deviation never falls below ``acuity``.

    The floor holds after each sample, so order matters. Samples of null x or of no positive weight are passed over; a
    key with no other gives no row.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        if pd.isna(row.x) or pd.isna(row.w) or row.w <= 0:
            return []
        if not state:
            state.update(key=row.key, n=1, mean=float(row.x), sigma=acuity, weight=float(row.w))
            return []
        old, w = state["weight"], float(row.w)
        total, off = old + w, float(row.x) - state["mean"]
        spread = old / total * (state["sigma"] ** 2 + w * off * off / total)
        state.update(n=state["n"] + 1, mean=state["mean"] + w * off / total, sigma=max(acuity, math.sqrt(spread)), weight=total)
        return []

    def finish(state: dict) -> list[tuple]:
        return [(state["key"], state["n"], round(state["mean"], 5), round(state["sigma"], 5))] if state else []

    return ordered_fold(samples, ["key"], ["t_us", "det_id"], "key string, n long, mean double, sigma double", dict, step, finish)


# The length of the body without and with tail, in plane units, and the frames that are remembered.
BODY, WHOLE, RING = 20.0, 28.5, 5
FOCUS = "stream string, frame long, mode string, x double, y double, head_x double, head_y double, reliability double"


class Focus:
    """The one object that a stream follows: its last sights (frame, centre), its head and how sure that is."""

    def __init__(self) -> None:
        self.sights: deque[tuple[int, float, float]] = deque(maxlen=RING)
        self.offset, self.sure, self.unseen = (0.0, 0.0), 0.0, 0

    def head(self) -> tuple[float, float]:
        _, x, y = self.sights[-1]
        return x + self.offset[0], y + self.offset[1]

    def point(self, row: Any) -> None:
        """Turns the head to the broad end of the axis, or to the end where a sure head would have moved to."""
        ends = ((row.x1, row.y1), (row.x2, row.y2))
        broad = 0 if row.half1 > row.half2 else 1
        sure = 1.0 - abs(row.length - WHOLE) / WHOLE
        if self.sure > 0.9:
            due = (row.x + self.offset[0], row.y + self.offset[1])
            near = min((0, 1), key=lambda k: math.dist(ends[k], due))
            if near != broad:
                broad, sure = near, 0.9 * self.sure
        self.offset, self.sure = (ends[broad][0] - row.x, ends[broad][1] - row.y), sure

    def see(self, row: Any) -> str:
        if pd.isna(row.x) or pd.isna(row.y):
            self.unseen += 1
            if self.unseen > RING or not self.sights:
                self.sights.clear()
                self.sure = 0.0
                return "lost"
            frame, x, y = self.sights[-1]
            if len(self.sights) > 1:
                before, px, py = self.sights[-2]
                ahead = (row.frame - frame) / max(1, frame - before)
                x, y = x + (x - px) * ahead, y + (y - py) * ahead
            self.sights.append((row.frame, x, y))
            return "keep"
        self.unseen = 0
        if not self.sights:
            self.offset = (0.0, 0.0)
        hull = not any(pd.isna(v) for v in (row.x1, row.y1, row.x2, row.y2, row.half1, row.half2, row.length))
        hull = hull and row.length > BODY
        if hull:
            self.point(row)
        self.sights.append((row.frame, row.x, row.y))
        return "insert" if hull else "move"


def focus(sights: DataFrame) -> DataFrame:
    """stream, frame, mode, x, y, head_x, head_y, reliability of the stream's focus object in each frame.

    ``sights`` has one row per stream and frame: its centre x, y (null: not seen), and of its hull the ends x1, y1, x2, y2
    of the axis, the sums half1, half2 of the widths towards each end, and the axis' length on the plane (null: no hull).
    insert: the head is taken from the hull; move: no hull longer than a body, the head keeps its place to the centre;
    keep: not seen, the centre goes on with its last velocity; lost: not seen for more than RING frames, no position.
    """

    def step(state: Focus, row: Any) -> list[tuple]:
        mode = state.see(row)
        if mode == "lost":
            return [(row.stream, row.frame, mode, None, None, None, None, 0.0)]
        _, x, y = state.sights[-1]
        return [(row.stream, row.frame, mode, *(round(float(v), 4) for v in (x, y, *state.head(), state.sure)))]

    return ordered_fold(sights, ["stream"], ["frame"], FOCUS, Focus, step)
