"""Background by consensus of samples: each pixel keeps a few earlier values, of which the scene's own are replaced at random."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from fluxtrail.operators.folds import ordered_fold

FOUND = "clip long, frame long, x long, y long, matches long, fg int"


def drawn(seed: int, frame: int, x: np.ndarray, y: np.ndarray, purpose: int) -> np.ndarray:
    """A number below 2^32 for each pixel, from a hash of where, when and what for: reruns and retries draw the same."""
    h = np.full(x.shape, seed, np.uint64)
    for part in (frame, x, y, purpose):
        h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h >> np.uint64(32)


class Model:
    """The samples of every pixel of a clip. Pixels are added as they are first seen, with samples from around them."""

    def __init__(self, samples: int, radius: int, least: int, rate: int, seed: int) -> None:
        self.n, self.radius, self.least, self.rate, self.seed = samples, radius, least, rate, seed
        self.at: dict[tuple[int, int], int] = {}
        self.kept = np.empty((0, samples), np.int64)
        self.clip, self.frame, self.held = None, None, {}

    def classify(self) -> list[tuple]:
        """Rows of the frame held: a pixel is background if enough samples are near its value. Then all background pixels
        replace one of their samples, and one of a neighbour's, each once in ``rate`` draws, in order of y and x."""
        places = sorted(self.held, key=lambda p: (p[1], p[0]))
        x, y = np.array(places).T
        v = np.array([self.held[p] for p in places])
        draw = lambda purpose: drawn(self.seed, self.frame, x, y, purpose)
        new = [k for k, p in enumerate(places) if p not in self.at]
        if new:
            start = np.empty((len(new), self.n), np.int64)
            for i in range(self.n):
                turn = draw(100 + i) % 9
                near = [self.held.get((places[k][0] + int(turn[k]) % 3 - 1, places[k][1] + int(turn[k]) // 3 - 1), v[k]) for k in new]
                start[:, i] = near
            for k in new:
                self.at[places[k]] = len(self.at)
            self.kept = np.concatenate([self.kept, start])
        rows = np.array([self.at[p] for p in places])
        matches = (np.abs(self.kept[rows] - v[:, None]) <= self.radius).sum(1)
        fg = matches < self.least
        own, spread = ~fg & (draw(1) % self.rate == 0), ~fg & (draw(2) % self.rate == 0)
        self.kept[rows[own], (draw(3) % self.n)[own]] = v[own]
        turn, slot = draw(4) % 8, draw(5) % self.n
        for k in np.flatnonzero(spread):
            t = int(turn[k]) + (turn[k] >= 4)  # around the middle of nine
            other = self.at.get((places[k][0] + t % 3 - 1, places[k][1] + t // 3 - 1))
            if other is not None:
                self.kept[other, slot[k]] = v[k]
        out = [(self.clip, self.frame, *p, int(m), int(f)) for p, m, f in zip(places, matches, fg, strict=True)]
        self.held = {}
        return out


def foreground(pixels: DataFrame, samples: int = 20, radius: int = 20, least: int = 2, rate: int = 16, seed: int = 7) -> DataFrame:
    """FOUND rows of pixels(clip, frame, x, y, v): how many of a pixel's samples lie within ``radius`` of its value, and
    whether it is foreground, as fewer than ``least`` are.

    A clip is folded frame by frame in one task, whose state is ``samples`` values for each of its pixels; clips are apart.
    Of repeated pixels the largest value counts; rows with a null are passed over.
    """

    def step(model: Model, row: Any) -> list[tuple]:
        out = model.classify() if model.held and row.frame != model.frame else []
        model.clip, model.frame = int(row.clip), int(row.frame)
        model.held[int(row.x), int(row.y)] = int(row.v)
        return out

    used = pixels.select("clip", "frame", "x", "y", "v").dropna()
    finish = lambda m: m.classify() if m.held else []
    return ordered_fold(used, ["clip"], ["frame", "y", "x", "v"], FOUND, lambda: Model(samples, radius, least, rate, seed), step, finish, heavy=True)
