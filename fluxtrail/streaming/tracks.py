"""Live versions of the recursions: state per object across micro-batches, and sessions as a track's life."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxtrail.operators.folds import Attribute

STATE = "t double, seen double, seen_t double, weight double, last_v double, parts array<double>"
OUT = "object_id long, frame long, value double, rd double, status string"
FIELDS = ("value", "sd", "rc", "rd", "acc")


def packed(a: Attribute) -> tuple:
    return a.t, a.seen, a.seen_t, a.weight, a.last_v, [float(p[f]) for p in a.parts for f in FIELDS]


def unpacked(kept: tuple, acuity: float, rate: float) -> Attribute:
    out = Attribute(acuity, rate)
    out.t, out.seen, out.seen_t, out.weight, out.last_v, flat = kept
    out.parts = [dict(zip(FIELDS, flat[k * 5 : k * 5 + 5], strict=True)) for k in range(3)]
    return out


def reliability(samples: DataFrame, expire: str = "10 minutes", late: str = "1 minute", acuity: float = 3.0, rate: float = 0.1) -> DataFrame:
    """The reliability recursion over a stream samples(object_id, frame, ts, data, rd): a row a sample, and one when an object expires.

    Within a batch an object's samples are folded in order of ts; one at or before the object's last time is passed over, as
    frames are strictly ordered. State is a few numbers an object and goes when none came for ``expire`` of event time.
    """
    wait = pd.Timedelta(expire)

    def fold(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OUT.split(", ")]
        if state.hasTimedOut:
            kept = unpacked(state.get, acuity, rate)
            state.remove()
            yield pd.DataFrame([(key[0], -1, kept.parts[0]["value"], kept.parts[0]["rd"], "EXPIRED")], columns=names)
            return
        kept = unpacked(state.get, acuity, rate) if state.exists else Attribute(acuity, rate)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "frame"])
        for row in rows.itertuples(index=False):
            t = row.ts.timestamp()
            if kept.t is not None and t <= kept.t:
                continue
            kept.see(t, None if pd.isna(row.data) else row.data, row.rd)
            out.append((key[0], row.frame, kept.parts[0]["value"], kept.parts[0]["rd"], "SEEN" if not pd.isna(row.data) else "LOST"))
        if kept.t is not None:
            state.update(packed(kept))
            state.setTimeoutTimestamp(max(int(kept.t * 1000 + wait.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    keyed = samples.withWatermark("ts", late).select("object_id", "frame", "ts", "data", "rd").groupBy("object_id")
    return keyed.applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def lives(samples: DataFrame, gap: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """object_id, started, ended, samples: each life of an object, which ends when none came for ``gap``."""
    spans = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("life"), "object_id").agg(F.count(F.lit(1)).alias("samples"))
    return spans.select("object_id", F.col("life.start").alias("started"), F.col("life.end").alias("ended"), "samples")
