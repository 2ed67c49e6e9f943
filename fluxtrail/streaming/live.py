"""The multi-hypothesis tracker on a stream: its hypothesis sets live in the state of a stateful query, one key a stream.

A frame is tracked once the watermark has passed it, so its boxes may come in any order and in any micro-batch; a timer on
the next frame that waits wakes a stream that gets no boxes. A box of a frame that is tracked already, or at or before the
watermark, is late and is dropped. The rows are those of the batch fold over the boxes that were not late.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxtrail.operators import tracker
from fluxtrail.plans import session

BOXES = "stream string, frame long, id long, kind string, l long, r long, t long, b long"


class Seen(NamedTuple):
    """A box that waits for its frame."""

    frame: int
    id: int
    kind: str
    l: float
    r: float
    t: float
    b: float


def live_tracks(blobs: DataFrame, late: str = "1 second", frame_ms: int = 1000, settings: tracker.Settings = tracker.CONFIGURATIONS["multi_model"]) -> DataFrame:
    """tracker.TRACKS rows of a stream of blobs(stream, frame, id, kind, l, r, t, b), as their frames end.

    A frame's event time is ``frame_ms`` times its number from 1970 on, and boxes may come ``late`` after the latest one.
    Boxes of no stream or frame are passed over. State is that of the live objects, and the boxes of frames that wait.
    """
    names = [c.split()[0] for c in tracker.TRACKS.split(", ")]
    whole = {c: "Int64" for c in ("frame", "set_id", "object_id")}

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        before, waiting = pickle.loads(state.get[0]) if state.exists else (None, [])
        kept = tracker.restored(before, settings) if before else tracker.Stream(settings, key[0])
        waiting = [Seen(*w) for w in waiting]
        for rows in frames:
            columns = [rows[c].tolist() for c in Seen._fields]
            waiting += [Seen(*row) for row in zip(*columns, strict=True) if kept.frame is None or row[0] > kept.frame]
        waiting.sort()
        passed = state.getCurrentWatermarkMs() // frame_ms
        out: list[tuple] = []
        while waiting and waiting[0].frame <= passed:
            now = waiting[0].frame
            kept.frame, kept.held = now, [w for w in waiting if w.frame == now]
            waiting = waiting[len(kept.held) :]
            out += tracker.advance(kept)
        state.update((pickle.dumps((tracker.plain(kept) if kept.frame is not None else None, [tuple(w) for w in waiting])),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0].frame * frame_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names).astype(whole)

    rows = blobs.filter("frame IS NOT NULL").withColumn("at", F.timestamp_millis(F.col("frame") * frame_ms + 1)).withWatermark("at", late)
    return rows.groupBy("stream").applyInPandasWithState(fold, tracker.TRACKS, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(spark: SparkSession, blobs: DataFrame, batches: int = 4, frame_ms: int = 1000, settings: tracker.Settings = tracker.CONFIGURATIONS["multi_model"]) -> DataFrame:
    """tracker.TRACKS rows of a table of blobs, written in ``batches`` of frames and fed to the live tracker one after another.

    The query is started anew for each batch on one checkpoint, in a new folder under the session's checkpoint folder. A
    last batch has one box of no stream, of the frame after the next, which ends the frames that wait.
    """
    session.prepare(spark)
    home = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/live-{uuid.uuid4().hex}"
    first, last = blobs.agg(F.min("frame"), F.max("frame")).first()
    if last is None:
        return spark.createDataFrame([], tracker.TRACKS)
    each = -(-(last - first + 1) // batches)
    parts = [blobs.filter(F.col("frame").between(first + k * each, first + (k + 1) * each - 1)) for k in range(batches)]
    parts.append(spark.createDataFrame([(None, last + 3, 0, "end", 0, 0, 0, 0)], BOXES))
    for part in parts:
        part.select(*(c.split()[0] for c in BOXES.split(", "))).write.mode("append").parquet(f"{home}/boxes")
        rows = live_tracks(spark.readStream.schema(BOXES).parquet(f"{home}/boxes"), "1 second", frame_ms, settings)
        rows.writeStream.format("parquet").option("path", f"{home}/tracks").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tracker.TRACKS).parquet(f"{home}/tracks")
