"""Shards of indivisible groups by best-fit-decreasing bin packing, in two levels.

Groups are rows of equal text. The few groups that hold more than a small share of all bytes or rows (their number has a
proven bound) are packed one by one; all others are first packed by their tasks, best fit decreasing, into bundles of that
share. Bundles and large groups, again bounded in number, are then packed into shards the same way: largest first, each
into the bin with the tightest remaining capacity that holds it, found in a balanced tree of the bins' remaining capacities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, durable, parts_for, text_of

ROWS = "doc_id long, size long, text_crc32 long, shard int, slot long"


class Bins:
    """An AA tree of (remaining capacity, bin): insert, and take out the least entry that is not below a size."""

    def __init__(self) -> None:
        self.root: list | None = None  # a node: [entry, level, left, right]

    def insert(self, entry: tuple[int, int]) -> None:
        self.root = self._insert(self.root, entry)

    def take(self, size: int) -> tuple[int, int] | None:
        """The tightest entry with a remaining capacity of ``size`` or more, removed; None where there is none."""
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                node, found = node[2], node[0]
            else:
                node = node[3]
        if found:
            self.root = self._delete(self.root, found)
        return found

    def _skew(self, t: list) -> list:
        left = t[2]
        if left and left[1] == t[1]:
            t[2], left[3] = left[3], t
            return left
        return t

    def _split(self, t: list) -> list:
        right = t[3]
        if right and right[3] and right[3][1] == t[1]:
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def _insert(self, t: list | None, entry: tuple[int, int]) -> list:
        if t is None:
            return [entry, 1, None, None]
        side = 2 if entry < t[0] else 3
        t[side] = self._insert(t[side], entry)
        return self._split(self._skew(t))

    def _delete(self, t: list | None, entry: tuple[int, int]) -> list | None:
        if t is None:
            return None
        if entry < t[0]:
            t[2] = self._delete(t[2], entry)
        elif entry > t[0]:
            t[3] = self._delete(t[3], entry)
        elif t[2] is None and t[3] is None:
            return None
        else:
            side = 3 if t[2] is None else 2
            near = t[side]
            while near[5 - side]:
                near = near[5 - side]
            t[0] = near[0]
            t[side] = self._delete(t[side], near[0])
        level = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if level < t[1]:
            t[1] = level
            if t[3] and t[3][1] > level:
                t[3][1] = level
        t = self._skew(t)
        if t[3]:
            t[3] = self._skew(t[3])
            if t[3][3]:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3]:
            t[3] = self._split(t[3])
        return t


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each of the descending ``sizes``; one above the capacity has a bin alone. None where over ``most`` bins are needed."""
    tree, out, bins = Bins(), [], 0
    for size in sizes:
        if found := tree.take(size):
            room, at = found
        else:
            if bins == most:
                return None
            room, at, bins = capacity, bins, bins + 1
        out.append(at)
        if room > size:
            tree.insert((room - size, at))
    return out


def evened(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of the descending ``sizes``, with the least capacity at which best fit needs no more than ``shards``.

    Sizes of a fair share or more take a shard alone, and the rest is evened over the shards left.
    """
    alone, left = 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) >= left:
        left -= sizes[alone]
        alone += 1
    rest, open_ = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(rest[0], -(-left // open_)) - 1  # too small, or just below the least possible
    high, best = low + 1, None
    while best is None:  # best fit may need a little more than the fair share
        best = best_fit(rest, high, open_)
        if best is None:
            low, high = high, high + max(1, 2 * (high - low))
    while high - low > 1:
        middle = (low + high) // 2
        if fitting := best_fit(rest, middle, open_):
            high, best = middle, fitting
        else:
            low = middle
    return [*range(alone), *(alone + b for b in best)]


def bundles(groups: DataFrame, capacity: int, parts: int) -> DataFrame:
    """key, bundle, bytes of groups(key, bytes): each task's groups packed into bundles of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        held = pa.Table.from_batches([*batches])
        if held.num_rows:
            at = pa.array([task | b for b in best_fit(held["bytes"].to_pylist(), capacity)], pa.int64())
            yield from held.append_column("bundle", at).combine_chunks().to_batches(max_chunksize=10_000)

    rows = groups.select("key", "bytes").repartition(parts, "key").sortWithinPartitions(F.desc("bytes"), "key")
    return rows.mapInArrow(run, "key binary, bytes long, bundle long")


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, most: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of docs(doc_id, text): rows of equal text in one shard, slots gapless from 0.

    With ``shards`` their sizes are made near equal; with ``capacity`` (bytes; shards=None) few shards hold at most that,
    but for a group above it, which has one alone. A size is the text's UTF-8 bytes plus 1; null is an empty text. Rows
    without an id, and repeated ones, are rows like any other; an empty table gives no rows; other columns are not read.
    Groups above 1/``most`` of all bytes or rows, 2 * ``most`` at most, and the bundles of the others, 2 * ``most`` and one
    a task at most, are ordered on the driver; sizes of shards differ by about a bundle.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("name either shards or capacity")
    spark = docs.sparkSession
    tables = Scratch(spark)
    text = text_of()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    slim = tables.write(slim, "sized")
    groups = tables.write(slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    count, total, rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = max(1, min(total // most, capacity or total))
    large = (F.col("bytes") > share) | (F.col("n") > rows // most)
    big = [(bytes(k), b) for k, b in groups.filter(large).select("key", "bytes").collect()]  # 2 * most rows at most, by their shares
    small = tables.write(bundles(groups.filter(~large), share, parts_for(spark, count)), "bundles")
    packs = small.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()  # one a bundle
    items = sorted([(b, 0, k) for k, b in big] + [(r["bytes"], 1, r["bundle"]) for r in packs], key=lambda x: (-x[0], x[1], x[2]))
    sizes = [s for s, _, _ in items]
    of = (evened(sizes, shards) if shards else best_fit(sizes, capacity)) if items else []
    keyed = spark.createDataFrame([(k, s) for (_, kind, k), s in zip(items, of, strict=True) if kind == 0], "key binary, shard int")
    bundled = spark.createDataFrame([(k, s) for (_, kind, k), s in zip(items, of, strict=True) if kind == 1], "bundle long, shard int")
    slim = slim.join(F.broadcast(keyed), "key", "left")
    light = small.join(F.broadcast(bundled), "bundle").select("key", F.col("shard").alias("own"))
    rest = slim.filter("shard IS NULL").join(light, "key")
    out = ["doc_id", "size", "text_crc32"]
    placed = durable(slim.filter("shard IS NOT NULL").select(*out, "shard").union(rest.select(*out, F.col("own").alias("shard"))))
    tables.drop("sized", "groups", "bundles")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """placed, which is checkpointed, with ``slot``: each shard's rows numbered from 0 in the order of partitions and rows.

    The rows stay where they are: a partition counts its own, and starts where those before it end.
    """
    counts = placed.groupBy(F.spark_partition_id().alias("part"), "shard").count()
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for batch in batches:
            batch["at"] = batch.groupby("shard").cumcount() + batch["shard"].map(lambda s: seen.get(s, 0))
            for s, n in batch["shard"].value_counts().items():
                seen[s] = seen.get(s, 0) + n
            yield batch.astype({"doc_id": "Int64"})

    local = placed.withColumn("part", F.spark_partition_id()).mapInPandas(run, "doc_id long, size long, text_crc32 long, shard int, part int, at long")
    return local.join(starts, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))
