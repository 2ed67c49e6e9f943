"""Change feed of leaderboards: who entered, left or moved on a nation's board after each day of arrival.

A stateful streaming query buffers the accepted deltas of each nation by day of arrival. Its event time is the day of
shipping, with Spark's watermark as the rule for late lines; timers are set on days of arrival, fire in ascending order,
and fold the day's deltas into revenues. As a nation may hold a third of all lines, its state is split in parts by item:
a part's timers emit what changed on the part's own board, and a second stateful query keeps a nation's few candidates
of all parts and emits the differences of its board. An end sentinel, with an event time after every day, flushes the last days.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import packed, shared_dir, unpacked, written

#: Event times count a second a day from the first year: Spark's watermark starts at 1970 and would take days before it as
#: late, and pandas has no times after 2262.
DAY_MS, FIRST_DAY = 1000, -719_162
#: A day after all others, that of the end sentinel: the last of year 9999.
END_DAY = 2_932_896
CUT = "nation int, item long, day long, ship long, cents long, batch int"
UPDATES = "nation int, day long, item long, cents long, held int"
CHANGES = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


def millis(day: int) -> int:
    return (day - FIRST_DAY) * DAY_MS


def event_time(day: Column) -> Column:
    """The event time of a day, a millisecond past the time at which its timer is due."""
    return F.timestamp_millis((day - FIRST_DAY) * DAY_MS + 1)


def lines(sale_lines: DataFrame, items: DataFrame, vendors: DataFrame, batches: int = 10, first_day: int = 19_723, days: int = 180) -> DataFrame:
    """CUT rows, one per line: nation of its vendor, item, days of arrival and shipping, cents, and batch of arrival.

    A line whose vendor has no nation, or whose item is not in items, has no nation and item: it is ignored but counts for
    lateness. Cents are 0 where neither amount nor quantity and price are known, and for amounts that are no number. Of
    items or vendors listed twice, the largest price or nation counts. Arrivals before ``first_day`` are in batch 1.
    """
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(text)
    ship = F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("long"), 19_723 + h % 150)
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    rows = sale_lines.select(F.col("item_id").alias("item"), F.col("vendor_id").alias("vendor"), h.alias("h"), ship.alias("ship"), (sign * F.floor(100 * F.col("amount") + 0.5)).alias("own"), F.when(F.col("amount").isNull(), sign * F.col("quantity")).alias("quantity"))
    rows = rows.withColumn("day", F.col("ship") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).drop("h")
    prices = items.groupBy(F.col("item_id").alias("item")).agg(F.floor(100 * F.max("price") + 0.5).alias("each"), F.lit(True).alias("known"))
    nations = vendors.groupBy(F.col("vendor_id").alias("vendor")).agg(F.max("nation_id").cast("int").alias("nation"))
    # vendors and items grow with the lines; written, they are plain sides of joins, in which Spark splits the skewed keys of the lines
    rows = rows.join(written(nations, "nations"), "vendor", "left").join(written(prices, "prices").hint("merge"), "item", "left")
    good = F.col("nation").isNotNull() & F.col("known")
    cents = F.coalesce("own", F.col("quantity") * F.col("each"), F.lit(0))
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / days))).cast("int")
    return rows.select(F.when(good, F.col("nation")).alias("nation"), F.when(good, F.col("item")).alias("item"), "day", "ship", cents.alias("cents"), batch.alias("batch"))


def summed(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A task's deltas added up by nation, item and days before they are shuffled, ``most`` rows at a time."""
    keys = ["nation", "item", "day", "ship"]

    def added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("cents", "sum")])
        return sums.select([*keys, "cents_sum"]).rename_columns([*keys, "cents"]).combine_chunks().to_batches(max_chunksize=10_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield from added(held)
            held, n = [], 0
    if n:
        yield from added(held)


def stored(*columns: np.ndarray) -> bytes:
    """Columns of one length, the first in ascending order, as a small value of the state."""
    steps = [np.diff(columns[0], prepend=0), *columns[1:]]
    raws = [packed(np.where(c < 0, -2 * c - 1, 2 * c)) for c in steps]
    head = np.array([len(columns[0]), *map(len, raws)], "<i8").tobytes()
    return zlib.compress(head + b"".join(raws), 1)


def restored(raw: bytes | None, width: int) -> list[np.ndarray]:
    if not raw:
        return [np.empty(0, np.int64) for _ in range(width)]
    whole = zlib.decompress(raw)
    n, *lengths = np.frombuffer(whole, "<i8", width + 1).tolist()
    at, out = 8 * (width + 1), []
    for length in lengths:
        c = unpacked(whole[at : at + length], n)
        out.append((c >> 1) ^ -(c & 1))
        at += length
    return [out[0].cumsum(), *out[1:]]


def leading(items: np.ndarray, cents: np.ndarray, size: int) -> np.ndarray:
    """Places of the highest positive revenues, in order; ties to the smaller item."""
    at = np.flatnonzero(cents > 0)
    if len(at) > size:
        at = at[cents[at] >= np.partition(cents[at], -size)[-size]]
    return at[np.lexsort((items[at], -cents[at]))][:size]


def part_days(held: list[np.ndarray], due: list[np.ndarray], size: int) -> tuple[list[np.ndarray], list[tuple]]:
    """Revenues(item, cents) of a part after the due deltas(day, item, cents), and per day what changed on its own board."""
    days, item, cents = due
    items = np.union1d(held[0], item)
    totals = np.zeros(len(items), np.int64)
    totals[np.searchsorted(items, held[0])] = held[1]
    at, out = np.searchsorted(items, item), []
    board = leading(items, totals, size)
    for day in np.unique(days):
        now = days == day
        before, old = totals[board], board
        np.add.at(totals, at[now], cents[now])
        board = leading(items, totals, size)
        was = dict(zip(old.tolist(), before.tolist(), strict=True))
        out += [(day, items[i], totals[i], 1) for i in board.tolist() if was.pop(i, None) != totals[i]]
        out += [(day, items[i], totals[i], 0) for i in was if i not in board]
    return [items, totals], out


def board_days(held: list[np.ndarray], due: list[np.ndarray], size: int) -> tuple[list[np.ndarray], list[tuple]]:
    """Candidates(item, cents) of a nation after the due updates(day, item, cents, held), and per day what changed on its board."""
    known = dict(zip(*(c.tolist() for c in held), strict=True))
    ranked = lambda: [i for i, c in sorted(known.items(), key=lambda x: (-x[1], x[0]))[:size]]
    board, out = ranked(), []
    for day in np.unique(due[0]):
        rows = [c[due[0] == day].tolist() for c in due[1:]]
        old = {item: k for k, item in enumerate(board, 1)}
        latest = known | dict(zip(rows[0], rows[1], strict=True))
        for item, cents, stays in zip(*rows, strict=True):
            known[item] = cents
            if not stays:
                del known[item]
        board = ranked()
        new = {item: k for k, item in enumerate(board, 1)}
        for item in sorted(old.keys() | new.keys()):
            a, b = old.get(item), new.get(item)
            if a != b:
                out.append((day, item, "enter" if a is None else "exit" if b is None else "move", a, b, latest[item]))
    items = np.array(sorted(known), np.int64)
    return [items, np.array([known[i] for i in items.tolist()], np.int64)], out


def by_timers(rows: DataFrame, keys: list[str], values: list[str], schema: str, fold: Callable) -> DataFrame:
    """Rows of ``fold`` over the buffered days of each key, ascending, once the watermark has passed a day's time."""
    names = [f.split()[0] for f in schema.split(", ")]
    whole = [f.split()[0] for f in schema.split(", ") if f.split()[1] in ("int", "long")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):  # lines that count for lateness alone
            return
        held, waiting = state.get if state.exists else (None, None)
        waiting = restored(waiting, len(values))
        fresh = [waiting, *([f[v].to_numpy(np.int64) for v in values] for f in frames)]
        columns = [np.concatenate(c) for c in zip(*fresh, strict=True)]
        columns = [c[np.argsort(columns[0], kind="stable")] for c in columns]
        n = int(np.searchsorted(columns[0], state.getCurrentWatermarkMs() // DAY_MS + FIRST_DAY, "right"))
        out: list[tuple] = []
        if n:
            kept, out = fold(restored(held, 2), [c[:n] for c in columns])
            held = stored(*kept)
        state.update((held or b"", stored(*(c[n:] for c in columns))))
        if n < len(columns[0]):
            state.setTimeoutTimestamp(max(millis(int(columns[0][n])), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=names).astype({c: "Int64" for c in whole})

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "held binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


class Feed:
    """The two streaming queries on their checkpoints, in a new folder under ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, parts: int, size: int = 10, grace_days: int = 3) -> None:
        self.home = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
        self.spark = spark.newSession()
        self.parts, self.size, self.grace = parts, size, grace_days
        # one stateful operator a query: late lines are those at or before this start's watermark, not the start's before
        self.spark.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")
        # every start writes a small file for each partition of the state: no second one beside it, and in a mounted folder
        # no shell for its permissions, as Spark's first choice of writer there needs
        self.spark.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")
        if self.home.startswith("file:"):
            self.spark.conf.set("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")

    def source(self, name: str, schema: str) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(f"{self.home}/{name}")

    def started(self, rows: DataFrame, name: str, last: bool) -> None:
        """Run ``rows`` anew over what has arrived; days that are due wait for the next start, but for the last, which ends with them."""
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(last).lower())
        rows.writeStream.format("parquet").option("path", f"{self.home}/{name}").option("checkpointLocation", f"{self.home}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()

    def advance(self, last: bool = False, boards: bool = True) -> None:
        """One start of each query; without ``boards`` the parts' changes wait for a later start of the second one."""
        size, parts = self.size, self.parts
        rows = self.source("lines", CUT).select("nation", "item", "day", "ship", "cents").mapInArrow(summed, "nation int, item long, day long, ship long, cents long")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).withColumn("at", event_time(F.col("ship")))
        rows = rows.withWatermark("at", f"{self.grace} seconds 2 milliseconds")  # late: at or before the watermark
        updates = by_timers(rows, ["nation", "part"], ["day", "item", "cents"], UPDATES, lambda held, due: part_days(held, due, size))
        self.started(updates, "updates", last)
        if not boards:
            return
        rows = self.source("updates", UPDATES).withColumn("at", event_time(F.col("day"))).withWatermark("at", "0 seconds")
        changes = by_timers(rows, ["nation"], ["day", "item", "cents", "held"], CHANGES, lambda held, due: board_days(held, due, size))
        self.started(changes, "changes", last)


def change_feed(sale_lines: DataFrame, items: DataFrame, vendors: DataFrame, batches: int = 10, size: int = 10, grace_days: int = 3, first_day: int = 19_723, days: int = 180, part_lines: int = 2_000_000) -> DataFrame:
    """nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue: changes of the nations' boards of ``size``.

    The lines are cut into ``batches`` by arrival, written and fed one after another; each feed starts the queries anew on
    the same checkpoints. A line more than ``grace_days`` older than the latest shipping day of all earlier batches is
    dropped. Repeated lines count each; for nulls see ``lines``. A day on which a board stays the same, and an empty
    table, give no rows; other columns are not read. A nation has a part for about ``part_lines`` lines, eight at least.
    """
    spark = sale_lines.sparkSession
    parts = max(8, -(-sale_lines.count() // part_lines))
    feed = Feed(spark, parts, size, grace_days)
    cut = lines(sale_lines, items, vendors, batches, first_day, days)
    cut.write.option("compression", "zstd").partitionBy("batch").parquet(f"{feed.home}/cut")
    end = spark.createDataFrame([(None, None, END_DAY, END_DAY, 0)], CUT.rpartition(",")[0])
    end.coalesce(1).write.mode("append").parquet(f"{feed.home}/cut/batch={batches}")
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{feed.home}/{name}")
    folder = at("cut").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for name in ("lines", "updates"):
        folder.mkdirs(at(name))
    for k in range(1, batches + 1):
        if folder.exists(at(f"cut/batch={k}")):  # no line may have arrived
            folder.rename(at(f"cut/batch={k}"), at(f"lines/batch={k}"))
        feed.advance(last=k == batches, boards=k == batches)  # nobody reads the changes before the last
    found = spark.read.schema(CHANGES).parquet(f"{feed.home}/changes")
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("arrival_day") - first_day) * batches / days))).cast("int")
    return found.select("nation_id", "arrival_day", "item_id", batch.alias("batch"), "change", "old_rank", "new_rank", "revenue")
