"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a stream: its documents in hashed order, up to ``repeats`` times over, cut into blocks of B words. The mix
is a schedule of N slots. Slot i maps to the point (i * g mod N) / N, with g the integer prime to N that is nearest to
N / golden ratio: the golden-ratio sequence on a lattice, so every prefix of the schedule is spread evenly and all N
slots hit each of the N points once. The point falls into a source's interval of the cumulative weights; a slot's rank
within its source names the block that it takes. Sources thus get their quotas of slots exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, row_of, text_of

#: More slots than this make blocks longer: i * g must fit 63 bits.
MOST_SLOTS = 1 << 31
GOLDEN = (math.sqrt(5) - 1) / 2


def targets(sizes: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """source, source_size, rank, target of sizes(source, source_size), a row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share the total of all sizes; a target stops at
    ``repeats`` times its source's size and the excess is shared anew by weight. Seen from the least cap per unit of
    weight: the first k sources are at their caps and the others get one level times their weight, for the first k
    where no further source is above its cap.
    """
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    rows = sizes.withColumn("rank", rank.cast("long"))
    rows = rows.withColumn("weight", F.get(kinds, (F.col("rank") % len(weights)).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "rank")
    before, everyone = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    total, weight = F.sum("source_size").over(everyone), F.sum("weight").over(everyone)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (total - capped) / (weight - heavy))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everyone)["level"]
    share = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return rows.withColumn("target", F.coalesce(share, F.lit(0.0))).select("source", "source_size", "rank", "target")


def step_of(slots: int) -> int:
    """The integer prime to ``slots`` nearest to slots / golden ratio."""
    near = max(1, round(slots * GOLDEN))
    return next(g for d in range(slots + 2) for g in (near - d, near + d) if 0 < g and math.gcd(g, slots) == 1)


def counted(docs: DataFrame, key: Column) -> DataFrame:
    """doc_id, source, size and the hashed place of each row; written once."""
    return durable(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), key.alias("place")))


def schedule(quotas: DataFrame, slots: int, step: int) -> DataFrame:
    """slot, rank (of the source), block: each slot's source and its number within the source.

    quotas: rank, first (slots of the sources before), quota. Points and intervals meet in cells of the unit interval,
    so the join has an equal key; blocks are numbered by counts per run of slots and within the run.
    """
    sources = max(1, quotas.count())
    cell = max(1, slots // (4 * sources))
    held = quotas.filter("quota > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"first div {cell}"), F.expr(f"(first + quota - 1) div {cell}"))))
    run = max(64, math.isqrt(slots))
    spark = quotas.sparkSession
    rows = spark.range(0, slots, 1).select(F.col("id").alias("slot"), F.expr(f"(id * {step}L) % {slots}L").alias("point"))
    rows = rows.withColumn("cell", F.expr(f"point div {cell}")).join(held, "cell")
    rows = rows.filter("point >= first and point < first + quota").select("slot", "rank", F.expr(f"slot div {run}").alias("run"))
    rows = durable(rows)
    starts = rows.groupBy("rank", "run").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("rank", "run").orderBy("slot")) - 1
    return rows.withColumn("within", within).join(starts, ["rank", "run"]).select("slot", "rank", (F.col("start") + F.col("within")).alias("block"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: int = 3, block_words: int = 256, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of docs(doc_id, text, source) with what the mix takes of each; and the pieces in the order of the schedule.

    First: row (a key of the input row), doc_id, place (a hash of doc_id and text), size, source, source_size, target, taken,
    and of the schedule slots (the first slot of each time that the row is taken, in order) and n_slots. Second: slot,
    row, doc_id, epoch, start, length: words [start, start + length) of the document. A source's taken words are its target, rounded; no document
    is taken more than ``repeats`` times. Null and empty texts have size 0 and are never taken; a null source is a
    source; repeated rows are taken each on its own; an empty table gives no rows. Other columns are not read. The
    sources, one row each, are ordered in one task; documents, slots and blocks never are.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), text_of())
    rows = counted(docs.select("doc_id", "source", "text"), key)
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.isqrt(n))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("place", 20), F.lit(buckets)))
    sums = durable(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    goal = durable(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, repeats))
    goal = goal.withColumn("quota_words", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * repeats))
    size = max(block_words, -(-words // MOST_SLOTS))
    goal = goal.withColumn("quota", F.expr(f"cast((quota_words + {size - 1}L) div {size}L as long)"))
    goal = goal.withColumn("first", F.coalesce(F.sum("quota").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goal = durable(goal)
    slots = goal.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]

    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offsets = offsets.join(goal.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    offsets = offsets.select(F.col("source").alias("name"), F.col("bucket").alias("of"), "offset", "source_size", "target", "rank", "quota_words")
    own = W.partitionBy("source", "bucket").orderBy("place", "doc_id")
    rows = rows.withColumns({"at": F.coalesce(F.sum("size").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "nth": F.row_number().over(own)})
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("name")) & (F.col("bucket") == F.col("of")))
    rows = rows.withColumn("at", F.col("at") + F.col("offset")).withColumn("row", F.struct("rank", "bucket", "nth"))
    rows = durable(rows.select("row", "doc_id", "place", "size", "source", "source_size", "target", "rank", "quota_words", "at"))

    runs = rows.filter("size > 0 and quota_words > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    runs = runs.withColumn("at", F.col("at") + F.col("epoch") * F.col("source_size")).filter("at < quota_words")
    runs = runs.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota_words")))
    pieces = runs.withColumn("block", F.explode(F.expr(f"sequence(at div {size}L, (end - 1) div {size}L)")))
    begin = F.greatest(F.col("at"), F.col("block") * size)
    length = F.least(F.col("end"), (F.col("block") + 1) * size) - begin
    pieces = pieces.select("rank", "block", "row", "doc_id", "epoch", (begin - F.col("at")).alias("start"), length.alias("length"))
    order = schedule(goal.select("rank", "first", "quota"), slots, step_of(slots)) if slots else docs.sparkSession.createDataFrame([], "slot long, rank long, block long")
    pieces = pieces.join(order, ["rank", "block"]).select("slot", "row", "doc_id", "epoch", "start", "length")
    each = pieces.groupBy("row", "epoch").agg(F.sum("length").alias("taken"), F.min("slot").alias("slot"), F.count(F.lit(1)).alias("n_slots"))
    taken = each.groupBy(F.col("row").alias("key")).agg(  # a row per time, so lists of at most ``repeats``
        F.sum("taken").alias("taken"), F.transform(F.array_sort(F.collect_list(F.struct("epoch", "slot"))), lambda x: x["slot"]).alias("slots"), F.sum("n_slots").alias("n_slots")
    )
    rows = rows.join(taken, F.col("row") == F.col("key"), "left")
    none = F.array().cast("array<long>")
    rows = rows.select(
        "row", "doc_id", "place", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("slots", none).alias("slots"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"),
    )
    return rows, pieces


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in the order of the schedule, with the columns of docs: a row per whole time that a document
    is taken, at the first slot of that time, and one more with its first words where the last time is cut off; n_chars
    is counted again there. Documents not taken go, and with them null and empty texts.

    Rows are matched to the mix by doc_id and a hash of it and the text; of repeated rows, which are equal in these, each
    stands for the mean of what is taken of them, in whole rows first. Columns of any name stay as they are.
    """
    rows, _ = mix(docs, **options)
    taken = rows.groupBy("doc_id", "place").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("taken") > 0, F.col("slots"))).alias("slots")
    )
    taken = taken.filter("taken > 0").withColumnsRenamed({"doc_id": "doc", "place": "at"})
    id_of, text = F.col("`doc_id`"), F.coalesce(F.col("`text`"), F.lit(""))
    key = F.xxhash64(F.lit(options.get("seed", 42)), id_of, text)
    one = docs.select(row_of(docs), id_of.alias("doc_id"), key.alias("place"))
    one = one.withColumn("nth", F.row_number().over(W.partitionBy("place").orderBy("doc_id", F.col("row").getField("source"))))
    one = one.join(taken, (F.col("place") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("doc")))
    share = F.expr("taken div copies") + (F.col("nth") <= F.col("taken") % F.col("copies")).cast("long")
    one = one.withColumn("words", share)
    whole = F.array_repeat(F.lit(None).cast("long"), F.expr("cast(words div size as int)"))
    lengths = F.concat(whole, F.when(F.col("words") % F.col("size") > 0, F.array(F.col("words") % F.col("size"))).otherwise(F.array().cast("array<long>")))
    one = one.select("row", "doc_id", "place", "slots", F.posexplode(lengths).alias("time", "cut"))
    one = one.withColumn("slot", F.coalesce(F.get("slots", F.col("time")), F.array_max("slots"))).orderBy("slot", "place", "time")
    text = F.col("row").getField("text")
    begin = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"(?s)([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), F.col("cut").cast("int")), "")
    one = one.select("row", "cut", F.when(F.col("cut").isNull(), text).otherwise(begin).alias("taken"))
    swap = {"text": F.col("taken").alias("text")}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(F.col("cut").isNull(), F.col("row").getField("n_chars")).otherwise(F.length("taken").cast("long")).alias("n_chars")
    return one.select(*(swap.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))
