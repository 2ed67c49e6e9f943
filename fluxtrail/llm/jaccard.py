"""Exact similarity join of word-shingle sets by adaptive multi-match prefixes, and its classes.

Tokens (hashed shingles) have one global order, rare first by a fixed-size count sketch of the whole corpus, ties by
hash. Sets with overlap of at least a share at least l tokens among the first n - a + l of each; l is chosen per set by
estimated cost, up to the least overlap a link needs: more tokens are indexed, but candidates must share l of them. Equal texts are one node. Prefix tokens
are shuffled once; only tokens with two nodes go on. Links to a centre per token come first and join most of a group of
near copies; then only pairs of different components that share a token are made, so every link between components is
found without making all pairs within a group. Pairs whose token parities differ in more places than the threshold lets
two sets differ are left out as the pairs are made; that drops no link. Every link is checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, durable, picked, row_of, small_batches

SKETCH_BITS, BLOCK_BITS = 20, 14
LONGEST = 12
VERIFY_COST = 20.0
#: A text with more partners than this goes to several tasks, each with a share of them.
PARTNERS = 256
#: Parities of the tokens in 64 * WORDS buckets. Two sets differ in at least as many tokens as their parities do.
WORDS = 4
PARITY = [f"s{k}" for k in range(WORDS)]
PREFIXES = "rid long, doc_id long, h long, high long, low long, n int, ell int, common double, " + "".join(f"{s} long, " for s in PARITY) + "prefix array<long>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence where it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = each[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def parity(own: np.ndarray) -> list[int]:
    """One bit per bucket of tokens, set where it holds an odd number of them, as 64-bit words."""
    odd = np.bincount((own & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def sketch_of(docs: DataFrame, width: int) -> np.ndarray:
    """How many sets hold a token of each hash bucket, over all rows: a fixed 2 ** SKETCH_BITS counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = np.zeros(1 << SKETCH_BITS, np.int64), []
        for batch in batches:
            held += [(shingles(words_of(t), width) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) for t in batch["text"]]
            if sum(map(len, held)) > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        parts = total.reshape(-1, 1 << BLOCK_BITS)
        if total.any():
            yield pd.DataFrame({"block": range(len(parts)), "counts": [p.tobytes() for p in parts]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in parts["counts"])
        return pd.DataFrame({"block": parts["block"][:1], "counts": [total.tobytes()]})

    shape = "block int, counts binary"
    parts = docs.select("text").mapInPandas(count, shape)
    for fan in (64, 1):  # by two steps, so that no task adds the parts of all tasks
        keyed = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(fan)))
        parts = keyed.groupBy("block", "part").applyInPandas(lambda p: add(p), shape)
    out = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, 1 << BLOCK_BITS)
    for row in parts.collect():  # one row per block of the sketch
        out[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def prefix_length(n, least: int, ell):
    """Tokens of a set of n that must be indexed for ``ell`` matches with any set of a size that can reach the threshold."""
    return n - -(-n * least // 100) + ell


def prefixes(docs: DataFrame, sketch: np.ndarray, width: int, least: int) -> DataFrame:
    """Per row of docs(doc_id, text, h): a number of its own, a 128-bit digest of its words, the size of its set, l, its mean
    sketch count, its parities, and its prefix in the global order."""
    mean = max(1.0, sketch.sum() / len(sketch))
    noise = mean + 4 * mean**0.5
    slim = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = slim.value
        rid = (TaskContext.get().partitionId() << 33) - 1
        for batch in batches:
            rows = []
            for doc, h, text in zip(batch["doc_id"], batch["h"], batch["text"], strict=True):
                rid += 1
                words = words_of(text)
                own = shingles(words, width)
                digest = xxhash.xxh3_128_digest(b" ".join(words))
                high, low = np.frombuffer(digest, np.int64).tolist()
                n = len(own)
                seen = counts[own >> np.uint64(64 - SKETCH_BITS)]
                order = np.lexsort((own, seen))
                most = min(n, prefix_length(n, least, LONGEST))
                heavy = np.cumsum(np.maximum(0, seen[order[:most]] - noise))
                ell = 1
                if n and heavy[-1] > 0:
                    ends = np.array([min(n, prefix_length(n, least, k)) for k in range(1, LONGEST + 1)])
                    ell = 1 + int(np.argmin(heavy[ends - 1] * (1 + VERIFY_COST / np.arange(1, LONGEST + 1))))
                ell = max(1, min(ell, -(-n * least // 100)))  # no link needs an overlap of fewer tokens
                rows.append((rid, doc, h, high, low, n, ell, float(seen.mean()) if n else 0.0, *parity(own), own[order[: min(n, prefix_length(n, least, ell))]].view(np.int64)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PREFIXES.split(", ")]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, PREFIXES)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of edges(a, b), by alternating large and small stars until nothing changes."""
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m"))
        edges = durable(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with h, a hash of both, by which a row's text is found again."""
    doc = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc, "text", F.xxhash64(doc, F.col("text")).alias("h"))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; docs as of ``keyed``, nodes(node, doc_id, h) says whose text a node has.

    Each text goes to the tasks of its pairs: b's with the pair, a's once to each task that its partners are dealt to.
    """
    many = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / PARTNERS + 1).cast("long").alias("tasks"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).alias("salt"))
    route = salted.select("a", "salt").distinct().select(F.col("a").alias("node"), "a", "salt", F.lit(None).cast("long").alias("b"))
    route = durable(route.union(salted.select(F.col("b").alias("node"), "a", "salt", "b")).join(nodes, "node").select("a", "salt", "b", F.col("doc_id").alias("doc"), F.col("h").alias("key")))
    rows = docs.join(picked(route), (F.col("h") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("a", "salt", "b", "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for batch in batches:
            found = []
            for a, b, text in zip(batch["a"], batch["b"], batch["text"], strict=True):
                this = shingles(words_of(text), width)
                if pd.isna(b):
                    own = this
                    continue
                both = len(np.intersect1d(own, this, assume_unique=True))
                if 100 * both >= least * (len(own) + len(this) - both):
                    found.append((a, int(b)))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return durable(rows.mapInPandas(check, "a long, b long").distinct())


def starred(shared: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b), each once: a node and the centre of a token that it holds, that centre being the node with the most common tokens."""
    centre = shared.groupBy("token").agg(F.max(F.struct("common", "node", "n")).alias("c"))
    near = (F.col("n") * 100 >= F.col("c.n") * least) & (F.col("c.n") * 100 >= F.col("n") * least)
    stars = shared.join(centre, "token").filter(near & (F.col("node") != F.col("c.node"))).select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    return durable(stars.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")))


def between(shared: DataFrame, joined: DataFrame, facts: DataFrame, stars: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of different components of ``joined`` that share as many prefix tokens as both ask for, without those of ``stars``."""
    token = W.partitionBy("token")
    marked = shared.select("token", "node", "pos").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    marked = marked.withColumns({"lo": F.min("component").over(token), "hi": F.max("component").over(token)}).filter("lo <> hi").drop("lo", "hi")
    marked = durable(marked.join(facts, "node"))
    x, y = (marked.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "ell", "pos", "component", *PARITY))) for s in "xy")
    overlap = F.expr(f"cast(({least}L * (n_x + n_y) + {99 + least}L) div {100 + least}L as int)")
    ell = F.least("ell_x", "ell_y", overlap)
    within = (F.col("pos_x") < F.col("n_x") - overlap + ell) & (F.col("pos_y") < F.col("n_y") - overlap + ell)
    possible = F.least("pos_x", "pos_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= overlap
    differ = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in PARITY), F.lit(0))
    alike = differ <= F.col("n_x") + F.col("n_y") - 2 * overlap
    pairs = x.join(y, "token").filter((F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & within & possible & alike)
    bound = F.col("matches") + F.least(F.col("n_x") - 1 - F.col("last_x"), F.col("n_y") - 1 - F.col("last_y"))
    pairs = pairs.groupBy("node_x", "node_y", "n_x", "n_y", "ell_x", "ell_y").agg(F.count(F.lit(1)).alias("matches"), F.max("pos_x").alias("last_x"), F.max("pos_y").alias("last_y"))
    pairs = pairs.filter((F.col("matches") >= ell) & (bound >= overlap)).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return durable(pairs.join(tried, ["a", "b"], "left_anti"))


def grouped(docs: DataFrame, width: int, least: int, by_id: bool) -> DataFrame:
    """rid, doc_id, h, n, component of each row of docs as of ``keyed``; component, of rows with words: the least rid of the
    class. ``by_id`` links rows of one doc_id, too."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = scratch.write(prefixes(docs, sketch_of(docs, width), width, least), "prefixes")
    equal = rows.filter("n > 0").groupBy("high", "low").agg(F.min("rid").alias("node"))
    slim = scratch.write(rows.select("rid", "doc_id", "h", "high", "low", "n").join(equal, ["high", "low"], "left").drop("high", "low"), "rows")
    nodes = slim.filter("rid = node").select("node", "doc_id", "h")
    copies = durable(slim.filter("n = 0 or rid <> node").select("rid"))
    whole = rows.join(picked(copies), "rid", "left_anti").withColumnRenamed("rid", "node")
    token = W.partitionBy("token")
    index = whole.select("node", F.posexplode("prefix").alias("pos", "token"))
    index = index.withColumns({"lo": F.min("node").over(token), "hi": F.max("node").over(token)}).filter("lo <> hi").drop("lo", "hi")
    facts = scratch.write(whole.select("node", "n", "ell", "common", *PARITY), "facts")
    shared = scratch.write(index.join(facts.select("node", "n", "common"), "node"), "shared")
    del rows, index, whole
    scratch.drop("prefixes")

    stars = starred(shared, least)
    links = verified(stars, docs, nodes, width, least)
    more = verified(between(shared, components(links), facts.drop("common"), stars, least), docs, nodes, width, least)
    named = slim.filter(F.lit(by_id)).filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z")
    same = slim.join(named.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    final = components(links.union(more).union(same))
    out = durable(slim.join(final, "node", "left").select("rid", "doc_id", "h", "n", F.coalesce("component", "node").alias("component")))
    del shared, facts, slim, nodes, links, more, named, same, final, stars, copies
    scratch.drop("facts", "shared", "rows")
    return out


def classes(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text).

    Rows link when their shingle sets have a Jaccard similarity of ``least`` percent or more; a component is named by its
    smallest doc_id. A null or empty text and one without words has no shingles and its own doc_id as component. Rows
    that share a doc_id are one document and so in one component, whatever their texts; a row without doc_id links like
    any other, and a component without any id is null. An empty table gives no rows. Other columns are not read.
    """
    rows = grouped(keyed(docs), width, least, by_id=True)
    least_id = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least_id, "component", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int = 5, least: int = 80) -> DataFrame:
    """One row of each class of docs, with all its columns, and every row without words.

    The row with the smallest doc_id stays, one with an id before one without; of rows equal in doc_id and text one
    stays. Different texts under one doc_id are in one class only if they are similar. Null and empty texts are in no class. Columns of any name stay as they are; an empty table gives no rows.
    """
    rows = grouped(keyed(docs), width, least, by_id=False)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    stays = rows.filter("component is not null").groupBy("component").agg(first.alias("first")).select("component", F.col("first.rid").alias("first"))
    key = rows.join(stays, "component").groupBy("doc_id", "h").agg(F.max(F.col("rid") == F.col("first")).alias("stays"), F.count(F.lit(1)).alias("times"))
    key = durable(key.filter("not stays or times > 1").select(F.col("doc_id").alias("doc"), F.col("h").alias("key"), "stays"))
    id_of = F.col("`doc_id`").cast("long")
    own = docs.select(row_of(docs), id_of.alias("doc_id"), F.xxhash64(id_of, F.col("`text`")).alias("h"))
    match = (F.col("h") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("doc"))
    kept = own.join(picked(key), match, "left_anti").select("row.*")
    again = key.filter("stays")
    if not again.isEmpty():
        again = own.join(picked(again), match, "left_semi").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.union(again.select("row.*"))
    return kept
