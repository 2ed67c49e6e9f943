"""Language-model scores by logistic context mixing over binary decisions.

A token is coded as a path of yes/no decisions: the Huffman path of its class (each frequent word, the end, or one of up to
1,024 classes of the other words by their hash), and for other words their share among their class's counts. Each decision has predictors by hashed context: the node
alone, the node with the last word, the last two, and the one before the last. A predictor's evidence is the counts
of both answers over all training documents. A mixer adds the predictors' logits with weights chosen by how much
evidence the contexts have (the gate); weights learn online, decision block by decision block; an adaptive map then
refines the mixed probability by node depth. Both learn on all training documents, dealt to two folds: each fold learns
on the counts of the other, a task at a time, and the tasks' results are averaged by how much each saw. The model is a distribution over
the same events as the unigram base: the known words, the end, and an unknown word, one for each class of the other words.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, durable, small_batches, written

END = b"\n"  # no word holds white space
#: Words of at least this share of all tokens are sent to every worker (at most 2 ** 18 of them), and coded by paths (2 ** 13).
KNOWN, CODED = 2.0**-18, 2.0**-13
#: Other words are in as many classes as have about this many tokens each on average, a power of two of at most this exponent.
RARE, RARE_BITS = 1024, 10
ORDERS, GATE, BLOCK_BITS, LEAST_BITS, MOST_BITS = 3, 6, 14, 14, 20
CHUNK = 1 << 17
PARTS = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, model double, rare array<long>, times array<int>"
TOKENS = "kind int, doc_id long, held_out boolean, fold int, n_bytes long, hashes binary, words array<binary>, marks array<long>, counts array<long>"


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split(), END]


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10


def hashed(tokens) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def tokenized(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, held_out, fold), split into tokens once: rows of kind 0 have the 64-bit hashes of a text's tokens;
    those of kind 1 have words of training rows with their hashes and counts, summed by task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in TOKENS.split(", ")]
        held: Counter = Counter()

        def counted() -> pd.DataFrame:
            words = list(held)
            parts = [words[i : i + 50_000] for i in range(0, len(words), 50_000)]
            rows = [(1, None, None, None, None, None, p, hashed(p).view(np.int64), [held[w] for w in p]) for p in parts]
            held.clear()
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "fold": "Int32", "n_bytes": "Int64", "held_out": "boolean"})

        for batch in batches:
            rows = []
            for doc, text, out, fold in zip(batch["doc_id"], batch["text"], batch["held_out"], batch["fold"], strict=True):
                raw = (text or "").encode("utf-8", "replace")
                tokens = [*raw.translate(ASCII_LOWER).split(), END]
                rows.append((0, None if pd.isna(doc) else doc, out, fold, len(raw), hashed(tokens).tobytes(), None, None, None))
                if not out:
                    held.update(tokens)
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "fold": "Int32", "n_bytes": "Int64", "held_out": "boolean"})
            if len(held) > 400_000:
                yield counted()
        if held:
            yield counted()

    return docs.select("doc_id", "text", "held_out", "fold").mapInPandas(run, TOKENS)


def counted(tokens: DataFrame) -> DataFrame:
    """word, mark (its hash), c over the training rows."""
    parts = tokens.filter("kind = 1").select(F.explode(F.arrays_zip("words", "marks", "counts")).alias("w"))
    return parts.groupBy(F.col("w.words").alias("word"), F.col("w.marks").alias("mark")).agg(F.sum("w.counts").alias("c"))


class Lookup:
    """Numbers by 64-bit hash, 0 for hashes not held: a table with four places a hash, the next ones where one is taken."""

    def __init__(self, marks: np.ndarray, numbers: np.ndarray) -> None:
        self.bits = max(6, int(np.ceil(np.log2(len(marks) + 1))) + 2)
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        for mark, number in zip(marks.tolist(), numbers.tolist(), strict=True):
            at = mark >> 64 - self.bits
            while self.values[at] and self.keys[at] != mark:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.values[at] = mark, number

    def __getitem__(self, marks: np.ndarray) -> np.ndarray:
        at = (marks >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[at]
        left = np.flatnonzero((self.keys[at] != marks) & (out > 0))
        out[self.keys[at] != marks] = 0
        at = at[left]
        while len(left):
            at = at + 1 & (1 << self.bits) - 1
            found = self.values[at]
            same = self.keys[at] == marks[left]
            out[left[same]] = found[same]
            more = ~same & (found > 0)
            left, at = left[more], at[more]
        return out


@dataclass
class Code:
    """Huffman paths: class k has decisions nodes[begin[k] : begin[k] + size[k]] with answers ``bits``."""

    classes: dict[bytes, int]
    begin: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    depth: np.ndarray
    rare: int = 0

    def placed(self, classes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The classes with those of other words, 0 so far, by their hashes' first ``rare`` bits; the first of these is 0 itself."""
        if not self.rare:
            return classes
        own = buckets(hashes, self.rare)
        return np.where((classes > 0) | (own == 0), classes, len(self.classes) + own)

    def lookup(self) -> Lookup:
        """Classes by the hash of a word."""
        return Lookup(hashed(list(self.classes)), np.array(list(self.classes.values()), np.int64))


def buckets(hashes: np.ndarray, rare: int) -> np.ndarray:
    """The first ``rare`` bits of 64-bit hashes."""
    return (hashes >> np.uint64(64 - rare)).astype(np.int64) if rare else np.zeros(len(hashes), np.int64)


def huffman(words: list[tuple[bytes, int]], other: int, *more: int) -> Code:
    """Class 0 is "other" with count ``other``; words follow by count, then by bytes, then ``more`` classes of others, 2 ** n with class 0."""
    words = sorted(words, key=lambda x: (-x[1], x[0]))
    heap = [(c, k, k) for k, c in enumerate([max(1, other), *(c for _, c in words), *(max(1, c) for c in more)])]
    n = len(heap)
    heapq.heapify(heap)
    parent, side, inner = {}, {}, n
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], side[left], parent[right], side[right] = inner, 0, inner, 1
        heapq.heappush(heap, (a + b, inner, inner))
        inner += 1
    nodes, bits, size, depth = [], [], [], np.zeros(max(1, inner - n), np.int64)
    for k in range(n):
        path = []
        at = k
        while at in parent:
            path.append((parent[at] - n, side[at]))
            at = parent[at]
        path.reverse()
        for d, (node, bit) in enumerate(path):
            nodes.append(node)
            bits.append(bit)
            depth[node] = d
        size.append(len(path))
    size = np.array(size, np.int64)
    return Code({w: k + 1 for k, (w, _) in enumerate(words)}, np.cumsum(size) - size, size, np.array(nodes, np.int64), np.array(bits, np.int8), depth, len(more).bit_length())


def streams(texts, known: Lookup) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of at most CHUNK tokens of each text, given as the bytes of its tokens' hashes: its number, the numbers of its tokens
    (0 where not held), and their hashes with the two before in front (0 at the beginning)."""
    for k, data in enumerate(texts):
        every = np.concatenate([np.zeros(2, np.uint64), np.frombuffer(data, np.uint64)])
        for i in range(2, len(every), CHUNK):
            hashes = every[i - 2 : i + CHUNK]
            yield k, known[hashes[2:]], hashes


def joined(runs) -> Iterator[list]:
    """Lists of runs with about CHUNK tokens together."""
    held, size = [], 0
    for run in runs:
        held.append(run)
        size += len(run[1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def flat(held, code: Code, bits: int):
    """Per token of several runs: text, class, whether it is one (each run has two places in front for the tokens before);
    per decision: node, answer, the slot of each context order, and token. Contexts never cross into another text."""
    gap = [np.concatenate([np.zeros(2, np.int64), c]) for _, c, _ in held]
    hashes = np.concatenate([h for _, _, h in held])
    classes = code.placed(np.concatenate(gap), hashes)
    real = np.concatenate([np.arange(len(c)) >= 2 for c in gap])
    text = np.concatenate([np.full(len(c), k) for (k, _, _), c in zip(held, gap, strict=True)])
    size = np.where(real, code.size[classes], 0)
    token = np.repeat(np.arange(len(classes)), size)
    at = np.arange(len(token)) + np.repeat(code.begin[classes] - (np.cumsum(size) - size), size)
    last, before = np.roll(hashes, 1), np.roll(hashes, 2)
    nodes, answers = code.nodes[at], code.bits[at]
    contexts = (last, last * np.uint64(3) + before * np.uint64(0x9E3779B97F4A7C15), before ^ np.uint64(0x5851F42D4C957F2D))
    salt = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    slots = [(((c[token] ^ salt) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - bits)).view(np.int64) for c in contexts]
    return text, classes, real, nodes, answers, slots, token


def packed(counts: np.ndarray) -> bytes:
    """Counts in the least type that holds them, compressed; the first byte is the type's size."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"u{data[0]}").astype(np.int64)


def gather(docs: DataFrame, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both answers: per node, and per order and slot, over all docs(hashes)."""
    n_nodes, spark = len(code.depth), docs.sparkSession
    shared = spark.sparkContext.broadcast(vars(code))  # plain values: executors unpickle broadcasts without this code
    width = 1 << min(bits, BLOCK_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(**shared.value)
        known = code.lookup()
        plain, tables = np.zeros((n_nodes, 2), np.int64), np.zeros((ORDERS, 2 << bits), np.int64)
        kept: list[list[np.ndarray]] = []

        def add_up() -> None:
            for table, parts in zip(tables, zip(*kept, strict=True), strict=True):
                table += np.bincount(np.concatenate(parts), minlength=len(table))
            kept.clear()

        for batch in batches:
            for held in joined(streams(batch["hashes"], known)):
                _, _, _, nodes, answers, slots, _ = flat(held, code, bits)
                plain += np.bincount(nodes * 2 + answers, minlength=2 * n_nodes).reshape(-1, 2)
                kept.append([slot * 2 + answers for slot in slots])
                if sum(len(x[0]) for x in kept) > 2 << 20:
                    add_up()
        if kept:
            add_up()
        rows = [(-1, 0, packed(plain))]
        rows += [(k, b, packed(part)) for k, table in enumerate(tables) for b, part in enumerate(table.reshape(-1, 2 * width)) if part.any()]
        if plain.any():
            yield pd.DataFrame(rows, columns=["kind", "block", "counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpacked(b) for b in parts["counts"])
        return pd.DataFrame({"kind": parts["kind"][:1], "block": parts["block"][:1], "counts": [packed(total)]})

    shape = "kind int, block int, counts binary"
    parts = docs.select("hashes").mapInPandas(count, shape)
    for fan in (64, 1):
        keyed = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(fan)))
        parts = keyed.groupBy("kind", "block", "part").applyInPandas(lambda p: add(p), shape)
    plain, tables = np.zeros((n_nodes, 2), np.float32), np.zeros((ORDERS, (1 << bits) // width, width, 2), np.float32)
    for row in parts.toLocalIterator():  # of fixed size: the blocks of the tables
        values = unpacked(row["counts"]).reshape(-1, 2)
        if row["kind"] < 0:
            plain[:] = values
        else:
            tables[row["kind"], row["block"]] = values
    return plain, tables.reshape(ORDERS, 1 << bits, 2)


@dataclass
class Mixer:
    """Logits and evidence of the predictors, gated weights, and the adaptive map."""

    plain: np.ndarray  # logit per node
    logits: np.ndarray  # ORDERS x slots
    evidence: np.ndarray  # ORDERS x slots: 0 (none) to GATE - 1
    weights: np.ndarray  # gates x (ORDERS + 2)
    refine: np.ndarray  # depths x 33 logits

    @classmethod
    def of(cls, plain: np.ndarray, tables: np.ndarray) -> Mixer:
        logit = lambda t, d: np.log((t[..., 1] + d) / (t[..., 0] + d)).astype(np.float32)
        seen = tables.sum(axis=-1)
        level = np.minimum(GATE - 1, np.ceil(np.log2(seen + 1) / 2)).astype(np.int8)
        weights = np.zeros((GATE ** len(tables), len(tables) + 2), np.float64)
        weights[:, 0] = 1.0
        grid = np.clip(np.arange(33) / 2.0 - 8, -8, 8)
        return cls(logit(plain, 0.4), logit(tables, 0.05), level, weights, np.tile(grid, (24, 1)))

    def inputs(self, nodes: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        plain, rows = self.plain[nodes], np.empty((len(self.logits) + 2, len(nodes)), np.float32)
        gate = np.zeros(len(nodes), np.int64)
        rows[0], rows[-1] = plain, 0.1
        for row, logits, evidence, slot in zip(rows[1:], self.logits, self.evidence, slots):  # noqa: B905  the first orders where there are fewer tables
            level = evidence[slot]
            gate *= GATE
            gate += level
            np.subtract(logits[slot], plain, out=row)
            row[level == 0] = 0
        return rows, gate

    def refined(self, mixed: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.minimum(np.maximum(mixed, -7.999), 7.999) * 2 + 16
        low = place.astype(np.int64)
        part = place - low
        at, grid = np.minimum(depth, 23) * self.refine.shape[1] + low, self.refine.ravel()
        return grid[at] * (1 - part) + grid[at + 1] * part, at, part

    def probability(self, nodes: np.ndarray, slots: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
        """Of the answer 1: the mean of the mixed and the refined probability."""
        rows, gate = self.inputs(nodes, slots)
        mixed = np.zeros(len(nodes), np.float32)
        for weights, row in zip(self.weights.T.astype(np.float32, "C"), rows, strict=True):
            row *= weights[gate]
            mixed += row
        other, _, _ = self.refined(mixed, depth)
        p = 0.5 / (1 + np.exp(-np.clip(mixed, -20, 20))) + 0.5 / (1 + np.exp(-np.clip(other, -20, 20)))
        return np.clip(p, 1e-7, 1 - 1e-7)

    def learn(self, nodes: np.ndarray, answers: np.ndarray, slots: list[np.ndarray], depth: np.ndarray, rate: float = 0.02, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Online steps, a block of decisions at a time: predict, then move the gated weights and the map by the error.

        Gives how many decisions each gate and each place of the map saw.
        """
        rows, gate = self.inputs(nodes, slots)
        cells, gates = np.zeros(self.refine.size), len(self.weights)
        for i in range(0, len(nodes), block):
            cut = slice(i, i + block)
            own, at, answer = rows[:, cut], gate[cut], answers[cut]
            mixed = (self.weights[at].T * own).sum(axis=0)
            error = answer - 1 / (1 + np.exp(-np.minimum(np.maximum(mixed, -20), 20)))
            size = np.sqrt(np.maximum(1, np.bincount(at, minlength=gates)))
            other, place, part = self.refined(mixed, depth[cut])
            for k, moved in enumerate(error * own):
                self.weights[:, k] += rate * np.bincount(at, moved, gates) / size
            miss, rest = rate * (answer - 1 / (1 + np.exp(-np.minimum(np.maximum(other, -20), 20)))), 1 - part
            above = place + 1
            step = np.bincount(place, miss * rest, len(cells)) + np.bincount(above, miss * part, len(cells))
            self.refine += step.reshape(self.refine.shape)
            cells += np.bincount(place, rest, len(cells)) + np.bincount(above, part, len(cells))
        return np.bincount(gate, minlength=len(self.weights)), cells.reshape(self.refine.shape)


def taught(docs: DataFrame, code: Code, bits: int) -> tuple[Mixer, int]:
    """The mixer of all docs(hashes, fold), and how many decisions taught its weights and map: each one of a training row."""
    sides = [gather(docs.filter(F.col("fold") == k), code, bits) for k in (0, 1)]
    mixer = Mixer.of(*(a + b for a, b in zip(*sides, strict=True)))
    shared = docs.sparkSession.sparkContext.broadcast((vars(code), [vars(Mixer.of(*sides[1 - k])) for k in (0, 1)]))  # of fixed size
    del sides

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, mixers = Code(**shared.value[0]), [Mixer(**m) for m in shared.value[1]]
        known = code.lookup()
        weights, refine = mixers[0].weights.copy(), mixers[0].refine.copy()  # both folds move the same ones
        for m in mixers:
            m.weights, m.refine = weights, refine
        gates, cells = np.zeros(len(weights)), np.zeros(refine.shape)
        for batch in batches:
            for k, m in enumerate(mixers):
                for held in joined(streams(batch["hashes"][batch["fold"] == k], known)):
                    _, _, _, nodes, answers, slots, _ = flat(held, code, bits)
                    more, seen = m.learn(nodes, answers, slots, code.depth[nodes])
                    gates += more
                    cells += seen
        if gates.any():
            parts = (gates[:, None] * weights, gates, cells * refine, cells)
            yield pd.DataFrame([[x.tobytes() for x in parts]], columns=["weights", "gates", "refine", "cells"])

    sums = [np.zeros(x.shape) for x in (mixer.weights, mixer.weights[:, 0], mixer.refine, mixer.refine)]
    parts = written(docs.select("hashes", "fold").mapInPandas(run, "weights binary, gates binary, refine binary, cells binary"), "taught")
    for row in parts.toLocalIterator():  # some 20 kB a task
        for total, data in zip(sums, row, strict=True):
            total += np.frombuffer(data).reshape(total.shape)
    weights, gates, refine, cells = sums
    mixer.weights = np.where(gates[:, None] > 0, weights / np.maximum(gates, 1)[:, None], mixer.weights)
    mixer.refine = np.where(cells > 0, refine / np.where(cells > 0, cells, 1), mixer.refine)
    return mixer, int(gates.sum())


def score(docs: DataFrame, seed: int = 3) -> DataFrame:
    """Base and model scores of every whole text of docs(doc_id, text), learned from rows whose remainder is not 0.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. A null or empty text
    is the end token alone; a null doc_id counts as the empty string in the remainder; repeated rows are scored each; an
    empty table gives no rows; without training tokens every token is unknown. All training rows teach the mixer's
    weights and are in the predictors' counts. The context tables have
    2 ** 14 to 2 ** 20 slots an order, by the number of tokens; words outside the broadcast ones get their counts by a
    join on their 64-bit hashes. Texts are split into tokens once; the hashes are a table that is removed at the end. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    fold = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(2)).cast("int").alias("fold")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", remainder(F.col("doc_id")) == 0)
    tokens = scratch.write(tokenized(docs.select("*", fold)), "tokens")
    words = scratch.write(counted(tokens), "words")
    texts = tokens.filter("kind = 0")
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    near = words.filter((F.col("c") >= total * KNOWN) | (F.col("word") == F.lit(END))).collect()  # at most 1 / KNOWN + 1 rows
    counts = {bytes(r["word"]): r["c"] for r in near}
    coded = [(w, c) for w, c in counts.items() if c >= total * CODED or w == END]
    if not any(w == END for w, _ in coded):
        coded.append((END, 0))
    split = min(RARE_BITS, max(0, ((total - sum(c for _, c in coded)) // RARE).bit_length() - 1))
    others, sorts = np.zeros(1 << split, np.int64), np.zeros(1 << split, np.int64)  # tokens and words of each class of other words
    bucket = F.shiftrightunsigned("mark", 64 - split) if split else F.lit(0)
    for b, n, k in words.groupBy(bucket.cast("int").alias("b")).agg(F.sum("c"), F.count(F.lit(1))).collect():  # at most 2 ** RARE_BITS rows
        others[b], sorts[b] = n, k
    for b, (_, c) in zip(buckets(hashed([w for w, _ in coded]), split).tolist(), coded, strict=True):
        others[b] -= c
        sorts[b] -= c > 0
    code = huffman(coded, *others.tolist())
    rest = np.log10(others + 0.1 * sorts + 0.1)  # the unknown word included
    bits = int(np.clip(np.ceil(np.log2(max(2, total))) - 4, LEAST_BITS, MOST_BITS))

    mixer, _ = taught(texts.filter(~F.col("held_out")), code, bits)

    known = Lookup(hashed(list(counts)), np.arange(1, len(counts) + 1))
    model = spark.sparkContext.broadcast((vars(code), vars(mixer), counts, (known.bits, known.keys, known.values)))  # tables of at most 2 ** 20 slots, at most 2 ** 18 words
    whole = np.log10(total + 0.1 * (kinds + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, mixer, counts = Code(**model.value[0]), Mixer(**model.value[1]), model.value[2]
        known = Lookup.__new__(Lookup)
        known.bits, known.keys, known.values = model.value[3]
        logs = np.array([np.nan, *(np.log10(c + 0.1) for c in counts.values())])
        class_of = np.array([0, *(code.classes.get(w, 0) for w in counts)])
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = len(batch)
            bits_of, count, hits, base, tail = (np.zeros(n) for _ in range(5))
            rare: list[list[np.ndarray]] = [[] for _ in range(n)]
            for runs in joined(streams(batch["hashes"], known)):
                held = [(k, class_of[ids], h) for k, ids, h in runs]
                text, classes, real, nodes, answers, slots, token = flat(held, code, bits)
                p = mixer.probability(nodes, slots, code.depth[nodes])
                bits_of += np.bincount(text[token], np.log10(np.where(answers == 1, p, 1 - p)), minlength=n)
                for (k, ids, h), (_, own, _) in zip(runs, held, strict=True):
                    values, far = logs[ids], h[2:][ids == 0]
                    rare[k].append(far)
                    count[k] += len(ids)
                    hits[k] += len(ids) - len(far)
                    base[k] += np.nansum(values)
                    tail[k] += np.nansum(values[own == 0]) - rest[buckets(h[2:][own == 0], split)].sum()
            kinds_of = [np.unique(np.concatenate(x).view(np.int64), return_counts=True) for x in rare]
            yield pd.DataFrame({
                "row": row + np.arange(n), "doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "n_tokens": count.astype(int), "n_bytes": batch["n_bytes"].astype("int64"),
                "n_known": hits.astype(int), "base": base, "model": bits_of + tail, "rare": [x for x, _ in kinds_of], "times": [t.astype(np.int32) for _, t in kinds_of],
            })
            row += n

    parts = scratch.write(texts.select("doc_id", "held_out", "n_bytes", "hashes").mapInPandas(run, PARTS), "scores")
    scratch.drop("tokens")
    far = words.groupBy("mark").agg(F.sum("c").alias("c"))
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("mark"), F.col("x.times").alias("times"))
    rare = rare.join(far, "mark", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("add"))
    out = parts.drop("rare", "times").join(sums, "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    out = out.withColumn("score", F.col("model") + add)
    out = durable(out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + add - F.col("n_tokens") * float(whole)).alias("base_score"), "score",
        (-F.col("score") / float(np.log10(2)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    ))
    scratch.drop("words", "scores")
    return out
