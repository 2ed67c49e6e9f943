"""Packing documents into fixed-length sequences along a space-filling curve.

A document's vector is the hashed counts of its token ids, projected to three dimensions; its place on the Hilbert curve
through them orders the documents, so neighbours have similar tokens. Documents are cut freely along that order: each
sequence but the very last is full. Places in the order are exact running totals over range partitions; token ids are
made once, written, and shuffled once to the run of the curve that holds them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import interval_of, running_total, small_batches, written

END = 1
DIMENSIONS, BITS = 3, 10
TOKENS = "doc_id long, n long, place long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(vocabulary: str | None, name: str):
    """The byte-level vocabulary of file ``vocabulary`` (None: public_tokenizers' file ``name``); kept by the worker.

    The same ids as tokenizers' ``byte_bpe_50k.json`` without special tokens, from the same ranks; strings of special
    tokens are ordinary text.
    """
    import public_tokenizers
    import tiktoken
    from tiktoken import registry

    path = vocabulary or public_tokenizers.path(f"{name}.tiktoken")
    if path not in registry.ENCODINGS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        registry.ENCODINGS[path] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return registry.ENCODINGS[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (rows x dimensions, each below 2 ** bits), by rotating axes bit by bit."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where(x[-1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | x[i] >> b & 1
    return out


def projection(seed: int, buckets: int = 1024) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, DIMENSIONS)).astype(np.float32)


def tokenized(docs: DataFrame, vocabulary: str | None, seed: int) -> DataFrame:
    """doc_id, n, place, ids (little-endian, of 16 bits, or of 32 where one needs more) of docs(doc_id, text); the ids end with END."""
    small_batches(docs.sparkSession)
    matrix = projection(seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, "byte_bpe_50k").encode_ordinary
        for batch in batches:
            counts, raw, points = [], [], []
            for text in batch["text"]:
                ids = np.array([*encode(text or ""), END], np.uint32)
                seen = np.bincount((ids * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=1024).astype(np.float32)
                vector = seen / np.linalg.norm(seen)
                points.append(vector @ matrix)
                counts.append(len(ids))
                raw.append(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
            # each coordinate is close to standard normal: the logistic curve spreads it over the cells
            cells = np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * np.array(points).reshape(-1, DIMENSIONS))))
            salt = pd.util.hash_array(batch["doc_id"].fillna(-1).to_numpy(np.int64)).astype(np.uint64) >> np.uint64(31)
            place = hilbert(cells.astype(np.int64)) << 33 | salt.astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": counts, "place": place, "ids": raw})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return written(rows.mapInPandas(run, TOKENS), "tokens")


def pack(docs: DataFrame, length: int = 2048, vocabulary: str | None = None, seed: int = 11, chunk_tokens: int = 1 << 20, most_chunks: int = 20_000) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of ``length`` tokens, in the order of the curve.

    Every sequence is full but the last. A null or empty text is the end token alone; rows repeated or without an id are
    packed each on its own; an empty table has no pieces. Other columns are not read. The curve is cut into runs of
    about ``chunk_tokens`` tokens (more, where that made over ``most_chunks`` runs), one number each on the driver.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, vocabulary, seed)
    slim = tokens.groupBy("place").agg(F.sum("n").alias("n"))
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(chunk_tokens, -(-total // most_chunks))
    placed = running_total(slim, ["place"], "n", "before", int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = placed.groupBy(F.expr(f"before div {size}L").alias("run")).agg(F.min("place").alias("cut"), F.min("before").alias("begin")).collect()
    runs = sorted((r["cut"], r["begin"]) for r in runs)  # a row per run
    begins = [b for _, b in runs]
    run_of = interval_of(F.col("place"), [c for c, _ in runs][1:])
    rows = tokens.withColumn("run", run_of).repartition(3 * len(runs) + 1, "run")
    rows = rows.sortWithinPartitions("run", "place", "doc_id", "n").select("run", "doc_id", "n", "ids")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = 0, -1
        for batch in batches:
            out = []
            for run, doc, n, raw in zip(batch["run"], batch["doc_id"], batch["n"], batch["ids"], strict=True):
                if run != last:
                    at, last = begins[run], run
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    held = min(n - start, length - at % length)
                    out.append((None if pd.isna(doc) else int(doc), start, held, zlib.crc32(ids[start : start + held].tobytes()), n, at // length, at % length))
                    start += held
                    at += held
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(cut, PIECES)
