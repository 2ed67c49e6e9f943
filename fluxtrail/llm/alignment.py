"""Alignment of two tokenizers over the bytes of each text, and corpus-wide counts of the token pairs that meet.

A string of one label a byte (nothing ends, a token of A ends, one of B, both) is scanned by a regular expression; each
span up to a byte where both end is a group, and the labels counted in it give its tokens. Every byte with a label ends
exactly one overlap, so the labelled bytes are the links. Texts are read and encoded once: a task keeps the counts of id
pairs of each text and of blocks of texts; only a block's distinct pairs are shuffled to be added up and sent back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed, text_of, unpacked
from .packing import encoder

SPAN = re.compile(rb"[\x00-\x02]*\x03")  # 0 nothing, 1 A ends, 2 B ends, 3 both end
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
#: A row is a text with its pairs, or (part 1) the pairs of a block: their ids (or their places in the block's), and counts.
STORED = f"{COUNTS}, block long, part int, n_pairs long, pairs binary, counts binary"
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def fields(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in map(str.split, schema.split(", "))])


class Aligner:
    """Both tokenizers with their tokens' bytes; made once a task."""

    def __init__(self, vocabulary: str | None = None, pieces: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece

        self.a = encoder(vocabulary, "byte_bpe_50k")
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]
        byte_of = {i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) for i in range(self.b.vocab_size()) if self.b.is_byte(i)}
        self.bytes_b = [byte_of.get(i) or self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = np.array([list(str(i).encode().rjust(5, b"\0")) + [0] for i in range(most)], np.uint8)  # the last is the separator's place

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B, the groups' numbers of tokens of each, and the id pairs (A's in the upper 32 bits) of all links."""
        whole = " " + text
        raw = whole.encode()
        ids_a, ids_b = self.a.encode_ordinary(whole), self.b.encode(text)
        if not text or b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        labels = np.zeros(len(raw), np.uint8)
        labels[self.len_a[a].cumsum() - 1] = 1
        labels[self.len_b[b].cumsum() - 1] |= 2
        spans = SPAN.findall(labels.tobytes())
        of_a, of_b = (np.array([s.count(label) + 1 for s in spans], np.int64) for label in (b"\x01", b"\x02"))
        ends = labels[labels != 0]  # a link ends at each
        from_a, from_b = ((ends & 1).cumsum() - (ends & 1)), ((ends >> 1).cumsum() - (ends >> 1))
        return a, b, of_a, of_b, a[from_a] << 32 | b[from_b]

    def written(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> bytes:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = of_a.cumsum(), of_b.cumsum()
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(ends_b - of_b, of_a)] = a
        ids[np.arange(len(b)) + np.repeat(ends_a, of_b)] = b
        after[ends_a + ends_b - of_b - 1] = ord("|")
        after[ends_a + ends_b - 1] = ord(";")
        cells = self.digits[ids]
        cells[:, 5] = after
        flat = cells.ravel()
        return flat[flat != 0].tobytes()[:-1]


def encoded(docs: DataFrame, vocabulary: str | None, pieces: str | None, block_links: int, groups: bool) -> DataFrame:
    """STORED rows of docs(doc_id, text)."""
    schema = fields(STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block, rows, links = Aligner(vocabulary, pieces), TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            """The rows of a block: pairs of its texts become steps between their places among the block's pairs."""
            all_pairs = np.concatenate([r["pairs"] for r in rows])
            own, at = np.unique(all_pairs, return_inverse=True)
            totals = np.bincount(at, np.concatenate([r["counts"] for r in rows]), len(own)).astype(np.int64)
            start = 0
            for r in rows:
                n = len(r["pairs"])
                r.update(block=block, part=0, n_pairs=n, pairs=packed(np.diff(at[start : start + n], prepend=0)), counts=packed(r["counts"]))
                start += n
            rows.append({"block": block, "part": 1, "n_pairs": len(own), "pairs": own.tobytes(), "counts": totals.tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if found := aligner.align(text):
                    a, b, of_a, of_b, pairs = found
                    listed = aligner.written(a, b, of_a, of_b)
                    own, counts = np.unique(pairs, return_counts=True)
                    row = {"n_a": len(a), "n_b": len(b), "n_groups": len(of_a), "n_links": len(pairs), "groups_sha256": hashlib.sha256(listed).hexdigest(), "groups": listed.decode() if groups else None}
                else:
                    own = counts = np.empty(0, np.int64)
                    row = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "groups": "" if groups else None}
                rows.append({"doc_id": doc_id, "pairs": own, "counts": counts} | row)
                links += len(own)
                if links >= block_links:
                    yield closed()
                    rows, links, block = [], 0, block + 1
        if rows:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, STORED)


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, at, pair, n) of blocks' pairs."""
    for batch in batches:
        for block, pairs, counts in zip(batch["block"].to_pylist(), batch["pairs"], batch["counts"], strict=True):
            pair, n = (np.frombuffer(x.as_buffer(), np.int64) for x in (pairs, counts))
            for i in range(0, len(pair), 50_000):
                part = pair[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(n[i : i + 50_000])], ["block", "at", "pair", "n"])


def judged(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """FOUND rows of one block: its texts, and the corpus's counts of its pairs."""
    at = pairs["at"].to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at], best[at] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
    top = total == best
    n_best, count_sum = [], []
    for n, steps, counts in zip(rows["n_pairs"].to_pylist(), rows["pairs"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        own, held = unpacked(steps, n).cumsum(), unpacked(counts, n)
        n_best.append(int(held[top[own]].sum()))
        count_sum.append(int((held * total[own]).sum()))
    out = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([out.get(f.name, rows[f.name] if f.name in rows.column_names else None) for f in fields(FOUND)], schema=fields(FOUND))


def align(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, block_links: int = 3_000_000, groups: bool = False) -> DataFrame:
    """FOUND rows of docs(doc_id, text), one per row of docs: token groups, links, and how common their pairs are in all docs.

    ``vocabulary`` and ``pieces`` name the files of A (ranks) and B; with ``groups`` the groups are returned as text, else
    only their digest. A null or empty text, and one that a tokenizer does not give back, has no tokens: zeros and ''.
    Repeated rows count each; rows without an id are rows like any other; an empty table gives no rows; other columns are
    not read. A block holds texts with about ``block_links`` pairs in all, in one task, however long the last text is.
    """
    tables = Scratch(docs.sparkSession)
    stored = tables.write(encoded(docs, vocabulary, pieces, block_links, groups), "aligned")
    pairs = stored.filter("part = 1").select("block", "pairs", "counts").mapInArrow(pair_rows, "block long, at int, pair long, n long")
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = tables.write(totals, "totals")
    best = totals.groupBy(F.expr("pair & 4294967295L").alias("b")).agg(F.max("total").alias("best"))  # no more rows than B has ids
    counted = totals.join(F.broadcast(best), F.expr("pair & 4294967295L") == F.col("b")).select("pair", "total", "best")
    back = pairs.select("block", "at", "pair").join(counted, "pair").select("block", "at", "total", "best")
    texts = stored.filter("part = 0").drop("part")
    return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judged, FOUND)
