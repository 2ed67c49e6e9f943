"""Language identification by string kernels.

The kernel of two texts is the share of their blended-spectrum n-grams (1 to 4 code points, present or not) that both
have: |A and B| / sqrt(|A| |B|), over n-grams hashed to BUCKETS. Nystroem landmarks give each text the kernel values to
a few texts, whitened by the landmarks' own kernel; one-versus-rest kernel ridge regression is then linear in them. The
model is one matrix, so a batch of texts is scored by one product of its presence matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_of, small_batches

BUCKETS, LONGEST = 1 << 15, 4
UNKNOWN = "und"


#: Of the code points up to U+024F, whether they are letters.
LATIN = np.array([chr(c).isalpha() for c in range(0x250)])


def letters(codes: np.ndarray) -> np.ndarray:
    """Of each code point, whether it is a letter; those beyond the table are asked for once each."""
    good = LATIN[np.minimum(codes, len(LATIN) - 1)]
    far = codes >= len(LATIN)
    if far.any():
        kinds, which = np.unique(codes[far], return_inverse=True)
        good[far] = np.array([chr(c).isalpha() for c in kinds])[which]
    return good


def presence(text: str | None) -> np.ndarray | None:
    """The hashed n-grams that a text has, over its letters in lower case with one blank between words; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    good = letters(codes)
    if not good.any():
        return None
    codes = np.where(good, codes, 32).astype(np.uint32)
    keep = good.copy()
    keep[1:] |= good[:-1]
    codes = np.concatenate([np.array([32], np.uint32), codes[keep], np.array([32], np.uint32)])
    found = np.zeros(BUCKETS, bool)
    gram = np.zeros(len(codes), np.uint32)
    for n in range(LONGEST):
        gram = (gram[: len(codes) - n] * np.uint32(0x01000193) ^ codes[n:]) * np.uint32(0x9E3779B1)
        if len(gram):
            found[(gram >> np.uint32(17)) % BUCKETS] = True
        gram = gram[:-1]
    return found


def matrix(texts) -> tuple[np.ndarray, np.ndarray]:
    """Presence of the texts that have letters, and which texts those are."""
    rows = [presence(t) for t in texts]
    which = np.array([r is not None for r in rows], bool)
    kept = [r for r in rows if r is not None]
    return (np.stack(kept) if kept else np.zeros((0, BUCKETS), bool)), which


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages

    def score(self, present: np.ndarray) -> np.ndarray:
        """Regression values per language: the kernel to all landmarks times the ridge weights, in one product."""
        sizes = np.sqrt(np.maximum(1, present.sum(axis=1)))
        return present.astype(np.float32) @ self.weights / sizes[:, None]


def fit(packed: np.ndarray, languages: list[str], landmarks: int = 256, ridge: float = 1e-3, rows: int = 256) -> Model:
    """``packed``: presence as bits, a row per text; the first rows, alternating between languages, are landmarks.

    Kernel values are made for so many ``rows`` at a time, so the driver never holds the sample as numbers.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    of = np.array([names.index(x) for x in languages])
    turn = np.zeros(len(of), int)
    for k in range(len(names)):
        turn[of == k] = np.arange((of == k).sum())
    chosen = np.lexsort((of, turn))[:landmarks]

    def unit(bits: np.ndarray) -> np.ndarray:
        present = np.unpackbits(bits, axis=1).astype(np.float32)
        return present / np.sqrt(np.maximum(1, present.sum(axis=1)))[:, None]

    marks = unit(packed[chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([unit(packed[i : i + rows]) @ marks.T for i in range(0, len(packed), rows)]) @ whiten
    wanted = np.where(of[:, None] == np.arange(len(names)), 1.0, 0.0)
    share = 1 / np.maximum(1, np.bincount(of, minlength=len(names)))[of]  # languages count alike
    left = mapped.T @ (mapped * share[:, None]) + ridge * np.eye(mapped.shape[1])
    ridge_weights = np.linalg.solve(left, mapped.T @ (wanted * share[:, None]))
    return Model(names, marks.T @ (whiten @ ridge_weights).astype(np.float32))


def held(doc_id: Column) -> Column:
    """Whether a row is held out; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(labelled: DataFrame, per_language: int = 1000, seed: int = 5) -> Model:
    """Fit on a sample of labelled(doc_id, text, lang): about ``per_language`` rows of each language, by the hash of
    doc_id and text. Null languages, and texts without a letter, teach nothing."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter("lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return fit(np.zeros((0, BUCKETS // 8), np.uint8), [])
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40))
    limit = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(math.ceil(min(1, per_language / n) * (1 << 40))))))
    rows = rows.withColumn("place", place).filter(F.col("place") < F.element_at(limit, F.col("lang")))

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, which = matrix(batch["text"])
            yield pd.DataFrame({"lang": batch["lang"][which], "place": batch["place"][which], "bits": [np.packbits(r).tobytes() for r in found]})

    sample = rows.select("text", "lang", "place").mapInPandas(present, "lang string, place long, bits binary").toPandas()
    sample = sample.sort_values(["place", "lang"], kind="stable")
    packed = np.array([np.frombuffer(b, np.uint8) for b in sample["bits"]], np.uint8).reshape(-1, BUCKETS // 8)
    return fit(packed, list(sample["lang"]))


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", out_score: str = "score") -> DataFrame:
    """docs with ``out`` and ``out_score``: the language of the highest regression value, and that value as 0 to 1.

    ``und`` with score 0 for a null text, one without a letter, and for every text if the model has no language. Columns
    of these two names are replaced; other columns, of any name, and repeated rows stay.
    """
    small_batches(docs.sparkSession)

    def run(texts: pd.Series) -> pd.DataFrame:
        found, which = matrix(texts)
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if len(found) and model.languages:
            values = model.score(found)
            best = values.argmax(axis=1)
            names[which] = np.array(model.languages, object)[best]
            scores[which] = np.clip(values[np.arange(len(best)), best], 0, 1)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    found = F.pandas_udf(run, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in (out, out_score)]
    rows = docs.select(row_of(docs)).withColumn("found", found(F.col("row").getField(text)))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("found.lang_pred").alias(out), F.col("found.score").alias(out_score))
