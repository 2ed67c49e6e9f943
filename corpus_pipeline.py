"""A corpus pipeline over documents: each stage takes what the one before kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtrail.llm import jaccard, langid, mixing, packing, secrets
from fluxtrail.llm.common import shared_dir, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model names; null lang becomes the named one. Others (null or empty texts, and
    texts without a letter) go. Repeated rows and all other columns, of any name, stay as they are."""
    model = langid.train(docs.filter(~langid.held(F.col("doc_id"))))
    label = next(name for k in range(len(docs.columns) + 1) if not {name := f"named_{k}", f"{name}_score"} & set(docs.columns))
    found = langid.predict(docs, model, out=label, out_score=f"{label}_score").filter(F.col(label) != langid.UNKNOWN)
    lang = F.coalesce("lang", label).alias("lang")
    return found.select(*(lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id; of equal rows one. Null and empty texts stay."""
    return jaccard.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mask. Null and empty texts and repeated rows stay."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the last time may be cut off. Texts without words go, as do
    those that the mix takes nothing of; a null source is a source of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens. A null or empty text is its end token; repeated rows are
    packed each. Of the columns only doc_id and text are read."""
    return packing.pack(docs)


STAGES = [("language ID", identify), ("n-gram Jaccard join", deduplicate), ("secret scans", mask_secrets), ("mixing sources", mix), ("packing", pack)]
#: SQL can't express the language model, the tokenizer and the curve; tests hold each stage against a plain form of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
