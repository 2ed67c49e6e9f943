"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rule for Python bytes: ``bytes.split()`` splits on exactly these six bytes.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset and the session is local (tests), a temporary folder is set; on a cluster without it this fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder; its lineage is cut and its row order and partitions stay."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a compressed columnar table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run of an operator in the shared folder, removed once nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self.paths[label] = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.paths[label])
        return self.spark.read.schema(df.schema).parquet(self.paths[label])

    def drop(self, *labels: str) -> None:
        """Remove these tables. A collection of the driver's dead plans lets Spark's cleaner drop their shuffle files too."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def picked(df: DataFrame, few: int = 500_000) -> DataFrame:
    """df, of slim rows and already written, marked for broadcast where it has at most ``few`` rows."""
    return F.broadcast(df) if df.count() <= few else df


def row_of(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that columns an operator adds can't clash with them; ``row.*`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that a batch of very long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def parts_for(spark: SparkSession, rows: int, each: int = 200_000) -> int:
    """Partitions for so many slim rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def interval_of(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``; 0 for null. Looked up in two steps of sqrt(n) each."""
    if not cuts:
        return F.lit(0)
    inner = max(1, int(len(cuts) ** 0.5))
    runs = [cuts[i : i + inner] for i in range(0, len(cuts), inner)]
    run = F.size(F.filter(F.array(*(F.lit(r[0]) for r in runs)), lambda b: b <= value)) - 1
    within = F.size(F.filter(F.get(F.array(*(F.array(*map(F.lit, r)) for r in runs)), run), lambda b: b <= value))
    return F.when(value.isNull() | (value < cuts[0]), 0).otherwise(run * inner + within)


def running_total(df: DataFrame, order: list[str], weight: str, out: str, n: int) -> DataFrame:
    """df with ``out``: the sum of ``weight`` over the rows before, in the order of all rows by ``order``.

    Rows are range-partitioned and written once; each partition's start is the total of the partitions before, found
    from one row per partition, so no task sees more than its own range. Ties in ``order`` follow no fixed order.
    """
    ranged = durable(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    starts = ranged.groupBy("_pid").agg(F.sum(weight).alias("_w"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("_pid", F.coalesce(F.sum("_w").over(before), F.lit(0)).cast("long").alias("_start"))
    own = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.join(starts, "_pid")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(weight).over(own), F.lit(0)).cast("long"))
        .drop("_pid", "_start")
    )


def packed(values: np.ndarray) -> bytes:
    """Values as little-endian integers of the least width."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n if n else 1}").astype(np.int64)
