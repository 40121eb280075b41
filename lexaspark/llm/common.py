"""Shared pieces of the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which
every executor and the driver can reach, so a lost executor costs a re-read and
never a recomputation from a machine-local file.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspark.sources.workspace import new_path, saved, shared_dir  # noqa: F401

#: Word characters after A-Z are lower-cased, and the same class on unchanged text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a batch that goes to Python, unless the session names fewer.
BATCH_BYTES = 8 << 20
_held: dict[str, tuple] = {}


def small_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes, so that neither long texts nor many rows
    fill a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, str((1 << 31) - 2)).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def in_worker(kind: str, key, make):
    """What ``make`` gives, kept in a Python worker for later tasks with one kind and
    key. A worker keeps one thing alone: what an earlier stage has kept goes, and its
    memory with it, before the next is made."""
    if _held.get(kind, (None,))[0] != key:
        _held.clear()
        released()
        _held[kind] = key, make()
    return _held[kind][1]


def released() -> None:
    """Gives a worker's freed memory back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_running_totals(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds ``_index`` (place in the order, from 0) and, for each value column,
    the sum over all rows before (``sums``: value column -> new column).

    A range partitioning is written out, so that the part of a row is fixed;
    the driver gets one row of totals for each part and no more. ``order``
    must tell rows apart, or equal rows must be interchangeable.
    """
    spark = df.sparkSession
    fields = df.columns
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    kept = saved(ranged, name)
    totals = kept.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_t_{o}") for v, o in sums.items()]).collect()
    rows, at = [], [0] * (1 + len(sums))
    for r in sorted(totals, key=lambda r: r["_part"]):
        rows.append((r["_part"], *at))
        at = [a + (b or 0) for a, b in zip(at, [r["_n"], *[r[f"_t_{o}"] for o in sums.values()]])]
    schema = "_part int, _o_n long" + "".join(f", _o_{o} long" for o in sums.values())
    offsets = F.broadcast(spark.createDataFrame(rows, schema))  # a row for each part
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = kept.join(offsets, "_part").select(
        *fields,
        (F.col("_o_n") + F.count(F.lit(1)).over(before)).alias("_index"),
        *[(F.col(f"_o_{o}") + F.coalesce(F.sum(v).over(before), F.lit(0))).alias(o) for v, o in sums.items()],
    )
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
