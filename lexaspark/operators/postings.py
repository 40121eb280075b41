"""Posting-list algebra as joins: doc_id, tf and, where they are kept, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND: documents of both lists; tf is summed. Which side drives the join, and
    whether the rarer one is broadcast, is the optimizer's choice by size."""
    return a.select("doc_id", F.col("tf").alias("_a")).join(b.select("doc_id", F.col("tf").alias("_b")), "doc_id").select("doc_id", (F.col("_a") + F.col("_b")).alias("tf"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR: documents of either list; tf is summed."""
    return a.select("doc_id", "tf").unionByName(b.select("doc_id", "tf")).groupBy("doc_id").agg(F.sum("tf").alias("tf"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """NOT: the entries of ``a`` whose document isn't in ``b``."""
    return a.join(b.select("doc_id"), "doc_id", "left_anti")


def shifted(positions: Column, by: int) -> Column:
    """Positions moved back by ``by``; a helper, so that the lambda has one argument."""
    return F.transform(positions, lambda p: p - F.lit(by))


def phrase_positions(parts: list[tuple[Column, int]]) -> Column:
    """Start positions at which every part stands at its gap from the first."""
    out, first = parts[0][0], parts[0][1]
    for positions, gap in parts[1:]:
        out = F.array_intersect(out, shifted(positions, gap - first))
    return out


def phrase_intersect(a: DataFrame, b: DataFrame, gap: int = 1) -> DataFrame:
    """Documents in which some position of ``b`` is ``gap`` after one of ``a``; tf 1."""
    both = a.select("doc_id", F.col("positions").alias("_a")).join(b.select("doc_id", F.col("positions").alias("_b")), "doc_id")
    return both.where(F.arrays_overlap(F.col("_a"), shifted(F.col("_b"), gap))).select("doc_id", F.lit(1).cast("long").alias("tf"))
