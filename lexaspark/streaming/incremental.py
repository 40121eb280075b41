"""Incremental indexing: every micro-batch of documents becomes an index segment.

A batch's postings and documents are written under its id, which a replayed batch
overwrites, so a restart neither loses nor repeats documents. Term and corpus
statistics are aggregates over the segments when the index is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexaspark.functions.analysis import AnalyzerConfig
from lexaspark.operators.index import FORWARD, Index, build_postings, corpus_stats, forward, term_stats, tokens


def index_stream(docs: DataFrame, path: str, config: AnalyzerConfig = AnalyzerConfig(), **trigger) -> StreamingQuery:
    """Starts indexing a stream of doc_id, title, text, links."""

    def add(batch: DataFrame, batch_id: int) -> None:
        to = f"{path}/docs/segment={batch_id}"
        forward(batch, config).write.mode("overwrite").parquet(to)
        build_postings(tokens(batch.sparkSession.read.parquet(to), config)).write.mode("overwrite").parquet(f"{path}/postings/segment={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/progress").trigger(**(trigger or {"availableNow": True})).start()


def read_segments(spark: SparkSession, path: str, config: AnalyzerConfig = AnalyzerConfig()) -> Index:
    docs = spark.read.parquet(f"{path}/docs").drop("segment", *FORWARD)
    postings = spark.read.parquet(f"{path}/postings").drop("segment")
    return Index(docs, postings, term_stats(postings), corpus_stats(docs), config)


def compact(spark: SparkSession, path: str, to: str, config: AnalyzerConfig = AnalyzerConfig()) -> None:
    """Merges all segments into one written index."""
    from lexaspark.operators.index import write_index

    write_index(read_segments(spark, path, config), to)


def unseen(docs: DataFrame, index: Index) -> DataFrame:
    """The documents that an index doesn't hold yet."""
    return docs.join(index.docs.select(F.col("doc_id")), "doc_id", "left_anti")
