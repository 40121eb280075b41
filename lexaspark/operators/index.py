"""The inverted index as DataFrames, and its build, write and read.

Postings have a row for each (term, doc_id): the term frequency, how much of it
stands in the title, ascending positions in ``title + " " + text`` (the title's
come first), and the lengths of the document and its title, so that scoring
joins no documents. On disk they are range-partitioned and sorted by term, so that
a query's ``term IN (...)`` prunes row groups. The documents' table keeps their
terms in order: a build analyzes each text once.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspark.functions import varint
from lexaspark.functions.analysis import AnalyzerConfig, _nfc_udf, has_changed_letters, kept_terms, stems, tokenize

POSTINGS = "term string, doc_id long, tf long, titled int, doc_len int, title_len int, positions array<int>"
FORWARD = ["terms", "titled", "odd"]


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # doc_id, title, text, links, doc_len, title_len; where built here, also FORWARD
    postings: DataFrame  # see POSTINGS
    term_stats: DataFrame  # term, df, cf, max_tf
    corpus_stats: DataFrame  # n_docs, total_len, avgdl, title_total: one row
    config: AnalyzerConfig
    ranks: DataFrame | None = None  # doc_id, score


def forward(docs: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """The corpus with its kept terms in order (null where one is dropped), the number of
    the title's tokens, whether NFC can change a term, and the lengths in kept terms: 0
    for empty documents. No shuffle and no Python."""
    whole = F.concat_ws(" ", "title", "text")
    kept = lambda terms: F.size(F.filter(terms, lambda t: t.isNotNull()))
    rows = docs.withColumn("terms", kept_terms(whole, config)).withColumn("titled", F.size(tokenize(F.coalesce("title", F.lit("")))))
    rows = rows.withColumn("odd", F.coalesce(has_changed_letters(whole), F.lit(False)) if config.nfc else F.lit(False))
    return rows.withColumn("doc_len", kept(F.col("terms"))).withColumn("title_len", kept(F.slice("terms", F.lit(1), F.col("titled"))))


def doc_lengths(docs: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """The corpus with doc_len and title_len; NFC and stems change no length."""
    return forward(docs, config).drop(*FORWARD)


def tokens(rows: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """doc_id, pos, term, in_title, doc_len, title_len of every kept token of ``forward``'s rows.

    Documents that NFC can change go through Python alone, if there are any; stems are made
    for distinct words and joined."""
    lengths = ["doc_len", "title_len"]

    def exploded(some: DataFrame, terms: Column) -> DataFrame:
        placed = some.select("doc_id", "titled", *lengths, F.posexplode(terms).alias("pos", "term")).where("term IS NOT NULL")
        return placed.select("doc_id", "pos", "term", (F.col("pos") < F.col("titled")).alias("in_title"), *lengths)

    if config.nfc and not rows.where("odd").isEmpty():
        out = exploded(rows.where("NOT odd"), F.col("terms")).unionByName(exploded(rows.where("odd"), _nfc_udf("terms")))
    else:
        out = exploded(rows, F.col("terms"))
    if config.stem:
        known = stems(out).withColumnRenamed("term", "_word")
        out = out.join(known, F.col("term") == F.col("_word")).select("doc_id", "pos", F.col("stem").alias("term"), "in_title", *lengths)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings from tokens that are sorted by term, document and position."""
    held: list[pa.RecordBatch] = []

    def rows(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], ends[:-1]])
        first = pa.array(starts)
        titled = np.add.reduceat(table["in_title"].to_numpy().astype(np.int32), starts)
        positions = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), table["pos"].combine_chunks())
        of = lambda name: table[name].take(first).combine_chunks()
        return pa.RecordBatch.from_arrays([of("term"), of("doc_id"), pa.array(ends - starts), pa.array(titled, pa.int32()), of("doc_len"), of("title_len"), positions], POSTING_NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows < 2:
            continue
        new = pc.or_(pc.not_equal(table["term"][1:], table["term"][:-1]), pc.not_equal(table["doc_id"][1:], table["doc_id"][:-1])).to_numpy()
        ends = np.flatnonzero(new) + 1
        if len(ends):  # the last group may go on in the next batch
            yield rows(table.slice(0, int(ends[-1])), ends)
            held = table.slice(int(ends[-1])).to_batches()
        else:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield rows(table, np.array([table.num_rows]))


POSTING_NAMES = [x.split()[0] for x in POSTINGS.split(", ")]


def build_postings(token_rows: DataFrame, by_range: bool = False) -> DataFrame:
    """Postings, sorted by term and document within partitions, by one shuffle of the tokens; a
    frequent term can be in several partitions. ``by_range`` sorts them over all partitions, for a
    written index; it reads the tokens once more to find the ranges."""
    kind = token_rows.schema["doc_id"].dataType.simpleString()
    dealt = token_rows.repartitionByRange("term", "doc_id") if by_range else token_rows.repartition("term", "doc_id")
    return dealt.sortWithinPartitions("term", "doc_id", "pos").select("term", "doc_id", "pos", "in_title", "doc_len", "title_len").mapInArrow(_grouped, POSTINGS.replace("doc_id long", f"doc_id {kind}"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def document_frequencies(token_rows: DataFrame) -> DataFrame:
    """``term_stats`` straight from tokens, without their positions."""
    return term_stats(token_rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf")))


def corpus_stats(docs: DataFrame) -> DataFrame:
    n, total = F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))
    return docs.agg(n.alias("n_docs"), total.alias("total_len"), F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("title_len"), F.lit(0)).alias("title_total"))


def build_index(docs: DataFrame, config: AnalyzerConfig = AnalyzerConfig()) -> Index:
    """A lazy index over a corpus; write it to query it more than once."""
    rows = forward(docs, config)
    postings = build_postings(tokens(rows, config))
    return Index(rows, postings, term_stats(postings), corpus_stats(rows), config)


def write_index(index: Index, path: str) -> None:
    """Four Parquet tables and the analyzer's settings under ``path``, and the ranks if the
    index has some. Where the documents have their terms, postings are built from
    the written table, so texts are analyzed once; others are sorted again."""
    spark = index.docs.sparkSession
    index.docs.write.option("compression", "zstd").parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    if set(FORWARD) <= set(docs.columns):
        postings = build_postings(tokens(docs, index.config), by_range=True)
    else:
        postings = index.postings.select(*POSTING_NAMES).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    postings.write.option("compression", "zstd").parquet(f"{path}/postings")
    term_stats(spark.read.parquet(f"{path}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/term_stats")
    corpus_stats(docs).write.parquet(f"{path}/corpus_stats")
    spark.createDataFrame([(json.dumps(asdict(index.config)),)], "value string").coalesce(1).write.text(f"{path}/config")
    if index.ranks is not None:
        write_ranks(index.ranks, path)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Keeps doc_id, score with a written index; earlier ranks go."""
    ranks.select("doc_id", "score").write.mode("overwrite").parquet(f"{path}/ranks")


def read_ranks(spark: SparkSession, path: str) -> DataFrame | None:
    """The ranks that an index was written with; None without any, and with a warning if
    they can't be read."""
    try:
        return spark.read.parquet(f"{path}/ranks").select("doc_id", "score")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            warnings.warn(f"the ranks in {path} can't be read: {e.getCondition()}", stacklevel=2)
        return None


def read_index(spark: SparkSession, path: str) -> Index:
    config = AnalyzerConfig(**json.loads(spark.read.text(f"{path}/config").first()[0]))
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "term_stats", "corpus_stats")), config, read_ranks(spark, path))


def field_tf(field: str | None) -> Column:
    """A posting's frequency in a field, or in both."""
    return F.col("tf") if field is None else F.col("titled").cast("long") if field == "title" else F.col("tf") - F.col("titled") if field == "text" else F.lit(0).cast("long")


def field_positions(field: str | None) -> Column:
    if field is None:
        return F.col("positions")
    if field == "title":
        return F.slice("positions", F.lit(1), F.col("titled"))
    return F.slice("positions", F.col("titled") + 1, (F.col("tf") - F.col("titled")).cast("int")) if field == "text" else F.array().cast("array<int>")


def by_field(postings: DataFrame) -> DataFrame:
    """term, field, doc_id, tf, positions: a row for each field that has the term."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), field_tf(f).alias("tf"), field_positions(f).alias("positions")) for f in ("title", "text")])
    return postings.select("term", "doc_id", F.explode(F.filter(each, lambda x: x["tf"] > 0)).alias("x")).select("term", "x.field", "doc_id", "x.tf", "x.positions")


def posting_bytes(postings: DataFrame) -> DataFrame:
    """postings, bytes, bytes_per_posting if lists were coded as varints of gaps and frequencies:
    a size report, one row. A term's list is walked in order, so a task holds a list at most."""
    gap = F.col("doc_id") - F.coalesce(F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id")), F.lit(0))
    each = postings.select("term", (varint.length(gap) + varint.length(F.col("tf"))).cast("long").alias("b")).groupBy("term").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    return each.agg(F.sum("n").alias("postings"), F.sum(F.col("b") + varint.length(F.col("n"))).alias("bytes")).withColumn("bytes_per_posting", F.round(F.col("bytes") / F.col("postings"), 6))


def title_map(docs: DataFrame) -> DataFrame:
    """title -> doc_id; of equal titles the last document wins."""
    return docs.groupBy("title").agg(F.max("doc_id").alias("doc_id"))


def lookup(index: Index, term: str) -> DataFrame:
    """Postings of an exact, analyzed term: doc_id, tf, positions over both fields."""
    return index.postings.where(F.col("term") == term).select("doc_id", "tf", "positions")
