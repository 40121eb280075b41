"""Corpora: dumps of line pairs, and the document and page tables.

A corpus is a DataFrame of doc_id, title, text and links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaspark.sources import workspace

ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("outgoing_link", T.ArrayType(T.StringType()))])
QRELS = T.StructType([T.StructField("query", T.StringType()), T.StructField("relevant", T.ArrayType(T.StringType()))])

#: Bytes of a table, as Spark estimates them, that may be dealt out anew to be read by all cores.
SMALL_INPUT = 1 << 30

PAGE_JUNK = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->|<[^>]*>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a dump of line pairs: an action line, then a JSON article.

    gzip, bzip2 and plain text by the file's extension. Action lines are skipped
    by position; ids count articles from 0, in the order of file names and lines. An article that
    isn't JSON fails the read and names its line, from 1. Missing fields become empty.

    The number of a line must be global, as a bzip2 file is read in splits. Lines are
    written once with the split they come from, so a dump is unpacked once; then the
    driver gets the count of each split, and a line's number is its place in
    the split after all lines of earlier ones. No Python touches a line.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = workspace.saved(spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("mono")), "dump")
    splits = sorted(lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mono").alias("first")).collect())  # a row for each split
    starts, line = [], 1
    for r in splits:
        starts.append((r["file"], r["block"], r["first"] - line))
        line += r["n"]
    offsets = F.broadcast(spark.createDataFrame(starts, "file string, block long, offset long"))  # likewise
    article = F.from_json("value", T.StructType([*ARTICLE.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    numbered = lines.join(offsets, ["file", "block"]).select("value", (F.col("mono") - F.col("offset")).alias("line")).where("line % 2 = 0")
    read = numbered.select("line", article.alias("a")).withColumn("title", F.when(F.col("a").isNull() | F.col("a._bad").isNotNull(), F.raise_error(F.concat(F.lit("line "), "line", F.lit(" is not a JSON article")))).otherwise(F.coalesce("a.title", F.lit(""))))
    return read.select((F.col("line") / 2 - 1).cast("long").alias("doc_id"), "title", F.coalesce("a.text", F.lit("")).alias("text"), F.coalesce("a.outgoing_link", F.array().cast("array<string>")).alias("links"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id (by place in the file), query, relevant titles, from a JSON array."""
    cases = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", T.ArrayType(QRELS), {"mode": "FAILFAST"})).alias("query_id", "q"))
    return cases.select(F.col("query_id").cast("long").alias("query_id"), "q.query", F.coalesce("q.relevant", F.array().cast("array<string>")).alias("relevant"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where their files are small and too few to be read by all.
    A large input is never shuffled for it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size <= SMALL_INPUT and rows.rdd.getNumPartitions() < cores else rows


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat corpus: no titles and no links."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("links"))


def places_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus whose links are exact titles: regions name their nations and each nation its
    region, and one place that no document is about."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    both = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    of_region = both.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list("n_name")).alias("links"))
    places = both.select((F.col("n_nationkey") + 100).alias("doc_id"), F.col("n_name").alias("title"), F.array(F.col("r_name"), F.lit("Nowhere")).alias("links"))
    every = of_region.select(F.col("r_regionkey").alias("doc_id"), F.col("r_name").alias("title"), "links").unionByName(places)
    return every.select(F.col("doc_id").cast("long").alias("doc_id"), "title", F.lit("").alias("text"), "links")


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1)


def page_body(html: Column) -> Column:
    """Text outside of tags, scripts and styles; references are left as they are."""
    return F.regexp_replace(html, PAGE_JUNK, " ")


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fielded and linked corpus; links are the relative hrefs, without the slash."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").alias("doc_id"), page_title(html).alias("title"), page_body(html).alias("text"), F.regexp_extract_all(html, F.lit('href="/([^"/]*)"'), F.lit(1)).alias("links"))
