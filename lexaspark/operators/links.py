"""Link resolution and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaspark.sources import workspace

DAMPING, ITERATIONS = 0.85, 30


def link_graph(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """src, dst of every link whose title is known; repeated links stay, unknown
    ones go. ``targets``: title, doc_id."""
    links = docs.select(F.col("doc_id").alias("src"), F.explode("links").alias("title"))
    return links.join(targets.select("title", F.col("doc_id").alias("dst")), "title").select("src", "dst")


def title_words(titles: DataFrame) -> DataFrame:
    """title map by each token of the titles, the last document winning: an
    adaptation for tables whose links name words of titles."""
    from lexaspark.functions.analysis import lowercase, tokenize

    words = titles.select("doc_id", F.explode(tokenize(lowercase(F.col("title")))).alias("title"))
    return words.groupBy("title").agg(F.max("doc_id").alias("doc_id"))


def linked_titles(docs: DataFrame) -> DataFrame:
    """src, dst of every link that is the exact title of a document, the last of equal titles."""
    from lexaspark.operators.index import title_map

    return link_graph(docs, title_map(docs))


def dangling_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("doc_id").join(edges.select(F.col("src").alias("doc_id")), "doc_id", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, score after a fixed number of rounds from 1/N.

    A node's rank is divided by all its links, repeated ones and those to unknown
    targets too; dangling rank is spread evenly.

    A round adds the same amount to every node, which depends on the dangling
    rank of the round before. The rounds are linear, so Spark computes what an
    even start would become along the links after 0, 1, ... rounds, without any
    value from the driver in between; one aggregate of the dangling parts then
    gives the amounts, and each node's rank is a weighted sum over the rounds. A
    round is one join and one pre-aggregated sum by target over the nodes that
    still have some, written to the shared folder. Repeated edges are
    summed into one weight.
    """
    n = nodes.count()
    if not n:
        return nodes.select("doc_id").withColumn("score", F.lit(0.0))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(out, "src")
    for end in ("src", "dst"):  # rank that unknown targets get goes nowhere
        weighted = weighted.join(nodes.select(F.col("doc_id").alias(end)), end, "left_semi")
    weighted = workspace.saved(weighted.select("src", "dst", (damping * F.col("n") / F.col("out")).alias("share")), "edges")
    level = nodes.select("doc_id", F.lit(1.0).alias("u"), F.lit(0).alias("turn"))
    levels = level
    for turn in range(1, iterations + 1):
        given = level.join(weighted, F.col("doc_id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("u") * F.col("share")).alias("u"))
        level = workspace.saved(given.select(F.col("dst").alias("doc_id"), "u", F.lit(turn).alias("turn")), "ranks")
        levels = levels.unionByName(level)
    known = nodes.select("doc_id").join(out.select(F.col("src").alias("doc_id"), F.lit(1).alias("_out")), "doc_id", "left").select("doc_id", F.col("_out").isNull().alias("dangling"))
    levels = workspace.saved(known.join(levels, "doc_id"), "ranks")
    lost = {r["turn"]: r["u"] for r in levels.where("dangling").groupBy("turn").agg(F.sum("u").alias("u")).collect()}  # a row for each round
    added: list[float] = []  # what each round adds to every node
    for t in range(iterations):
        at = sum(added[t - 1 - j] * lost.get(j, 0.0) for j in range(t)) + lost.get(t, 0.0) / n
        added.append((1 - damping) / n + damping * at / n)
    share = F.array(*[F.lit(w) for w in [*reversed(added), 1.0 / n]])
    return levels.groupBy("doc_id").agg(F.sum(F.col("u") * F.get(share, F.col("turn"))).alias("score"))
