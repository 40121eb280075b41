"""Scorers, blends with PageRank, and top-k retrieval for one query or many.

Scores are rounded to six places before sorting and ties go to the smaller
doc_id, so that results don't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaspark.functions.analysis import AnalyzerConfig, analyze_text, kept_terms, normalized, stemmed
from lexaspark.operators.index import Index, field_tf
from lexaspark.plans.evaluate import evaluate, evaluate_as_coded

K1, B = 1.2, 0.75

#: (tf, df, doc_len, n_docs, avgdl) -> score.
Scorer = Callable[[Column, Column, Column, Column, Column], Column]


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_norm(tf: Column, length: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    share = F.when(avgdl > 0, length / avgdl).otherwise(0.0)
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * share))


def bm25(tf, df, length, n, avgdl) -> Column:
    return F.when(tf > 0, bm25_idf(df, n) * bm25_norm(tf, length, avgdl)).otherwise(0.0)


def tfidf(tf, df, length, n, avgdl) -> Column:
    return F.when((tf > 0) & (df > 0), (1 + F.log(tf.cast("double"))) * F.log(n / df)).otherwise(0.0)


def _constants(index: Index, terms: list[str]) -> tuple[Column, Column, dict[str, int]]:
    """N and avgdl as literals, and the terms' document frequencies."""
    stats = index.corpus_stats.first()
    df = {r["term"]: r["df"] for r in index.term_stats.where(F.col("term").isin(terms)).select("term", "df").collect()} if terms else {}  # the query's terms
    return F.lit(float(stats["n_docs"])), F.lit(float(stats["avgdl"])), df


def score_matches(index: Index, text: str, scorer: Scorer = bm25, mode: str = "intended") -> DataFrame:
    """doc_id, score of every matching document."""
    found = (evaluate if mode == "intended" else evaluate_as_coded)(index, text)
    n, avgdl, df = _constants(index, [t for t, _ in found.terms])
    rows, length = found.rows, F.coalesce("doc_len", F.lit(0))  # without any of the terms the length plays no part
    score = F.lit(0.0)
    for i, ((t, _), w) in enumerate(zip(found.terms, found.weights)):
        if t in df:
            tf = F.col("tf" if found.combined else f"tf_{i}").cast("double")
            score = score + w * scorer(tf, F.lit(float(df[t])), length, n, avgdl)
    return rows.select("doc_id", score.alias("score"))


def blended(scores: DataFrame, pagerank: DataFrame, blend: str = "log", weight: float = 1.0) -> DataFrame:
    """Adds PageRank to the scores: ``weight * log1p(pr)``, or raw. Documents
    without a rank have 0."""
    pr = F.coalesce(F.col("_pr"), F.lit(0.0))
    extra = F.lit(weight) * F.log1p(pr) if blend == "log" else pr
    ranks = pagerank.select("doc_id", F.col("score").alias("_pr"))
    return scores.join(ranks, "doc_id", "left").select("doc_id", (F.col("score") + extra).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """rank, doc_id, score of the k best; none for k <= 0."""
    best = scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(max(0, k))
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")  # k rows


def search(index: Index, text: str, k: int = 10, scorer: Scorer = bm25, mode: str = "intended", pagerank: DataFrame | None = None, blend: str = "log", weight: float = 1.0) -> DataFrame:
    """rank, doc_id, title, score. ``pagerank`` can be the index's own ``ranks``."""
    scores = score_matches(index, text, scorer, mode)
    best = top_k(scores if pagerank is None else blended(scores, pagerank, blend, weight), k)
    return best.join(index.docs.select("doc_id", "title"), "doc_id").select("rank", "doc_id", "title", "score")


def open_result(index: Index, results: DataFrame, n: int) -> DataFrame:
    """rank, doc_id, title, text of the n-th result (from 1); none beyond the last."""
    return results.where(F.col("rank") == n).select("rank", "doc_id").join(index.docs.select("doc_id", "title", "text"), "doc_id").select("rank", "doc_id", "title", "text")


def best_fields(index: Index, text: str, boosts: dict[str, float], k: int = 10) -> DataFrame:
    """rank, doc_id, score: the largest of the fields' boosted BM25 scores, of
    documents with any of the words. Each field has its own df, length and average;
    lengths come with the postings and totals with the corpus."""
    terms = [t for _, t in analyze_text(text, index.config)]
    stats = index.corpus_stats.first()
    n = F.lit(float(stats["n_docs"]))
    hits = index.postings.where(F.col("term").isin(sorted(set(terms)))).select("term", "doc_id", "tf", "titled", "doc_len", "title_len")
    fields = {
        "title": (field_tf("title"), F.col("title_len"), stats["title_total"]),
        "text": (field_tf("text"), F.col("doc_len") - F.col("title_len"), stats["total_len"] - stats["title_total"]),
    }
    df = {r["term"]: r for r in hits.groupBy("term").agg(*[F.count(F.when(tf > 0, 1)).alias(f) for f, (tf, _, _) in fields.items()]).collect()}  # the query's terms
    scores = []
    for f, w in boosts.items():
        tf, length, total = fields[f]
        one = F.lit(0.0)
        for t in dict.fromkeys(terms):
            if t in df and df[t][f]:
                one = F.when(F.col("term") == t, terms.count(t) * bm25(tf.cast("double"), F.lit(float(df[t][f])), length, n, F.lit(float(total)) / n)).otherwise(one)
        scores.append((F.sum(one) * w).alias(f))
    by_doc = hits.groupBy("doc_id").agg(F.lit(0.0).alias("_none"), *scores, F.max(F.greatest(*[fields[f][0] for f in boosts], F.lit(0))).alias("_hits")).where("_hits > 0")
    return top_k(by_doc.select("doc_id", F.greatest("_none", *[F.col(f) for f in boosts]).alias("score")), k)


def query_terms(queries: DataFrame, config: AnalyzerConfig) -> DataFrame:
    """``queries`` (query_id, query) -> query_id, term, weight (how often), n_terms (different
    ones), by the same rules as documents, as columns."""
    text = F.coalesce("query", F.lit(""))
    kept = kept_terms(text, config)
    words = queries.select("query_id", F.explode(normalized(kept, text) if config.nfc else kept).alias("term")).where("term IS NOT NULL")
    if config.stem:
        words = words.select("query_id", stemmed(F.col("term")).alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("weight")).withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def batch_search(index: Index, queries: DataFrame, k: int = 10, scorer: Scorer = bm25, pagerank: DataFrame | None = None, blend: str = "raw") -> DataFrame:
    """queries: query_id, query -> query_id, rank, doc_id, score of flat AND search
    (no operators; dropped words vanish), all in one job: one scan of the postings for
    all queries. Which side of a join is broadcast is Spark's choice by size."""
    wanted = query_terms(queries, index.config).join(index.term_stats.select("term", F.col("df").cast("double").alias("df")), "term")
    hits = index.postings.select("term", "doc_id", F.col("tf").cast("double").alias("tf"), "doc_len")
    scored = hits.join(wanted, "term").join(F.broadcast(index.corpus_stats), F.lit(True))  # one row
    one = F.col("weight") * scorer(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs").cast("double"), F.col("avgdl"))
    by_doc = scored.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"), F.count("*").alias("found"), F.first("n_terms").alias("n_terms")).where("found = n_terms")
    if pagerank is not None:
        pr = F.coalesce(F.col("_pr"), F.lit(0.0))
        by_doc = by_doc.join(pagerank.select("doc_id", F.col("score").alias("_pr")), "doc_id", "left").withColumn("score", F.col("score") + (F.log1p(pr) if blend == "log" else pr))
    by_doc = by_doc.select("query_id", "doc_id", F.round("score", 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return by_doc.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
