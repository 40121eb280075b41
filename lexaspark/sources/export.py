"""Exports: bulk NDJSON and article addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that a path segment keeps and form encoding does not, and its space.
PATH_SAFE = {"+": "%20", "%24": "$", "%26": "&", "%2B": "+", "%3A": ":", "%3D": "=", "%40": "@", "%7E": "~"}


def bulk_ndjson(docs: DataFrame) -> DataFrame:
    """doc_id, action, source: the two lines of every document."""
    action = F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("_id")).alias("index")))
    return docs.select("doc_id", action.alias("action"), F.to_json(F.struct("text", "title")).alias("source"))


def write_bulk(docs: DataFrame, path: str) -> None:
    """Text files in which each document's two lines stand together."""
    bulk_ndjson(docs).select(F.concat_ws("\n", "action", "source").alias("value")).write.text(path)


def article_url(title: Column, prefix: str = "https://example.org/wiki/") -> Column:
    """Spaces become underscores; the rest is escaped as a path segment."""
    slug = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for form, path in PATH_SAFE.items():
        slug = F.replace(slug, F.lit(form), F.lit(path))
    return F.concat(F.lit(prefix), F.replace(slug, F.lit("*"), F.lit("%2A")))
