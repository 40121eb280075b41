"""License scan by a positional rare-token index (DataFrame functions only).

One pass over the texts keeps, for the few documents that hold a licence word,
the places of the words that templates use. Document frequencies of the content
words give their IDF, and a template's word of the highest is looked up first:
only documents that hold such a word go on. Their places meet a template's
postings (word, offset) at ``place - offset``: places that agree on a start belong
to one copy. A start at which the rarest word doesn't stand is none, and a
label needs enough IDF weight and the whole mandatory phrase, word for word.
Templates are phrases and the sentences of licence bodies that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspark.llm import common as C

# Fixed values: (label, words, words of the mandatory phrase).
BASE_TEMPLATES = [
    ("mit", "mit license", "mit license"),
    ("apache", "apache license", "apache license"),
    ("gpl", "general public license", "general public license"),
]
METHOD_TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("artistic", "the artistic license", "artistic license"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "licensed under the isc license", "isc license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published by the free software foundation"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
# Words without weight, which are only verified.
FUNCTION_WORDS = "a and any are by for forms free in into is of or person source the this to under use v version with without 0 1 2 3 4 cc nc sa copy charge terms subject above all anyone arising as at be can code compile conditions copies deal distribute event except fee file following held holder in included including is it its list limitation may merge must name names neither no nor not notice obtain portions prior products program promote publish published purpose restriction retain rights sell shall specific substantial use used will written you list conditions".split()
#: Least share of a template's IDF weight.
MIN_COVERAGE = 0.6


def templates() -> list[tuple[int, str, bool, list[str], range]]:
    """(id, label, base, words, the mandatory places)."""
    out = []
    for base, group in ((True, BASE_TEMPLATES), (False, METHOD_TEMPLATES)):
        for label, words, must in group:
            w, m = words.split(), must.split()
            at = next(i for i in range(len(w)) if w[i : i + len(m)] == m)
            out.append((len(out), label, base, w, range(at, at + len(m))))
    return out


def content_words() -> list[str]:
    """The words that are indexed and weighted; each template has one at least."""
    return sorted({w for _, _, _, words, _ in templates() for w in words} - set(FUNCTION_WORDS))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored):
    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and ``places`` (label, start, coverage of every accepted copy).

    ``score`` is the largest share of IDF weight among the accepted copies, 0
    without any. Null and empty texts have no words: counts 0, null places,
    empty labels. Repeated rows and repeated or null ids each get their own
    row. An empty table gives an empty result. A word's IDF is
    ln(1 + N / (1 + df)) over all rows.
    """
    spark = docs.sparkSession
    content, found = content_words(), templates()
    every = sorted({w for _, _, _, words, _ in found for w in words})
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)  # a superset of A-Z only, for the gate alone
    gate: Column = F.lit(False)
    for stem in [w for w in content if not any(o != w and o in w for o in content)]:
        gate = gate | low.contains(stem)
    words = F.regexp_extract_all(C.ascii_lower(text), F.lit(C.WORD), F.lit(0))
    one = docs.select("doc_id", text.alias("text"), gate.alias("gate")).select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.when(F.col("gate"), F.size(words)).otherwise(F.regexp_count("text", F.lit(C.WORD_ANY_CASE))).cast("long").alias("n_words"),
        F.when(F.col("gate"), F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(every))).alias("hits"),
    )
    base = C.saved(one, "license_words")
    n_docs = base.count()
    held = F.array_distinct(F.transform(F.filter("hits", lambda h: h["word"].isin(content)), lambda h: h["word"]))
    df = {r["word"]: r["df"] for r in base.where(F.size("hits") > 0).select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # at most one row for each content word
    idf = {w: _idf(n_docs, df.get(w, 0)) for w in content}
    postings, rules, rarest = [], [], set()
    for t, label, is_base, ws, must in found:
        anchor = max((i for i in range(len(ws)) if ws[i] in idf), key=lambda i: (idf[ws[i]], -i))
        rarest.add(ws[anchor])
        rules.append((t, label, is_base, len(must), float(sum(idf.get(w, 0.0) for w in ws))))
        postings += [(w, t, i, int(i in must), int(i == anchor), idf.get(w, 0.0)) for i, w in enumerate(ws)]
    post = F.broadcast(spark.createDataFrame(postings, "word string, template int, offset long, must int, anchor int, idf double"))  # constants
    rule = F.broadcast(spark.createDataFrame(rules, "template int, label string, is_base boolean, musts int, weight double"))  # constants
    near = base.where(F.exists("hits", lambda h: h["word"].isin(sorted(rarest))))
    hits = near.select("_row", F.explode("hits").alias("h")).select("_row", F.col("h.pos").cast("long").alias("pos"), F.col("h.word").alias("word"))
    copies = (
        hits.join(post, "word")
        .groupBy("_row", "template", (F.col("pos") - F.col("offset")).alias("start"))
        .agg(F.sum("must").alias("must"), F.max("anchor").alias("anchor"), F.sum("idf").alias("got"))  # an offset meets one place at most
        .where("anchor = 1")
        .join(rule, "template")
        .where("must = musts")
        .withColumn("coverage", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("got") / F.col("weight"))).otherwise(1.0))
        .where(F.col("coverage") >= MIN_COVERAGE)
    )
    per_row = copies.groupBy("_row").agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "label", "coverage"))).alias("places"),
    )
    return base.select("_row", "doc_id", "n_words").join(per_row, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"),
        "places",
    )


def _idf(n: int, df: int) -> float:
    import math

    return math.log(1 + n / (1 + df))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scan_licenses`` of all ``documents``."""
    return scan_licenses(C.table(spark, sf_dir, "documents")).drop("places")


def _values() -> str:
    rows = [f"({t},'{label}',{str(b).lower()},{i},'{w}',{int(i in must)},{len(must)},{str(w not in FUNCTION_WORDS).lower()})" for t, label, b, ws, must in templates() for i, w in enumerate(ws)]
    return ",".join(rows)


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p(t, label, is_base, off, word, must, musts, content) AS (VALUES {_values()}),
u AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
h AS (SELECT * FROM u WHERE word IN (SELECT word FROM p)),
n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT word, count(DISTINCT r) AS df FROM h GROUP BY 1),
i AS (SELECT x.word, CASE WHEN x.content THEN ln(1 + n.n / (1.0 + coalesce(d.df, 0))) ELSE 0 END AS idf, x.content
      FROM (SELECT DISTINCT word, content FROM p) x CROSS JOIN n LEFT JOIN d ON d.word = x.word),
q AS (SELECT p.*, i.idf FROM p JOIN i ON p.word = i.word),
a AS (SELECT t, sum(idf) AS weight, max_by(off, idf * 1000000 - off) FILTER (WHERE content) AS anchor FROM q GROUP BY t),
c AS (SELECT r, q.t, pos - off AS start, any_value(label) AS label, any_value(is_base) AS is_base, any_value(musts) AS musts, any_value(weight) AS weight,
             sum(must) AS must, bool_or(off = anchor) AS anchored, sum(idf) AS got FROM h JOIN q ON h.word = q.word JOIN a ON a.t = q.t GROUP BY r, q.t, pos - off),
k AS (SELECT c.*, least(1.0, got / weight) AS coverage FROM c WHERE anchored AND must = musts AND least(1.0, got / weight) >= {MIN_COVERAGE}),
g AS (SELECT r, count(*) FILTER (WHERE is_base) AS n_base, min(start) FILTER (WHERE is_base) AS first_word,
             max(start) FILTER (WHERE is_base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM k GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CAST(coalesce(score, 0) AS DOUBLE), 9) AS score
FROM w LEFT JOIN g ON g.r = w.r
"""
