"""SQL building blocks of the registered queries' oracles (DuckDB)."""

from __future__ import annotations

from lexaspark.functions.analysis import STOPWORDS, TOKEN
from lexaspark.sources.corpus import PAGE_JUNK

STOP = ",".join(f"'{w}'" for w in STOPWORDS)

DOCUMENTS = "d AS (SELECT doc_id, '' AS title, coalesce(text, '') AS text FROM documents)"
PAGES = rf"""d AS (SELECT page_id AS doc_id, regexp_extract(coalesce(html, ''), '(?s)<title[^>]*>(.*?)</title>', 1) AS title,
  regexp_replace(coalesce(html, ''), '{PAGE_JUNK}', ' ', 'g') AS text, regexp_extract_all(coalesce(html, ''), 'href="/([^"/]*)"', 1) AS links FROM pages)"""

TOKENS = rf"""
w AS (SELECT doc_id, regexp_extract_all(title || ' ' || text, '{TOKEN}') AS ws, len(regexp_extract_all(title, '{TOKEN}')) AS nt FROM d),
u AS (SELECT doc_id, nt, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
t AS (SELECT doc_id, CASE WHEN pos < nt THEN 'title' ELSE 'text' END AS field, pos, lower(nfc_normalize(word)) AS term FROM u),
k AS (SELECT * FROM t WHERE term NOT IN ({STOP}))"""

INDEX = f"""{TOKENS},
p AS (SELECT term, doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM k GROUP BY term, doc_id),
dl AS (SELECT d.doc_id, count(k.term) AS dl FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id),
cs AS (SELECT count(*) AS n, coalesce(sum(dl), 0) AS total, coalesce(avg(dl), 0) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def index(corpus: str = DOCUMENTS) -> str:
    return f"WITH RECURSIVE {corpus}, {INDEX}"


IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"


def norm(tf: str, dl: str = "dl") -> str:
    return f"({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {dl} / avgdl)))"


def scored(terms: list[str], match: str, scorer: str = f"{IDF} * {norm('tf')}") -> str:
    """s(doc_id, score) of the documents whose tf_i satisfy ``match``."""
    each = ", ".join(f"coalesce(max(p.tf) FILTER (WHERE p.term = '{t}'), 0) AS tf_{i}" for i, t in enumerate(terms))
    some = ", ".join(f"'{t}'" for t in terms)
    return f"""
m AS (SELECT doc_id FROM (SELECT doc_id, {each} FROM p WHERE term IN ({some}) GROUP BY doc_id) WHERE {match}),
s AS (SELECT p.doc_id, sum({scorer}) AS score FROM p JOIN m ON m.doc_id = p.doc_id JOIN df ON df.term = p.term JOIN dl ON dl.doc_id = p.doc_id, cs
      WHERE p.term IN ({some}) GROUP BY p.doc_id)"""


def top(k: int = 10, scores: str = "s") -> str:
    return f"""(SELECT CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score
 FROM {scores} ORDER BY round(score, 6) DESC, doc_id LIMIT {k})"""


def postings_of(terms: list[str], field: str | None = None) -> str:
    """a_0, a_1, ...: (doc_id, tf, positions) of each term."""
    where = f" AND field = '{field}'" if field else ""
    return ", ".join(f"a_{i} AS (SELECT doc_id, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM k WHERE term = '{t}'{where} GROUP BY doc_id)" for i, t in enumerate(terms))
