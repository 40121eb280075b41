"""The registered queries over the retrieval engine, and their SQL.

The flat corpus is ``documents``; the fielded and linked one is ``pages``, whose
links are resolved by words of titles (an adaptation: hrefs name words, not whole
titles). An index is built and written once for each session and directory.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspark.functions.analysis import AnalyzerConfig, is_stopword, lowercase, normalized, stems, tokenize
from lexaspark.operators import index as I
from lexaspark.operators import links, metrics, postings, ranking, snippets
from lexaspark.plans import oracle as O
from lexaspark.plans.evaluate import evaluate, evaluate_as_coded
from lexaspark.sources import corpus, export, workspace

CONFIG, STEMMED = AnalyzerConfig(), AnalyzerConfig(stem=True)
AND, OR, NOT = "ha er th", "ha OR er OR th", "er NOT th"
NESTED = '(ha OR th) er NOT (st AND re) "anea eriner"'
PHRASE_2, PHRASE_3 = '"eriner thanea"', '"anea eriner thanea"'
FIELDED = "title:th OR text:ha"
#: As coded: a failed clause is skipped unless it is the first of an OR, and a phrase of three words matches nothing.
NOT_AS_CODED, PHRASE_AS_CODED = "ha OR (er NOT th)", '"eriner thanea" OR "anea eriner thanea"'
SEGMENT_AS_CODED = 'anea OR "eriner thanea"'
STEMMED_AND, STEMMED_PHRASE = "haing erly reingly", '"haed erlying"'
K = 10
#: Tokens by whose hash documents that may hold an item are found, if all items have so many.
KEY_TOKENS = 4

_indexes: dict[tuple, I.Index] = {}
_cases: dict[tuple, DataFrame] = {}


def corpus_of(spark: SparkSession, sf_dir: str, kind: str = "documents") -> DataFrame:
    return (corpus.documents_corpus if kind == "documents" else corpus.pages_corpus)(spark, sf_dir)


def index_of(spark: SparkSession, sf_dir: str, kind: str = "documents", config: AnalyzerConfig = CONFIG) -> I.Index:
    """The written index of a corpus, the linked one with its ranks; built at the first call in an application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, config)
    if key not in _indexes:
        path = workspace.new_path(spark, f"index_{kind}")
        built = I.build_index(corpus_of(spark, sf_dir, kind), config)
        I.write_index(replace(built, ranks=_page_ranks(spark, sf_dir)) if kind == "pages" else built, path)
        _indexes[key] = I.read_index(spark, path)
    return _indexes[key]


def tokens_of(spark: SparkSession, sf_dir: str, kind: str = "documents", config: AnalyzerConfig = CONFIG) -> DataFrame:
    return I.tokens(I.forward(corpus_of(spark, sf_dir, kind), config), config)


def joined(values, sep: str = " "):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


# --- analysis


def q_tokenize(spark, sf):
    return corpus_of(spark, sf).select("doc_id", F.posexplode(tokenize(F.col("text"))).alias("pos", "term"))


def q_lowercase(spark, sf):
    return corpus_of(spark, sf).select(F.explode(F.transform(tokenize(F.col("text")), lowercase)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def q_nfc(spark, sf):
    terms = corpus_of(spark, sf).select(F.explode(normalized(tokenize(F.col("text")), F.col("text"))).alias("term")).where(F.col("term").rlike(r"[^\x00-\x7F]"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def q_stopwords(spark, sf):
    placed = corpus_of(spark, sf).select("doc_id", F.posexplode(F.transform(tokenize(F.col("text")), lowercase)).alias("pos", "term")).where(~is_stopword(F.col("term")))
    return placed.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("pos_sum"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def q_analyze(spark, sf):
    return tokens_of(spark, sf, "pages").select("doc_id", F.when(F.col("in_title"), "title").otherwise("text").alias("field"), "pos", "term")


def q_stem_vocab(spark, sf):
    """Stems of the vocabulary, each word stemmed once."""
    return stems(corpus_of(spark, sf).select(F.explode(F.transform(tokenize(F.col("text")), lowercase)).alias("term")))


def q_analyze_stemmed(spark, sf):
    return tokens_of(spark, sf, config=STEMMED).groupBy("term").agg(F.count("*").alias("n"))


# --- index


def q_build_postings(spark, sf):
    return I.by_field(I.build_postings(tokens_of(spark, sf))).select("term", "field", "doc_id", "tf", joined(F.col("positions")).alias("positions"))


def q_doc_lengths(spark, sf):
    return I.doc_lengths(corpus_of(spark, sf), CONFIG).select("doc_id", F.col("doc_len").cast("long").alias("doc_len"))


def q_doc_freq(spark, sf):
    return I.document_frequencies(tokens_of(spark, sf))


def q_corpus_stats(spark, sf):
    return I.corpus_stats(I.doc_lengths(corpus_of(spark, sf), CONFIG)).drop("title_total")


def q_title_map(spark, sf):
    return I.title_map(corpus_of(spark, sf, "pages"))


def q_segment_roundtrip(spark, sf):
    found = index_of(spark, sf)
    return found.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)).alias("pos_sum"))


def q_posting_bytes(spark, sf):
    return I.posting_bytes(index_of(spark, sf).postings)


def q_term_lookup(spark, sf):
    return I.lookup(index_of(spark, sf), "er").select("doc_id", "tf", joined(F.col("positions")).alias("positions"))


def q_open_doc(spark, sf):
    found = index_of(spark, sf)
    return ranking.search(found, AND, K).join(found.docs.select("doc_id", "text", "doc_len"), "doc_id").select("rank", "doc_id", F.length("text").alias("n_chars"), F.col("doc_len").cast("long").alias("doc_len"))


def q_open_nth(spark, sf):
    found = index_of(spark, sf)
    return ranking.open_result(found, ranking.search(found, AND, K), 3).select("rank", "doc_id", F.length("text").alias("n_chars"))


# --- boolean and phrase retrieval


def _ids(text: str, kind: str = "documents", config: AnalyzerConfig = CONFIG):
    def run(spark, sf):
        return evaluate(index_of(spark, sf, kind, config), text).rows.select("doc_id")

    return run


def _ids_as_coded(text: str, segment: bool = False):
    def run(spark, sf):
        return evaluate_as_coded(index_of(spark, sf), text, segment).rows.select("doc_id", "tf")

    return run


def q_postings_algebra(spark, sf):
    """The same sets by explicit joins: AND, OR and NOT of two lists, with summed tf."""
    found = index_of(spark, sf)
    a, b = I.lookup(found, "er"), I.lookup(found, "th")
    both = [("and", postings.intersect(a, b)), ("or", postings.union(a, b)), ("not", postings.difference(a, b))]
    out = None
    for name, rows in both:
        rows = rows.select(F.lit(name).alias("op"), "doc_id", "tf")
        out = rows if out is None else out.unionByName(rows)
    return out


def q_bool_and_skewed(spark, sf):
    """A rare list with a long one; Spark broadcasts the shorter side if it is small."""
    found = index_of(spark, sf)
    return postings.intersect(I.lookup(found, "eriner"), I.lookup(found, "er"))


def q_phrase_join(spark, sf):
    found = index_of(spark, sf)
    return postings.phrase_intersect(I.lookup(found, "eriner"), I.lookup(found, "thanea"), 1)


# --- ranking


def _ranked(text: str, kind: str = "documents", config: AnalyzerConfig = CONFIG, **how):
    def run(spark, sf):
        return ranking.search(index_of(spark, sf, kind, config), text, K, **how).select("rank", "doc_id", "score")

    return run


def _page_edges(spark, sf):
    pages = corpus_of(spark, sf, "pages")
    named = pages.withColumn("links", F.transform("links", lowercase))
    return pages, links.link_graph(named, links.title_words(pages))


def q_link_graph(spark, sf):
    return _page_edges(spark, sf)[1]


def q_dangling(spark, sf):
    return links.dangling_nodes(*_page_edges(spark, sf))


def _page_ranks(spark, sf):
    return links.pagerank(*_page_edges(spark, sf))


def q_pagerank(spark, sf):
    return _page_ranks(spark, sf).select("doc_id", F.round("score", 9).alias("score"))


def q_title_links(spark, sf):
    """Links that are exact titles; a link to a place without a document goes."""
    return links.linked_titles(corpus.places_corpus(spark, sf))


def q_title_pagerank(spark, sf):
    places = corpus.places_corpus(spark, sf)
    return links.pagerank(places, links.linked_titles(places)).select("doc_id", F.round("score", 9).alias("score"))


def _blended(blend: str):
    def run(spark, sf):
        found = index_of(spark, sf, "pages")
        return ranking.search(found, OR, K, pagerank=found.ranks, blend=blend).select("rank", "doc_id", "score")

    return run


def q_best_fields(spark, sf):
    return ranking.best_fields(index_of(spark, sf, "pages"), "ha er th", {"title": 2.0, "text": 1.0}, K)


def _window(text: str, terms: list[str], config: AnalyzerConfig = CONFIG):
    def run(spark, sf):
        found = index_of(spark, sf, config=config)
        best = ranking.search(found, text, K).join(found.docs.select("doc_id", "text"), "doc_id")
        start = snippets.window_start(F.col("text"), terms, config)
        return best.select("rank", "doc_id", "text", start.cast("int").alias("start")).select("rank", "doc_id", "start", snippets.window_text(F.col("text"), F.col("start")).alias("snippet"))

    return run


q_snippet_window = _window(AND, AND.split())


def q_snippet(spark, sf):
    return q_snippet_window(spark, sf).select("rank", "doc_id", snippets.highlighted(F.col("snippet"), AND.split()).alias("snippet"))


# --- evaluation


def _qrels(spark, sf):
    """Known-item cases: a benchmark item is the query, and relevant are the documents that hold all its
    tokens in a row. Saved once in an application.

    Documents are found by the hash of an item's first tokens among the hashes of all their
    runs of so many, and then compared with the whole item."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _cases:
        items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), tokenize(F.coalesce("text", F.lit(""))).alias("ws"))
        n = min(KEY_TOKENS, items.where(F.size("ws") > 0).agg(F.min(F.size("ws"))).first()[0] or 1)
        hashed = lambda ws, at: F.xxhash64(F.slice(ws, at, F.lit(n)))
        wanted = items.where(F.size("ws") > 0).select("query_id", hashed(F.col("ws"), F.lit(1)).alias("key"), F.array_join("ws", " ").alias("item"))
        docs = corpus_of(spark, sf).select("doc_id", tokenize(F.col("text")).alias("ws"))
        keys = docs.where(F.size("ws") >= n).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - (n - 1)), lambda i: hashed(F.col("ws"), i)))).alias("key"))
        near = workspace.saved(keys.join(wanted, "key").select("doc_id", "query_id", "item"), "qrels_near")
        padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        held = near.join(docs, "doc_id").where(F.contains(padded(F.array_join("ws", " ")), padded(F.col("item")))).select("query_id", F.col("doc_id").cast("string").alias("title"))
        relevant = held.groupBy("query_id").agg(F.sort_array(F.collect_set("title")).alias("relevant"))
        _cases[key] = workspace.saved(items.select("query_id", "query").join(relevant, "query_id", "left").select("query_id", "query", F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant")), "qrels")
    return _cases[key]


def _results(spark, sf, qrels, scorer=ranking.bm25):
    return ranking.batch_search(index_of(spark, sf), qrels, K, scorer).withColumn("title", F.col("doc_id").cast("string"))


def q_topk(spark, sf):
    return ranking.batch_search(index_of(spark, sf), _qrels(spark, sf), K)


def q_qrels(spark, sf):
    return _qrels(spark, sf).select("query_id", "query", F.size("relevant").alias("n_relevant"))


def _metrics(spark, sf, scorer=ranking.bm25):
    qrels = _qrels(spark, sf)
    return metrics.query_metrics(_results(spark, sf, qrels, scorer), qrels, K)


def _metric(name: str):
    def run(spark, sf):
        return _metrics(spark, sf).select("query_id", F.round(name, 9).alias(name))

    return run


def q_eval_summary(spark, sf):
    return metrics.summary(_metrics(spark, sf)).select("cases", *[F.round(c, 9).alias(c) for c in ("precision", "mrr", "ndcg")])


def q_compare_rankers(spark, sf):
    found = metrics.compare(_metrics(spark, sf), _metrics(spark, sf, ranking.tfidf))
    return found.select("query_id", F.round("ndcg_a", 9).alias("ndcg_a"), F.round("ndcg_b", 9).alias("ndcg_b"), "winner")


def q_bulk_ndjson(spark, sf):
    return export.bulk_ndjson(corpus_of(spark, sf)).select("doc_id", "action", "source")


def q_article_url(spark, sf):
    return corpus_of(spark, sf, "pages").select("doc_id", export.article_url(F.col("title")).alias("url"))


QUERIES = {
    "tokenize": q_tokenize,
    "lowercase": q_lowercase,
    "nfc": q_nfc,
    "stopwords": q_stopwords,
    "analyze": q_analyze,
    "stem_vocab": q_stem_vocab,
    "analyze_stemmed": q_analyze_stemmed,
    "build_postings": q_build_postings,
    "doc_lengths": q_doc_lengths,
    "doc_freq": q_doc_freq,
    "corpus_stats": q_corpus_stats,
    "title_map": q_title_map,
    "segment_roundtrip": q_segment_roundtrip,
    "posting_bytes": q_posting_bytes,
    "term_lookup": q_term_lookup,
    "open_doc": q_open_doc,
    "open_nth": q_open_nth,
    "bool_and": _ids(AND),
    "bool_or": _ids(OR),
    "bool_not": _ids(NOT),
    "bool_bare_not": _ids("NOT er"),
    "bool_nested": _ids(NESTED),
    "bool_and_skewed": q_bool_and_skewed,
    "postings_algebra": q_postings_algebra,
    "phrase_2": _ids(PHRASE_2),
    "phrase_n": _ids(PHRASE_3),
    "phrase_join": q_phrase_join,
    "field_scope": _ids(FIELDED, "pages"),
    "phrase_stemmed": _ids(STEMMED_PHRASE, config=STEMMED),
    "bool_not_as_coded": _ids_as_coded(NOT_AS_CODED),
    "phrase_n_as_coded": _ids_as_coded(PHRASE_AS_CODED),
    "phrase_segment_as_coded": _ids_as_coded(SEGMENT_AS_CODED, True),
    "bm25_and": _ranked(AND),
    "bm25_or": _ranked(OR),
    "bm25_and_stemmed": _ranked(STEMMED_AND, config=STEMMED),
    "bm25_as_coded": _ranked(OR, mode="as_coded"),
    "tfidf": _ranked(OR, scorer=ranking.tfidf),
    "link_graph": q_link_graph,
    "dangling_nodes": q_dangling,
    "pagerank": q_pagerank,
    "title_links": q_title_links,
    "title_pagerank": q_title_pagerank,
    "bm25_pagerank": _blended("log"),
    "bm25_pagerank_raw": _blended("raw"),
    "bm25_best_fields": q_best_fields,
    "topk": q_topk,
    "snippet_window": q_snippet_window,
    "snippet_window_stemmed": _window(STEMMED_AND, ["ha", "er", "re"], STEMMED),
    "snippet": q_snippet,
    "qrels": q_qrels,
    "precision_at_k": _metric("precision"),
    "mrr": _metric("mrr"),
    "ndcg_at_k": _metric("ndcg"),
    "eval_summary": q_eval_summary,
    "compare_rankers": q_compare_rankers,
    "bulk_ndjson": q_bulk_ndjson,
    "article_url": q_article_url,
}

# --- SQL

_T = AND.split()
_ALL, _ANY = " AND ".join(f"tf_{i} > 0" for i in range(3)), " OR ".join(f"tf_{i} > 0" for i in range(3))
_WORDS = f"WITH {O.DOCUMENTS}, {O.TOKENS}"
_LISTS = f"{_WORDS}, {O.postings_of(['ha', 'er', 'th', 'st', 're', 'anea', 'eriner', 'thanea'])}"
_PHRASE = "SELECT x.doc_id FROM a_5 x JOIN a_6 y ON x.doc_id = y.doc_id WHERE len(list_intersect(list_transform(x.positions, lambda p: p + 1), y.positions)) > 0"
_NEXT = "SELECT x.doc_id FROM a_6 x JOIN a_7 y ON x.doc_id = y.doc_id WHERE len(list_intersect(list_transform(x.positions, lambda p: p + 1), y.positions)) > 0"
_EDGES = rf"""
tw AS (SELECT lower(unnest(regexp_extract_all(title, '[\p{{L}}\p{{Nd}}]+'))) AS word, doc_id FROM d),
tm AS (SELECT word, max(doc_id) AS doc_id FROM tw GROUP BY word),
li AS (SELECT doc_id AS src, lower(unnest(links)) AS word FROM d),
e AS (SELECT src, tm.doc_id AS dst FROM li JOIN tm ON tm.word = li.word)"""
_TITLES = """
p0 AS (SELECT n_nationkey + 100 AS doc_id, n_name AS title, [r_name, 'Nowhere'] AS links FROM nation JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT doc_id, title, links FROM p0 UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name, list(n_name ORDER BY n_name) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL),
tm AS (SELECT title, max(doc_id) AS doc_id FROM d GROUP BY title),
li AS (SELECT doc_id AS src, unnest(links) AS title FROM d),
e AS (SELECT src, tm.doc_id AS dst FROM li JOIN tm ON tm.title = li.title)"""
_RANKS = """
nn AS (SELECT count(*) AS nodes FROM d),
o AS (SELECT src, count(*) AS out FROM e GROUP BY src),
sh AS (SELECT e.src, e.dst, count(*) / any_value(o.out)::DOUBLE AS share FROM e JOIN o ON o.src = e.src GROUP BY e.src, e.dst),
pr(i, doc_id, score) AS (
  SELECT 0, doc_id, 1.0::DOUBLE / nodes FROM d, nn
  UNION ALL
  SELECT x.i + 1, d.doc_id, 0.15 / nodes + 0.85 * coalesce(x.lost, 0) / nodes + 0.85 * coalesce(g.given, 0)
  FROM d CROSS JOIN nn
  CROSS JOIN (SELECT max(i) AS i, sum(score) FILTER (WHERE pr.doc_id NOT IN (SELECT src FROM o)) AS lost FROM pr) x
  LEFT JOIN (SELECT dst, sum(score * share) AS given FROM pr JOIN sh ON sh.src = pr.doc_id GROUP BY dst) g ON g.dst = d.doc_id
  WHERE x.i < 30),
ranks AS (SELECT doc_id, score FROM pr WHERE i = 30)"""
_PR = f"{_EDGES}, {_RANKS}"
_EVAL = rf"""
it AS (SELECT item_id AS query_id, coalesce(text, '') AS query, regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{Nd}}]+') AS iw FROM benchmark),
ij AS (SELECT query_id, ' ' || array_to_string(iw, ' ') || ' ' AS item FROM it WHERE len(iw) > 0),
wj AS (SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS words FROM w),
rel AS (SELECT query_id, doc_id FROM ij JOIN wj ON contains(words, item)),
qa AS (SELECT query_id, lower(nfc_normalize(unnest(iw))) AS term FROM it),
qt AS (SELECT query_id, term, count(*) AS weight FROM qa WHERE term NOT IN ({O.STOP}) GROUP BY query_id, term),
qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
sc(which, query_id, doc_id, score) AS (
  SELECT 'a', query_id, p.doc_id, round(sum(weight * {O.IDF} * {O.norm('tf')}), 6) FROM qt JOIN p ON p.term = qt.term JOIN df ON df.term = qt.term JOIN dl ON dl.doc_id = p.doc_id JOIN qn USING (query_id), cs
  GROUP BY query_id, p.doc_id, n_terms HAVING count(*) = n_terms
  UNION ALL
  SELECT 'b', query_id, p.doc_id, round(sum(weight * (1 + ln(tf)) * ln(n / df)), 6) FROM qt JOIN p ON p.term = qt.term JOIN df ON df.term = qt.term JOIN qn USING (query_id), cs
  GROUP BY query_id, p.doc_id, n_terms HAVING count(*) = n_terms),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY which, query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {K}),
nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id),
mt AS (SELECT v.which, it.query_id, count(rel.doc_id) / {K}.0 AS precision, coalesce(1.0 / min(rank) FILTER (WHERE rel.doc_id IS NOT NULL), 0) AS mrr,
         CASE WHEN coalesce(any_value(n_rel), 0) = 0 THEN 0 ELSE coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel.doc_id IS NOT NULL), 0)
           / list_sum(list_transform(generate_series(1, least({K}, any_value(n_rel))), lambda i: 1 / log2(i + 1))) END AS ndcg
       FROM it CROSS JOIN (SELECT unnest(['a', 'b']) AS which) v LEFT JOIN rk ON rk.query_id = it.query_id AND rk.which = v.which
       LEFT JOIN rel ON rel.query_id = rk.query_id AND rel.doc_id = rk.doc_id LEFT JOIN nr ON nr.query_id = it.query_id GROUP BY v.which, it.query_id)"""
_FIELDS = rf"""
fp AS (SELECT term, field, doc_id, count(*) AS tf FROM k GROUP BY ALL),
fl AS (SELECT doc_id, field, sum(tf) AS fl FROM fp GROUP BY ALL),
fa AS (SELECT field, sum(fl) / (SELECT count(*) FROM d) AS fa FROM fl GROUP BY field),
fd AS (SELECT term, field, count(*) AS df FROM fp GROUP BY ALL),
fs AS (SELECT fp.doc_id, fp.field, sum({O.IDF} * (fp.tf * 2.2 / (fp.tf + 1.2 * (0.25 + 0.75 * fl / fa)))) AS score
       FROM fp JOIN fd ON fd.term = fp.term AND fd.field = fp.field JOIN fl ON fl.doc_id = fp.doc_id AND fl.field = fp.field JOIN fa ON fa.field = fp.field, cs
       WHERE fp.term IN ('ha', 'er', 'th') GROUP BY fp.doc_id, fp.field),
s AS (SELECT doc_id, max(score * CASE WHEN field = 'title' THEN 2 ELSE 1 END) AS score FROM fs GROUP BY doc_id)"""
# The words of the tables that have the stems of the stemmed queries.
STEMS = {
    "ha": "ha haing haed haedly haingly",
    "er": "er erly erlying erlyed erlyedly erlyingly",
    "re": "re reing reingly",
}
_STEM_OF = "CASE " + " ".join("WHEN term IN (" + ", ".join(f"'{w}'" for w in ws.split()) + f") THEN '{t}'" for t, ws in STEMS.items()) + " ELSE '' END"
_STEMMED = O.index().replace("k AS (SELECT * FROM t", f"k AS (SELECT doc_id, field, pos, {_STEM_OF} AS term FROM t")
_STEM_TOP = f"{_STEMMED}, {O.scored(list(STEMS), ' AND '.join(f'tf_{i} > 0' for i in range(3)))}, b AS {O.top(K)}"


def _window_sql(top: str, words: str) -> str:
    return rf"""{top},
sw AS (SELECT rank, b.doc_id, d.text, regexp_extract_all(d.text, '[\p{{L}}\p{{Nd}}]+') AS ws, regexp_extract_all(d.text, '[\p{{L}}\p{{Nd}}]+[^\p{{L}}\p{{Nd}}]*') AS pieces FROM b JOIN d ON d.doc_id = b.doc_id),
sh AS (SELECT *, list_transform(ws, lambda x: CASE WHEN lower(x) IN ({words}) THEN 1 ELSE 0 END) AS h FROM sw),
sn AS (SELECT *, list_transform(generate_series(1, len(h)), lambda i: coalesce(list_sum(h[i:i + {snippets.window_words() - 1}]), 0)) AS c FROM sh),
ss AS (SELECT *, list_position(c, list_max(c)) - 1 AS start FROM sn),
sz AS (SELECT rank, doc_id, CAST(start AS INTEGER) AS start, regexp_replace(array_to_string(pieces[start + 1:start + {snippets.window_words()}], ''), '[^\p{{L}}\p{{Nd}}]+$', '') AS snippet FROM ss)"""


def _varint_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


_SLUG = "replace(title, ' ', '_')"
_URL = f"url_encode({_SLUG})"
for _form, _path in export.PATH_SAFE.items():
    _URL = f"replace({_URL}, '{_form}', '{_path}')" if _form != "+" else _URL
_JSON = "coalesce(text, '')"
for _c, _escape in [("\\", "\\\\"), ('"', '\\"'), *[(chr(i), {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(i, f"\\u{i:04X}")) for i in range(32)]]:
    _JSON = f"replace({_JSON}, chr({ord(_c)}), '{_escape}')"
_PAGE_SCORES = O.scored(_T, _ANY)
_TOP = f"{O.index()}, {O.scored(_T, _ALL)}, b AS {O.top(K)}"

ORACLE_SQL = {
    "tokenize": f"{_WORDS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, word AS term FROM u",
    "lowercase": f"{_WORDS} SELECT lower(word) AS term, count(*) AS n FROM u GROUP BY 1",
    "nfc": rf"{_WORDS} SELECT nfc_normalize(word) AS term, count(*) AS n FROM u WHERE regexp_matches(word, '[^\x00-\x7F]') GROUP BY 1",
    "stopwords": f"{_WORDS} SELECT doc_id, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(min(pos) AS INTEGER) AS first_pos, CAST(max(pos) AS INTEGER) AS last_pos FROM k GROUP BY doc_id",
    "analyze": f"WITH {O.PAGES}, {O.TOKENS} SELECT doc_id, field, CAST(pos AS INTEGER) AS pos, term FROM k",
    "build_postings": f"{_WORDS} SELECT term, field, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM k GROUP BY term, field, doc_id",
    "doc_lengths": f"{O.index()} SELECT doc_id, dl AS doc_len FROM dl",
    "doc_freq": f"{O.index()} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM p GROUP BY term",
    "corpus_stats": f"{O.index()} SELECT n AS n_docs, CAST(total AS BIGINT) AS total_len, avgdl FROM cs",
    "title_map": f"WITH {O.PAGES} SELECT title, max(doc_id) AS doc_id FROM d GROUP BY title",
    "segment_roundtrip": f"{_WORDS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, CAST(sum(pos) AS BIGINT) AS pos_sum FROM k GROUP BY term",
    "posting_bytes": f"{O.index()}, gp AS (SELECT term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap, tf FROM p), bt AS (SELECT term, count(*) AS n, sum({_varint_sql('gap')} + {_varint_sql('tf')}) AS b FROM gp GROUP BY term) SELECT CAST(sum(n) AS BIGINT) AS postings, CAST(sum(b + {_varint_sql('n')}) AS BIGINT) AS bytes, round(sum(b + {_varint_sql('n')}) / CAST(sum(n) AS DOUBLE), 6) AS bytes_per_posting FROM bt",
    "term_lookup": f"{_WORDS} SELECT doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions FROM k WHERE term = 'er' GROUP BY doc_id",
    "open_doc": f"{_TOP} SELECT rank, b.doc_id, CAST(length(d.text) AS INTEGER) AS n_chars, dl AS doc_len FROM b JOIN d ON d.doc_id = b.doc_id JOIN dl ON dl.doc_id = b.doc_id",
    "bool_and": f"{_LISTS} SELECT doc_id FROM a_0 INTERSECT SELECT doc_id FROM a_1 INTERSECT SELECT doc_id FROM a_2",
    "bool_or": f"{_LISTS} SELECT doc_id FROM a_0 UNION SELECT doc_id FROM a_1 UNION SELECT doc_id FROM a_2",
    "bool_not": f"{_LISTS} SELECT doc_id FROM a_1 EXCEPT SELECT doc_id FROM a_2",
    "bool_bare_not": f"{_LISTS} SELECT doc_id FROM d EXCEPT SELECT doc_id FROM a_1",
    "bool_nested": f"{_LISTS} SELECT doc_id FROM a_1 WHERE doc_id IN (SELECT doc_id FROM a_0 UNION SELECT doc_id FROM a_2) AND doc_id NOT IN (SELECT a_3.doc_id FROM a_3 JOIN a_4 ON a_3.doc_id = a_4.doc_id) AND doc_id IN ({_PHRASE})",
    "bool_and_skewed": f"{_LISTS} SELECT a_6.doc_id, a_6.tf + a_1.tf AS tf FROM a_6 JOIN a_1 ON a_6.doc_id = a_1.doc_id",
    "postings_algebra": f"{_LISTS} SELECT 'and' AS op, a_1.doc_id, a_1.tf + a_2.tf AS tf FROM a_1 JOIN a_2 ON a_1.doc_id = a_2.doc_id UNION ALL SELECT 'or', doc_id, CAST(sum(tf) AS BIGINT) FROM (SELECT doc_id, tf FROM a_1 UNION ALL SELECT doc_id, tf FROM a_2) GROUP BY doc_id UNION ALL SELECT 'not', doc_id, tf FROM a_1 WHERE doc_id NOT IN (SELECT doc_id FROM a_2)",
    "phrase_2": f"{_LISTS} {_NEXT}",
    "phrase_n": f"{_LISTS} SELECT x.doc_id FROM a_5 x JOIN a_6 y ON x.doc_id = y.doc_id JOIN a_7 z ON x.doc_id = z.doc_id WHERE len(list_intersect(list_intersect(list_transform(x.positions, lambda p: p + 1), y.positions), list_transform(z.positions, lambda p: p - 1))) > 0",
    "phrase_join": f"{_LISTS} SELECT doc_id, CAST(1 AS BIGINT) AS tf FROM ({_NEXT})",
    "field_scope": f"WITH {O.PAGES}, {O.TOKENS} SELECT DISTINCT doc_id FROM k WHERE (term = 'th' AND field = 'title') OR (term = 'ha' AND field = 'text')",
    "bool_not_as_coded": f"{_LISTS} SELECT doc_id, tf FROM a_0",
    "phrase_n_as_coded": f"{_LISTS} SELECT doc_id, CAST(1 AS BIGINT) AS tf FROM ({_NEXT})",
    "phrase_segment_as_coded": f"{_LISTS} SELECT doc_id, tf FROM a_5",
    "phrase_stemmed": f"{_STEMMED} SELECT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term = 'ha' AND y.term = 'er' WHERE len(list_intersect(list_transform(x.positions, lambda q: q + 1), y.positions)) > 0",
    "bm25_and_stemmed": f"{_STEM_TOP} SELECT * FROM b",
    "title_links": f"WITH {_TITLES} SELECT src, dst FROM e",
    "title_pagerank": f"WITH RECURSIVE {_TITLES}, {_RANKS} SELECT doc_id, round(score, 9) AS score FROM ranks",
    "open_nth": f"{_TOP} SELECT rank, b.doc_id, CAST(length(d.text) AS INTEGER) AS n_chars FROM b JOIN d ON d.doc_id = b.doc_id WHERE rank = 3",
    "bm25_and": f"{O.index()}, {O.scored(_T, _ALL)} SELECT * FROM {O.top(K)}",
    "bm25_or": f"{O.index()}, {O.scored(_T, _ANY)} SELECT * FROM {O.top(K)}",
    "bm25_as_coded": f"{O.index()}, c AS (SELECT doc_id, sum(tf) AS ctf FROM p WHERE term IN ('ha', 'er', 'th') GROUP BY doc_id), i AS (SELECT sum({O.IDF}) AS idf FROM df, cs WHERE term IN ('ha', 'er', 'th')), s AS (SELECT c.doc_id, idf * {O.norm('ctf')} AS score FROM c JOIN dl ON dl.doc_id = c.doc_id, i, cs) SELECT * FROM {O.top(K)}",
    "tfidf": f"{O.index()}, {O.scored(_T, _ANY, '(1 + ln(tf)) * ln(n / df)')} SELECT * FROM {O.top(K)}",
    "link_graph": f"WITH {O.PAGES}, {_EDGES} SELECT src, dst FROM e",
    "dangling_nodes": f"WITH {O.PAGES}, {_EDGES} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT src FROM e)",
    "pagerank": f"WITH RECURSIVE {O.PAGES}, {_PR} SELECT doc_id, round(score, 9) AS score FROM ranks",
    "bm25_pagerank": f"{O.index(O.PAGES)}, {_PR}, {_PAGE_SCORES}, z AS (SELECT s.doc_id, s.score + ln(1 + ranks.score) AS score FROM s JOIN ranks ON ranks.doc_id = s.doc_id) SELECT * FROM {O.top(K, 'z')}",
    "bm25_pagerank_raw": f"{O.index(O.PAGES)}, {_PR}, {_PAGE_SCORES}, z AS (SELECT s.doc_id, s.score + ranks.score AS score FROM s JOIN ranks ON ranks.doc_id = s.doc_id) SELECT * FROM {O.top(K, 'z')}",
    "bm25_best_fields": f"{O.index(O.PAGES)}, {_FIELDS} SELECT * FROM {O.top(K)}",
    "topk": f"{O.index()}, {_EVAL} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk WHERE which = 'a'",
    "snippet_window": f"{_window_sql(_TOP, ', '.join(repr(t) for t in _T))} SELECT * FROM sz",
    "snippet_window_stemmed": f"{_window_sql(_STEM_TOP, ', '.join(repr(w) for ws in STEMS.values() for w in ws.split()))} SELECT * FROM sz",
    "snippet": f"{_window_sql(_TOP, ', '.join(repr(t) for t in _T))} SELECT rank, doc_id, replace(replace(regexp_replace(snippet, '(?i)({'|'.join(sorted(_T, key=lambda t: (-len(t), t)))})', '<1>\\1<0>', 'g'), '<1>', chr(27) || '[1m'), '<0>', chr(27) || '[0m') AS snippet FROM sz",
    "qrels": f"{O.index()}, {_EVAL} SELECT query_id, query, CAST(coalesce(n_rel, 0) AS INTEGER) AS n_relevant FROM it LEFT JOIN nr USING (query_id)",
    "precision_at_k": f"{O.index()}, {_EVAL} SELECT query_id, CAST(round(precision, 9) AS DOUBLE) AS precision FROM mt WHERE which = 'a'",
    "mrr": f"{O.index()}, {_EVAL} SELECT query_id, CAST(round(mrr, 9) AS DOUBLE) AS mrr FROM mt WHERE which = 'a'",
    "ndcg_at_k": f"{O.index()}, {_EVAL} SELECT query_id, CAST(round(ndcg, 9) AS DOUBLE) AS ndcg FROM mt WHERE which = 'a'",
    "eval_summary": f"{O.index()}, {_EVAL} SELECT count(*) AS cases, round(CAST(avg(precision) AS DOUBLE), 9) AS precision, round(CAST(avg(mrr) AS DOUBLE), 9) AS mrr, round(CAST(avg(ndcg) AS DOUBLE), 9) AS ndcg FROM mt WHERE which = 'a'",
    "compare_rankers": f"{O.index()}, {_EVAL} SELECT a.query_id, CAST(round(a.ndcg, 9) AS DOUBLE) AS ndcg_a, CAST(round(b.ndcg, 9) AS DOUBLE) AS ndcg_b, CASE WHEN a.ndcg - b.ndcg > 0.01 THEN 'a' WHEN a.ndcg - b.ndcg < -0.01 THEN 'b' ELSE 'tie' END AS winner FROM mt a JOIN mt b ON a.query_id = b.query_id AND a.which = 'a' AND b.which = 'b'",
    "bulk_ndjson": f"""SELECT doc_id, '{{"index":{{"_id":"' || doc_id || '"}}}}' AS action, '{{"text":"' || {_JSON} || '","title":""}}' AS source FROM documents""",
    "article_url": f"WITH {O.PAGES} SELECT doc_id, 'https://example.org/wiki/' || {_URL} AS url FROM d",
}
