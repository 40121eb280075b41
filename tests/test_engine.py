import bz2
import gzip
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lexaspark.functions.analysis import AnalyzerConfig
from lexaspark.operators import index as I
from lexaspark.operators import external, links, metrics, ranking, snippets
from lexaspark.sources import corpus, export, workspace
from lexaspark.plans import catalog
from lexaspark.streaming import incremental

ARTICLES = [(0, "Photosynthesis", "photosynthesis is a process used by plants"), (1, "Plant", "a plant is a living thing that uses photosynthesis"), (2, "Animal", "an animal is a living thing that cannot do photosynthesis")]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("links", F.array().cast("array<string>"))


def test_build_and_round_trip(spark, tmp_path):
    built = I.build_index(docs_of(spark, ARTICLES), AnalyzerConfig(stem=True))
    I.write_index(built, str(tmp_path / "index"))
    read = I.read_index(spark, str(tmp_path / "index"))
    assert read.config == built.config
    assert read.term_stats.where("term = 'photosynthesi'").first()["df"] == 3
    for table in ("postings", "term_stats", "corpus_stats"):
        rows = [sorted(map(str, getattr(i, table).collect())) for i in (built, read)]
        assert rows[0] == rows[1]
    assert read.corpus_stats.first()["n_docs"] == 3


def test_ranks_are_kept_with_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(I.build_index(docs_of(spark, ARTICLES)), path)
    assert I.read_index(spark, path).ranks is None
    I.write_ranks(spark.createDataFrame([(2, 5.0)], "doc_id long, score double"), path)
    index = I.read_index(spark, path)
    assert [tuple(r) for r in index.ranks.collect()] == [(2, 5.0)]
    assert ranking.search(index, "living", 1, pagerank=index.ranks).first()["doc_id"] == 2
    spark.createDataFrame([(1,)], "other int").write.mode("overwrite").parquet(f"{path}/ranks")
    with pytest.warns(UserWarning, match="can't be read"):
        assert I.read_index(spark, path).ranks is None


def test_fields_and_letters_that_nfc_changes(spark):
    """Fields from one posting, a term in both; Kelvin, Ohm and Hangul letters beside documents without any."""
    rows = [(0, "wind and wind", "the wind of \u212belsinki"), (1, "", "\u1112\u1161\u11ab \u2126"), (2, "plain", "wind")]
    index = I.build_index(docs_of(spark, rows))
    got = {(r["term"], r["field"], r["doc_id"]): (r["tf"], r["positions"]) for r in I.by_field(index.postings).collect()}
    assert got["wind", "title", 0] == (2, [0, 2]) and got["wind", "text", 0] == (1, [4]) and got["wind", "text", 2] == (1, [1])
    assert ("\u00e5elsinki", "text", 0) in got and ("\ud55c", "text", 1) in got and ("\u03c9", "text", 1) in got
    lengths = {r["doc_id"]: (r["doc_len"], r["title_len"]) for r in index.docs.collect()}
    assert lengths == {0: (4, 2), 1: (2, 0), 2: (2, 1)}


def test_stems_of_documents_and_queries_agree(spark):
    index = I.build_index(docs_of(spark, [(0, "", "Running dogs had been quickly running"), (1, "", "a dog ran")]), AnalyzerConfig(stem=True))
    at = {r["term"]: r["positions"] for r in index.postings.where("doc_id = 0").collect()}
    assert at == {"run": [0, 5], "dog": [1], "been": [3], "quick": [4]}  # a word of the stemmer's own list stays
    assert sorted(r["doc_id"] for r in ranking.search(index, "dogs").collect()) == [0, 1]
    queries = spark.createDataFrame([(7, "the running DOG"), (8, None), (9, "unknown dogs")], "query_id long, query string")
    assert [(r["query_id"], r["doc_id"]) for r in ranking.batch_search(index, queries).collect()] == [(7, 0)]


def test_nth_result(spark):
    index = I.build_index(docs_of(spark, ARTICLES))
    found = ranking.search(index, "photosynthesis")
    assert ranking.open_result(index, found, 2).first()["doc_id"] == [r["doc_id"] for r in found.orderBy("rank").collect()][1]
    assert ranking.open_result(index, found, 9).count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session)


def test_empty_documents_count(spark):
    stats = I.build_index(docs_of(spark, [(0, "", ""), (1, "", "the"), (2, "x", "y z")])).corpus_stats.first()
    assert (stats["n_docs"], stats["total_len"]) == (3, 3)
    none = I.build_index(docs_of(spark, []))
    assert none.corpus_stats.first()["avgdl"] == 0 and none.postings.count() == 0


def test_dump(spark, tmp_path):
    lines = []
    for title, link in (("Photosynthesis", "Plant"), ("Plant", "Photosynthesis")):
        lines += [json.dumps({"index": {"_id": title}}), json.dumps({"title": title, "text": f"About {title}.", "outgoing_link": [link], "more": 1})]
    with gzip.open(tmp_path / "dump.json.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    rows = corpus.read_dump(spark, str(tmp_path / "dump.json.gz")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["links"]) for r in rows] == [(0, "Photosynthesis", ["Plant"]), (1, "Plant", ["Photosynthesis"])]
    (tmp_path / "bad.json").write_text("{}\n{}\n{}\nnot json\n")
    with pytest.raises(Exception, match="line 4 is not a JSON article"):
        corpus.read_dump(spark, str(tmp_path / "bad.json")).collect()


def test_dump_in_splits(spark, tmp_path):
    """Plain and bzip2 files, read in many splits, and several files of one dump; ids count on."""
    articles = [json.dumps({"title": f"T{i}", "text": "word " * (i % 7)}) for i in range(3000)]
    whole = "".join(f"{{}}\n{a}\n" for a in articles)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.json").write_text(whole)
    (tmp_path / "plain/b.json").write_text("{}\n" + json.dumps({"title": "last"}) + "\n")
    (tmp_path / "dump.json.bz2").write_bytes(bz2.compress(whole.encode(), 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r["doc_id"]: r["title"] for r in corpus.read_dump(spark, str(tmp_path / "plain")).collect()}
        packed = {r["doc_id"]: r["title"] for r in corpus.read_dump(spark, str(tmp_path / "dump.json.bz2")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {i: f"T{i}" for i in range(3000)} | {3000: "last"}
    assert packed == {i: f"T{i}" for i in range(3000)}


def test_qrels(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"query": "a b", "relevant": ["A"]}, {"query": "c"}]))
    assert [tuple(r) for r in corpus.read_qrels(spark, str(tmp_path / "q.json")).orderBy("query_id").collect()] == [(0, "a b", ["A"]), (1, "c", [])]


@pytest.mark.parametrize("tf, df, length, want", [(3, 50, 50, 5.256735), (1, 10, 100, 4.557380), (5, 10, 100, 8.085673), (2, 10, 50, 7.291807), (2, 10, 200, 4.890846), (2, 5, 100, 7.155509), (2, 500, 100, 0.953077)])
def test_bm25(spark, tf, df, length, want):
    got = spark.range(1).select(ranking.bm25(*(F.lit(float(x)) for x in (tf, df, length, 1000, 100)))).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_an_external_ranker_finds_the_same(spark):
    if not external.available():
        pytest.skip("SQLite without FTS5")
    found = external.fts5_search(ARTICLES, ["living AND photosynthesis", "process", '"', "nothing"])
    assert sorted(found[0]) == [1, 2] and found[1] == [0] and found[2] == found[3] == []
    index = I.build_index(docs_of(spark, ARTICLES))
    assert sorted(r["doc_id"] for r in ranking.search(index, "living AND photosynthesis").collect()) == sorted(found[0])


def test_tfidf(spark):
    score = lambda tf, df: spark.range(1).select(ranking.tfidf(*(F.lit(float(x)) for x in (tf, df, 50, 1000, 100)))).first()[0]
    assert score(3, 50) == pytest.approx(6.286881, abs=1e-6) and score(0, 50) == 0


def test_search(spark):
    index = I.build_index(docs_of(spark, ARTICLES))
    rows = ranking.search(index, "living photosynthesis", 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 2] and rows[0]["rank"] == 1
    assert ranking.search(index, "photosynthesis", 0).count() == 0
    assert ranking.search(index, "nothing", 5).count() == 0
    assert ranking.search(index, "the", 5).count() == 0
    pr = spark.createDataFrame([(2, 5.0)], "doc_id long, score double")
    assert ranking.search(index, "living", 1, pagerank=pr).first()["doc_id"] == 2


@pytest.mark.parametrize("edges, n, want", [([(0, 1), (0, 2), (1, 2)], 3, [0.197579649, 0.281551, 0.52086935]), ([(0, 1)], 2, [0.350877193, 0.649122807]), ([(0, 1), (1, 0), (2, 0), (2, 1)], 3, [0.475, 0.475, 0.05]), ([(0, 1), (0, 9), (1, 0)], 2, None)])
def test_pagerank(spark, edges, n, want):
    nodes = spark.range(n).withColumnRenamed("id", "doc_id")
    rows = links.pagerank(nodes, spark.createDataFrame(edges, "src long, dst long")).orderBy("doc_id").collect()
    if want is None:  # a link to an unknown node takes its share and gives it to none
        assert sum(r["score"] for r in rows) < 0.9 and rows[0]["score"] > rows[1]["score"]
        return
    assert [r["score"] for r in rows] == pytest.approx(want, abs=1e-8)


def test_links(spark):
    docs = spark.createDataFrame([(0, "A", ["B", "B", "X"]), (1, "B", ["A"]), (2, "A", [])], "doc_id long, title string, links array<string>")
    edges = links.link_graph(docs, I.title_map(docs))
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (0, 1), (1, 2)]
    assert [r["doc_id"] for r in links.dangling_nodes(docs, edges).collect()] == [2]


def test_metrics(spark):
    results = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate("ABCDE")] + [(1, i + 1, t) for i, t in enumerate("XAB")], "query_id long, rank int, title string")
    qrels = spark.createDataFrame([(0, "q", list("ACE")), (1, "q", list("AB")), (2, "q", ["Z"]), (3, "q", [])], "query_id long, query string, relevant array<string>")
    five = {r["query_id"]: r for r in metrics.query_metrics(results, qrels, 5).collect()}
    three = {r["query_id"]: r for r in metrics.query_metrics(results, qrels, 3).collect()}
    assert five[0]["precision"] == pytest.approx(0.6) and five[0]["mrr"] == 1 and five[1]["mrr"] == 0.5
    assert three[1]["ndcg"] == pytest.approx(0.693426, abs=1e-6)
    assert five[2]["ndcg"] == five[3]["ndcg"] == five[2]["precision"] == 0
    total = metrics.summary(metrics.query_metrics(results, qrels, 5)).first()
    assert total["cases"] == 4 and total["mrr"] == pytest.approx((1 + 0.5) / 4)
    won = metrics.compare(metrics.query_metrics(results, qrels, 3), metrics.query_metrics(results, qrels, 3))
    assert {r["winner"] for r in won.collect()} == {"tie"}


def test_snippets(spark):
    text = "Plants are green. " + "x " * 40 + "They use photosynthesis, all day; plants do photosynthesis. End."
    row = spark.createDataFrame([(text,), ("",), ("short photosynthesis",)], "t string")
    start = snippets.window_start(F.col("t"), ["photosynthesis"], characters=30)
    got = [r[0] for r in row.select(snippets.highlighted(snippets.window_text(F.col("t"), start, 30), ["photosynthesis"])).collect()]
    assert got[0].count(snippets.BOLD) == 1 and got[1] == "" and "\x1b[1mphotosynthesis\x1b[0m" in got[2]


def test_exports(spark):
    docs = docs_of(spark, [(7, "A & B", 'say "hi"\n')])
    r = export.bulk_ndjson(docs).first()
    assert json.loads(r["action"]) == {"index": {"_id": "7"}} and json.loads(r["source"]) == {"title": "A & B", "text": 'say "hi"\n'}
    url = docs.select(export.article_url(F.lit("C++ a/b é?"))).first()[0]
    assert url.endswith("/C++_a%2Fb_%C3%A9%3F")


def test_stream(spark, tmp_path):
    rows = docs_of(spark, ARTICLES)
    rows.where("doc_id < 2").write.parquet(str(tmp_path / "in"))
    go = lambda: incremental.index_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ix")).awaitTermination(60)
    go()
    rows.where("doc_id = 2").write.mode("append").parquet(str(tmp_path / "in"))
    go()
    index = incremental.read_segments(spark, str(tmp_path / "ix"))
    assert index.corpus_stats.first()["n_docs"] == 3
    whole = I.build_index(rows)
    for q in ("photosynthesis", "living thing"):
        assert sorted(map(tuple, ranking.search(index, q).collect())) == sorted(map(tuple, ranking.search(whole, q).collect()))
    assert incremental.unseen(rows, index).count() == 0
    assert not math.isnan(index.corpus_stats.first()["avgdl"])


def test_bulk_export_has_every_document(spark, tmp_path):
    texts = ["plain", "tab\there", "a\r\nb", "\x01\x0b\x7f\x85", "line\u2028and\u2029", 'q"\\', None, "\x00", "\b\f\x1f"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["action"], r["source"]) for r in catalog.QUERIES["bulk_ndjson"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {i: (a, s) for i, a, s in con.sql(catalog.ORACLE_SQL["bulk_ndjson"]).fetchall()} and len(got) == len(texts)
    for i, text in enumerate(texts):
        assert json.loads(got[i][1]) == {"text": text or "", "title": ""} and not set("\n\r") & set(got[i][1])
