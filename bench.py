"""Times the headline queries once each, after an index build, and prints one JSON line.

BENCH_SF_DIR: directory of the tables; BENCH_CPUS: local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = "tokenize stopwords build_postings doc_freq corpus_stats segment_roundtrip term_lookup bool_and bool_nested phrase_n bm25_and bm25_or tfidf bm25_best_fields topk snippet_window pagerank eval_summary".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from lexaspark.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the session is warm, the queries are not

    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)

    timed("index_build", lambda: catalog.index_of(spark, sf_dir))
    timed("index_build_pages_and_ranks", lambda: catalog.index_of(spark, sf_dir, "pages"))
    timed("known_items", lambda: catalog.QUERIES["qrels"](spark, sf_dir).count())
    for name in HEADLINE:
        timed(name, lambda: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "documents": docs, "index_docs_per_s": round(docs / seconds["index_build"], 1), "batch_queries_per_s": round(items / seconds["topk"], 1), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
