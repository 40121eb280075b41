import inspect

import corpus_pipeline
from llm_rows import SF, docs_of
from pyspark.sql import functions as F
from test_jaccard_and_shards import brute
from test_mixing import brute_queue, size
from test_text_outputs import expected

import __spark_entry__
from lexaspark.llm import decontamination, language_id


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark, documents, tmp_path):
    """Every stage against a brute-force version, on what the stage before has kept."""
    docs, kept = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = (docs.collect(), out.collect())
        if k < 4:
            assert out.columns == documents.columns
        docs = out
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    before, after = kept["language ID"]
    models = language_id.train(documents.where(~language_id.held_out()))
    assert ids(after) == ids([r for r in before if models.predict([r["text"]])[2][0]]) and len(after) > 0.99 * len(before)
    before, after = kept["n-gram Jaccard join"]
    assert ids(after) == sorted({c for _, c, _, _ in brute([(r["doc_id"], r["text"]) for r in before])})
    before, after = kept["benchmark decontamination"]
    found = decontamination.windows([(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    dirty = [r for r in before if any(w in b" " + b" ".join(decontamination.folded(r["text"])) + b" " for w in found)]
    assert dirty and ids(after) == ids([r for r in before if r not in dirty])
    before, after = kept["mixing sources"]
    sizes = {r["doc_id"]: size(r["text"]) for r in before}
    place = {r[0]: r[1] for r in docs_of(spark, [(r["doc_id"], r["text"]) for r in before]).select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text")).collect()}
    taken = brute_queue([(r["doc_id"], r["text"], None, r["source"]) for r in before], place)
    assert ids(after) == sorted(i for i, n in sizes.items() for _ in range((2 * taken[i][0] + n) // (2 * n)))
    before, after = kept["token-ID output"]
    assert sorted(map(tuple, after)) == expected(sorted((r["doc_id"], r["text"]) for r in before))


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    """Nulls, empty and very long texts, repeated rows, clashing columns: every stage keeps the columns and what it must."""
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            rows = out.count()
            assert rows <= 3 * docs.count() and (rows > 0) == (docs is odd)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_no_import_error_is_swallowed():
    assert "except" not in inspect.getsource(corpus_pipeline)
