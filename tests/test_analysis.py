import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaspark.functions import analysis as A
from lexaspark.functions.porter2 import stem
from lexaspark.operators import index as I


@pytest.mark.parametrize("text, want", [("Hello, world!", ["Hello", "world"]), ("C++ programming", ["C", "programming"]), ("don't stop", ["don", "t", "stop"]), ("  spaces  ", ["spaces"]), ("123 go", ["123", "go"]), ("", []), ("a_b", ["a", "b"])])
def test_tokens(spark, text, want):
    assert A.tokenize_text(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(A.tokenize(F.col("t"))).first()[0] == want


def test_accents_stay():
    assert len(A.tokenize_text("café résumé")) == 2


@pytest.mark.parametrize("word, want", [("running", "run"), ("dogs", "dog"), ("photosynthesis", "photosynthesi"), ("climate", "climat"), ("change", "chang"), ("pollution", "pollut"), ("jumping", "jump"), ("quick", "quick"), ("generously", "generous"), ("hoping", "hope"), ("hopping", "hop"), ("cries", "cri"), ("ties", "tie"), ("happy", "happi"), ("say", "say"), ("national", "nation"), ("knightly", "knight"), ("skies", "sky"), ("agreed", "agre")])
def test_stems(word, want):
    assert stem(word) == want


def test_analyzer_keeps_gaps():
    assert A.analyze_text("The Running Dogs", A.AnalyzerConfig(stem=True)) == [(1, "run"), (2, "dog")]
    assert A.analyze_text("fish and chips") == [(0, "fish"), (2, "chips")]


TEXTS = ["The Running Dogs", "", "ΑΣ Σ İstanbul", "don't be a café", "각 각 x", "Ångström Ω", "क़लम 12 ١٢", "x\x00y"]


def in_spark(spark, texts, config):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("title", F.lit(""))
    found = {i: [] for i in range(len(texts))}
    for r in I.tokens(I.forward(docs, config), config).collect():
        found[r["doc_id"]].append((r["pos"], r["term"]))
    return [sorted(found[i]) for i in range(len(texts))]


@pytest.mark.parametrize("config", [A.AnalyzerConfig(), A.AnalyzerConfig(stem=True), A.AnalyzerConfig(nfc=False), A.AnalyzerConfig(stopwords=False, stem=True)])
def test_spark_and_python_agree(spark, config):
    assert in_spark(spark, TEXTS, config) == [A.analyze_text(t, config) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF), max_size=60), min_size=1, max_size=30))
def test_spark_and_python_agree_on_latin(spark, texts):
    assert in_spark(spark, texts, A.AnalyzerConfig()) == [A.analyze_text(t) for t in texts]


def test_words_that_are_not_stemmed():
    assert [A.stem_text(w) for w in ("doing", "having", "once", "running", "ones")] == ["doing", "having", "once", "run", "one"]


def test_letters_that_nfc_changes():
    import re
    import unicodedata

    changed = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), A.changed_letters()))
    for c in map(chr, [*range(0x20, 0x3000), *range(0xAC00, 0xAD00), *range(0xF900, 0xFB50), *range(0x2F800, 0x2F820)]):
        if unicodedata.category(c)[0] in "LN" and unicodedata.normalize("NFC", c) != c:
            assert changed.match(c), hex(ord(c))
    assert not changed.search("Привет κόσμε 漢字 한글 שלום")
