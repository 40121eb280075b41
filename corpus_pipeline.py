"""From raw documents to token blocks, in five stages.

Every stage gets what its predecessor kept, written as Parquet and read again,
so a lost executor repeats one stage's tasks and not the chain. Extra columns of
any name are carried along until the last stage; an empty table stays empty in
every stage, and an empty table of tokens comes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexaspark.llm import common, decontamination, jaccard_join, language_id, mixing, token_output


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: null, empty and letterless texts, and those that
    no model of a language expects. Repeated rows are judged alike."""
    return language_id.accepted_documents(docs, language_id.train(docs.where(~language_id.held_out())))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; of repeated
    rows one. Texts without words stay."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts, and without items all, stay."""
    return decontamination.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; repeated rows share their copies, rows without
    words are kept once, and a null source is a source."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of the mix, and one row per row read back from them; null and empty texts are the end
    alone, rows without an id come first."""
    return token_output.token_output(docs)


STAGES = [
    ("language ID", identify_languages),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token-ID output", write_tokens),
]

#: SQL expresses neither the character models nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``: doc_id, start, n_tokens, ids_crc32 of every row of the mix."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.saved(docs, "stage")
    return docs
