"""A corpus pipeline of five stages over documents; each keeps the columns of documents and works on all that its predecessor kept.

1. language: documents whose text has no language the model knows well enough go (no letter, or a posterior under `SURE`).
2. lines: lines of at least 20 characters that at least 3 documents have are kept only where the largest doc_id has them.
3. near_duplicates: of documents linked by word 5-shingles at a similarity of 0.8 or more, the one with the least doc_id stays.
4. decontaminate: documents that hold a benchmark passage, up to edits, go; rows that share a doc_id are decided each by its own text.
5. encode: byte-level BPE ids of each text (n_tokens, ids), and whether they decode to it (exact).

Stages are written as Parquet in the shared folder and read again. Defined cases: all columns of the input stay, whatever their names, but that the last
stage puts its own in the place of n_tokens, ids and exact, and that n_chars is counted anew where lines went. Stage 1 drops null, empty and letterless texts; without any
labelled row it can tell no language and drops all. A null lang or source stays null. Rows with a null doc_id, and rows that repeat one, are rows of their own: each stage decides by their
text (in stage 3 a null doc_id is before all others); of rows that repeat both doc_id and text, stage 3 keeps one. Very long texts go through whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from corpusloom.llm.common import staged
from corpusloom.session import table

#: Least posterior of the predicted language.
SURE = 0.5
#: No SQL: naive Bayes and BPE are not expressed in it; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled rows (a bounded sample of them) and drops rejected documents; lang is kept as it is."""
    return langid.with_known_language(docs, langid.train(docs.select("text", "lang")), SURE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("encode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
