"""A corpus pipeline of five stages over ``documents``; each takes what its predecessor kept.

1. language identification: documents whose language is not identified go;
2. n-gram Jaccard join: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the
   document with the smallest id stays (one without an id where none has one; rows that share an id are
   documents of their own);
3. substring dedup: spans of 20 or more words that occur earlier are cut out; a text cut wholly goes;
4. mixing: documents in training order, as often as their source's target takes them;
5. packing: one row per piece of a document's tokens in sequences of up to 4096.

All stages but the last return the columns of ``documents``.  After mixing a doc_id may stand twice.

Defined cases: a null or empty text has no language and goes in the first stage, as does one without letters; rows
without an id, repeated ids, ties, very long texts and extra columns are treated as the operators say (see their
docstrings); extra columns pass through all stages but the last; an empty table gives an empty result.

The stages are those of ``latchgraph.llm`` and go with that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latchgraph.llm import op1_jaccard_join, op3_packing, op6_mixing, op7_substring_dedup, op10_language_id
from latchgraph.llm._tables import cut, table
from latchgraph.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op10_language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op1_jaccard_join.keep_rows(docs, shingle=5, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op7_substring_dedup.remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op6_mixing.mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return op3_packing.pack(docs, op3_packing.tokenizer_path())


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language identification and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
