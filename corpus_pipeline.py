"""The corpus pipeline: documents through five operators, each stage on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever they are.

Defined cases, in every stage: null and empty texts are rejected by the quality rules, and are texts without words to each later stage
on its own; a null doc_id, source or lang is a value like any other; ties are broken by the text's hash, then the row's; repeated rows are
one class of copies; a very long text is handled whole; an empty table stays empty; extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sellerlens.llm.common import run_folder, scratch, table
from sellerlens.llm.op02_quality_rules import keep_good
from sellerlens.llm.op04_token_output import token_output
from sellerlens.llm.op05_token_counts import TOKENIZER, tokenizer_path
from sellerlens.llm.op06_ngram_join import one_of_each
from sellerlens.llm.op09_mixing import mixed
from sellerlens.llm.op10_decontamination import without_leaks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and their host's verdict accept."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document as often as it is taken."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids and returns one row per document of the files."""
    return token_output(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: The joins on MinHash, spaced seeds and the tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder, and its intermediate ones go."""
    folder = run_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
