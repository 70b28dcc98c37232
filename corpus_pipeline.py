"""The corpus pipeline: quality, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows to the shared
folder and hands them to the next. Classifiers learn from the labelled rows of the documents in ``sf_dir``; a
stage decides on all rows of its input, whatever their columns, and repeated or null ids are rows like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pricelens.llm import quality, toxicity
from pricelens.llm.common import materialize, table
from pricelens.llm.exact_dedup import drop_copies
from pricelens.llm.near_copies import drop_similar
from pricelens.llm.packing import pack


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("exact copies", one_of_copies), ("near copies", one_of_near_copies), ("packing", packed)]

#: The classifiers and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
