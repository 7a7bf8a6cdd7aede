"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the next one works on what
it kept, written as Parquet and read again. All but the last return the columns of
``documents``. Models are fitted on the tables in ``sf_dir``: they are bounded samples
of labelled rows and do not depend on what earlier stages dropped.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import bandwatch  # noqa: E402
from bandwatch.llm import decontaminate, jaccard, language, packing, quality  # noqa: E402
from bandwatch.llm.common import table, written  # noqa: E402
from bandwatch.llm.queries import vocabulary_path  # noqa: E402

# Tasks carry the package's code with them.
cloudpickle.register_pickle_by_value(bandwatch)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learnt from the corpus."""
    every = F.lit(True)
    return language.keep_identified(docs, language.fit(table(spark, sf_dir, "documents"), every))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that labelled neighbours vote to be of quality 1."""
    voters = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, voters)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, and their places in training sequences."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified),
    ("quality", good),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Fingerprints, learnt models and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
