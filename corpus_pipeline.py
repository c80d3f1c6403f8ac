"""The corpus pipeline: known languages, no exact or near copies, no benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
``documents``; the last returns pieces. Stages do not depend on one another's intermediate files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from poolwise.llm.common import delete_paths, kept_rows, own_files, staged, table
from poolwise.llm.decontaminate import without_contaminated
from poolwise.llm.exact_dedup import exact_groups
from poolwise.llm.language_id import identified
from poolwise.llm.near_dedup import near_groups
from poolwise.llm.packing import pack
from poolwise.llm.queries import WORD_VOCABULARY
from poolwise.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What the stage before has staged, by application.
_BEFORE: dict[str, list[str]] = {}


def stage(build: Stage) -> Stage:
    """A stage's input has been written and read again, so what its predecessor staged can go."""

    @wraps(build)
    def staged_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        delete_paths(spark, _BEFORE.pop(spark.sparkContext.applicationId, []))
        with own_files(spark) as paths:
            result = build(spark, docs, sf_dir)
        _BEFORE[spark.sparkContext.applicationId] = paths
        return result

    return staged_apart


@stage
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, exact_groups(docs))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, near_groups(docs))


@stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path(WORD_VOCABULARY)).drop("loss_tokens")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

#: The tokenizer and the language models are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, build in STAGES:
        docs = staged(build(spark, docs, sf_dir), name)
    return docs
