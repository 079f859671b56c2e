"""A corpus pipeline: keep documents of a known language, drop copies and near copies, replace personal data, pack.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of their input.
A stage's result has to be written before the next stage over the same input folder begins, because that one
deletes what the stages before it staged. Tables that its own ``docs`` read stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm import exact, language, packing, private, similar
from sluice.llm.queries import WORD_TOKENIZER, ready, surrogate_key
from sluice.llm.shared import leftovers_discarded, recorded, staged

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# folders that finished stages staged, by application and input folder
_left: dict[tuple[str, str], list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """The stage, after deleting the working tables of the stages before it."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        place = (spark.sparkContext.applicationId, sf_dir)
        kept = leftovers_discarded(spark, _left.pop(place, []), docs)
        with recorded() as folders:
            result = stage(spark, docs, sf_dir)
        _left[place] = kept + folders
        return result

    return begun


@tidy
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter or text go."""
    return language.with_language(docs)


@tidy
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.without_copies(docs)


@tidy
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of the n-gram join connect."""
    return similar.without_near_copies(docs)


@tidy
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the text."""
    changed = private.replaced(docs, surrogate_key(spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return changed


@tidy
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed."""
    return packing.packed(docs, WORD_TOKENIZER)


STAGES = [
    ("language", known_language),
    ("exact_copies", without_copies),
    ("near_copies", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
