"""The corpus pipeline: from raw documents to token blocks in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept;
each result is written as Parquet and read again.  All but the last return the columns
of ``docs``.  Each stage has a defined result for null and empty texts, repeated rows and
empty tables (see the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.llm.common import documents, stored
from trailweave.llm.decontaminate import clean
from trailweave.llm.language import known_language
from trailweave.llm.mixing import mix
from trailweave.llm.similar import similar_dedup
from trailweave.llm.tokens import tokenize


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter and rejected ones go."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word similarity 0.8 or more, the one with the smallest id."""
    return similar_dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``, whole or edited."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mix(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document its place in them."""
    return tokenize(docs, added=True)


STAGES = [
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("decontaminate", benchmark_free),
    ("mix_sources", mixed),
    ("token_blocks", token_blocks),
]
#: Language models, fingerprints, alignment and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
