"""The training-text pipeline: rules, near duplicates, decontamination, mix, token files.

Each stage reads what its predecessor wrote and works on all of it. Tables that a stage
writes for itself belong to it and are deleted when the next stage starts, which is when
its result has been written; but for those that the next stage's rows still read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import decontaminate, jaccard, mixing, rules, tokenfiles
from emberlog.sources.tables import Written, land

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Tables of the stage that ran last.
_LAST: list[Written] = []


def owning(stage: Stage) -> Stage:
    """The stage with its own tables: those of the stage before it are deleted first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LAST:
            last = _LAST.pop()
            if last.spark is spark:
                last.drop(still_read=docs)
        own = Written(spark)
        _LAST.append(own)
        with own:
            return stage(spark, docs, sf_dir)

    return run_stage


@owning
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs keep."""
    return rules.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@owning
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard.one_of_each(docs)


@owning
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@owning
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.mix(docs)


@owning
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of every document of the mix, from the token files written and read back."""
    import public_tokenizers

    return tokenfiles.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("token_files", token_files),
]

# The last stage runs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
