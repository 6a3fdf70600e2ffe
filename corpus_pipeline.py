"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import jaccard_trie, mixing, packing, quality, secrets
from wakeline.llm.staging import drop_unread, dropped, scope, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tokens of a packed sequence.
CAPACITY = 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive fences keep."""
    return quality.keep_good(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    return jaccard_trie.keep_first(docs, n=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials masked."""
    return secrets.mask_live(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target rate, in a global random order."""
    return mixing.mix(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs, capacity=CAPACITY, with_ids=True)


#: Tables that stages have written for themselves.
_tables: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """A stage that first deletes what earlier stages wrote and its documents do not need."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(spark, _tables, docs)
        with scope(_tables):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("n-gram Jaccard join", _tidy(ngram_jaccard_join)),
    ("secret scans", _tidy(secret_scans)),
    ("mixing sources to target weights", _tidy(mixing_to_weights)),
    ("best-fit packing", _tidy(best_fit_packing)),
]

#: Tokenizing and tries are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read by the next, and
    deleted when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
