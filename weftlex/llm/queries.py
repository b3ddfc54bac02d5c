"""The queries of these operators, by name; SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fim, jaccard_join, licences, line_rules, pii, quality, secrets, sessions, sharding, tiling, toxic, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@_query
def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(table(spark, sf_dir, "documents"))


SQL["op9_line_rules"] = line_rules.SQL


@_query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


SQL["op4_secrets"] = secrets.sql()


@_query
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


SQL["op3_licences"] = licences.sql()


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), null_ids=True)


SQL["op7_warc"] = warc.SQL


@_query
def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every user's sessions after each batch, with what it retracts and what retracts it."""
    return sessions.conversation_sessions(table(spark, sf_dir, "conversations"))


SQL["op11_sessions"] = sessions.SQL


@_query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity, with offending spans; learnt from labels that are not held out."""
    return toxic.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at its lines into prefix, middle and suffix, and rebuilt from the result."""
    return fim.digests(table(spark, sf_dir, "documents"))


SQL["op13_fill_in_middle"] = fim.SQL
