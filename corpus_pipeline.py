"""The corpus pipeline: five stages over ``documents``, each one of the operators
of ``vitalis.llm``. Every stage's result is written as Parquet and reread as the
next one's documents; all but the last return the columns of ``documents``.

Null and empty texts have no language and go in the first stage. Repeated rows are
judged alike; of a component, repeats included, one row stays in the second. Rows with
a null doc_id are documents like others and never name a component. An empty table
stays empty in every stage. Columns beside doc_id, text, lang and source are carried
along, whatever their names and types.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalis.llm import decontaminate, langid, mixing, simhash, token_shards
from vitalis.llm.common import discard, written
from vitalis.sources.tables import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not recognised."""
    return langid.known_language_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate.clean_only(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix: place, number and checksum of the ids of every
    document, as read back."""
    return token_shards.token_output(docs.select("doc_id", "text"))


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
          ("source_mixing", source_mixing), ("token_ids", token_ids)]

#: Suffix automata, fingerprint components and token ids are beyond SQL; the
#: pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
