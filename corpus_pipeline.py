"""A training corpus from raw documents: language ID, exact and near dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and hands the next stage what it reads back.

Defined results for the unusual, of every stage but the last the columns of documents and no others:

* an empty table stays empty through all stages; texts of any length are read whole;
* a null, empty or letterless text is rejected by language_id, as no language can be found in it;
* rows with a null id: exact_dedup keeps the one of an equal text only where no row with an id has that text;
  near_dedup links them with nothing, so they stay; mix_sources hashes their id as the empty string;
* a null source is a source of its own with the weight of unlisted sources; a null lang is learned from by none;
* rows that repeat id and text are one row after exact_dedup; rows that repeat an id with different texts all stay
  until near_dedup, where they are one document of that id;
* columns beyond those of documents, whatever their names, are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, exact_dedup, langid, mixing, near_dedup
from strandline.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a probability of a half or more; what fits no labelled language goes."""
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the document with the smallest id."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near duplicates."""
    return near_dedup.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in a global random order; no source is left out."""
    mixed = mixing.mix_sources(docs, mixing.production_weights(), mixing.SEED, other_weight=mixing.OTHER_WEIGHT)
    return mixed.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document that the mix holds, once per copy."""
    encoded = bpe.encode(docs, bpe.vocabulary_path())
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("bpe", encode)]

#: Near dedup and BPE are beyond SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
