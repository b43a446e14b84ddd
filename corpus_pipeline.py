"""A corpus pipeline of four stages, each applying an operator of showerlake.llm.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept;
run() writes each stage's rows as Parquet to the shared folder and rereads them.
No stage can be said in SQL, so ORACLE_SQL is None; tests compare run() with a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from showerlake.llm import jaccard, language, packing, toxicity
from showerlake.llm.common import materialise, mod_crc
from showerlake.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what operator 5 scores below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.learn(docs, labels.where(~toxicity.held_out())))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what operator 8 finds to be in one of the learned languages; texts without a letter, and those that fit none, go."""
    return language.keep(docs, language.learn(docs.where(mod_crc("doc_id", 3) != 1)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of operator 6, with shingles of five words and a similarity of 0.8."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3's pieces of what is left."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_known_languages), ("near_copies", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
