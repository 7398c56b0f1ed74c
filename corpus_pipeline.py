"""A training corpus from the ``documents`` table, in five stages.

Every stage takes all rows that its predecessor kept; ``run`` writes each stage's
rows as Parquet in the shared folder, reads them again for the next one, and deletes
them when that one has been written.

Defined results, stage by stage.  All but the last return the columns of ``docs``,
whatever they are called, and rows unchanged.

* toxicity: a row goes if the chain's last link gives it one half or more; null and
  empty texts have no words and get the probability of such texts; equal rows stay or
  go together; without labels of both kinds nothing is learnt and the share of toxic
  labels decides for all.
* near_dedup: of each group the rows with its smallest id stay, so rows that share an
  id stay or go together; rows without an id or without words are in no group and stay.
* decontamination: a row goes if any benchmark item occurs in it, items without an id
  too; null and empty texts stay.
* mixing: rows are taken none, one or two times; rows without words as often as their
  source goes wholly into its target, which adds nothing; rows without a source are a
  source of their own; rows equal in id and text share what is taken of them.
* token_output: a row for each document in the files, in ascending id with nulls first,
  then by text; a null or empty text is the end id alone.

An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import decontam, mixing, neardup, token_files, toxicity
from textmill.llm._common import discard, materialize, shared_path, table
from textmill.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last link of the toxicity chain stays below one half."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), n=8, min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times."""
    return mixing.repeat(docs, weights=[3, 1, 2], share=1.5, most=2.0)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document in them."""
    folder = shared_path(spark, "tokens")
    token_files.write_token_files(docs, folder, tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The chain's models and the tokenizer's ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    # The result reads the token files, not the texts.
    discard(docs)
    return out
