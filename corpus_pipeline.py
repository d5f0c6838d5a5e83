"""The training-text pipeline: stages over `documents`, each written before the next.

Every stage works on all rows that the one before kept, and all but the last return the
columns of `documents`. Models are fitted on the given tables, as in the operators' own
queries; what they decide is decided for whole texts of the stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import contamination, covering_simhash, language_id, packing, queries, toxicity
from ebbline.llm.common import read_table, stage

#: A text is kept if its language is known with at least this pooled probability.
LEAST_CERTAIN = 0.5
#: Runs in a generation of the tokenizer's memory: its workers serve the other stages too,
#: whose models and memories they hold.
REMEMBERED_RUNS = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    scored = toxicity.score_toxicity(docs, queries.fitted_toxicity(spark, sf_dir))
    return scored.where("predicted = 0").select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language for certain, go."""
    guessed = language_id.predict_language(docs, queries.fitted_language_reader(spark, sf_dir))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)
    return guessed.where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id."""
    return covering_simhash.deduplicate(docs, width=3, radius=2).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated go."""
    found = contamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places, as in the operator's query."""
    return queries.packed_pieces(docs, REMEMBERED_RUNS)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL states neither the fitted models nor the tokenizer.
ORACLE_SQL = None
