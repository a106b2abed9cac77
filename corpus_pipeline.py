"""Corpus pipeline: the training-data operators as stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; the
driver (or ``run``) writes its result as Parquet and reads it again as the next one's ``docs``.  All
stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clusterscope.llm.decontaminate import decontaminated
from clusterscope.llm.mixing import in_mixture_order, volume_targets
from clusterscope.llm.neardup import without_near_duplicates
from clusterscope.llm.registered import TOKENIZER
from clusterscope.llm.texts import table
from clusterscope.llm.token_files import in_file_order, token_output
from clusterscope.llm.toxicity import without_toxic
from clusterscope.session import cut


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture of their sources."""
    return in_mixture_order(docs, volume_targets(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the documents in the order in which ``docs`` lies in its files, read back."""
    rows, order = in_file_order(docs)
    return token_output(rows, TOKENIZER, order)


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("token_files", token_stage)]

#: SQL has no form for the classifier, the signatures and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
