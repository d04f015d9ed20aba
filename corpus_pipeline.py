"""From raw documents to token ids: quality rules, near duplicates, personal data, source mixture, sentence pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. `run` writes
each stage's rows to the shared folder and goes on from there, so a lost executor costs one stage's tasks. What else a stage
wrote there is deleted once its rows are written.

Cases. Rows are told apart by doc_id and text, so rows that share one of the two, or have no doc_id, stand or fall by themselves: a rejected
row goes alone, and of each group of near duplicates one row stays. Rows without doc_id are nobody's copies.
Extra columns come through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import scratch, table
from barsmith.llm.mixing import mixed
from barsmith.llm.ngramjoin import one_of_each
from barsmith.llm.pieces import encoded
from barsmith.llm.pii import redacted
from barsmith.llm.quality import accepted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by the verdict on its own text."""
    return accepted(docs)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of the rows with the smallest doc_id the one with the least text hash, once.

    Rows of one doc_id with different texts are different documents, in the same or in different groups. Rows without doc_id stay.
    """
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found personal data masked."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mixture takes them."""
    return mixed(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless for each row."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicate_join), ("personal data", personal_data),
    ("source mix", source_mix), ("sentence pieces", sentence_pieces),
]
#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
