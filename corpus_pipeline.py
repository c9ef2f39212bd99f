"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, SentencePiece encoding.

Every stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents, others with whatever names among them. Null and empty texts and null
ids stay, repeated rows stay together, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import decontamination, line_dedup, minhash, piece_codec, quality
from chronoweave.llm._common import Workspace, table
from chronoweave.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else is left."""
    return line_dedup.remove_later_copies(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, decoded again to be sure."""
    return piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece encoding", encode),
]

#: The quality model and the encoding can't be put into SQL; tests hold each operator against brute force, and
#: the stages against what they must keep of a small table with nulls, repeats and clashing names.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
