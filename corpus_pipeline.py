"""Corpus pipeline over ``documents``: toxicity, language ID, near-duplicates, mixing, tokens.

Each stage reads what the one before it kept, written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebar.llm import bpe, langid, minhash, mixing, toxicity
from tidebar.llm.common import table, written


#: Pieces that a worker remembers; fewer than in the query of its own, as the workers run the other stages too.
MEMO_PIECES = 150_000


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated classifier calls toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no language's code is shorter than the plain bytes."""
    return langid.drop_unidentified(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return minhash.drop_copies(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their fitted rate says. Toxic ones are gone by now, so that domain has no target and keeps its share."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), {d: share for d, share in mixing.TARGETS.items() if d != "toxic"})


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document. Memos end with a task, as the workers of an executor may be more than its cores."""
    return bpe.encode_documents(docs, bpe.default_tokenizer(), memo_pieces=MEMO_PIECES, keep_memos=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("language_id", identify_language),
    ("minhash", remove_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode_tokens),
]

#: SQL cannot express the trained stages; tests compare the run with its stages and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
