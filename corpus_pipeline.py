"""The documents table through five stages: toxicity, exact, near and substring dedup, packing.

Each stage takes the documents that the one before kept, all of them and whole,
and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slabscan.llm import exact_dedup, minhash, packing, suffix_dedup, toxicity
from slabscan.llm.common import drop_path, scratch, stored
from slabscan.llm.queries import tokenizer_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones among them doesn't predict toxic.

    Null and empty texts are scored as texts without words, which the model
    finds clean unless most labels are toxic; repeated rows share their fate;
    without labels of both kinds the share of toxic labels decides for all; an
    empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts but for white space: the smallest doc_id.

    Null and empty texts are one group.  Of rows that repeat the smallest id
    one stays; null ids come last; an empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id.

    Null texts and texts without words all stay.  Of rows that repeat the
    smallest id one stays; null ids come last; an empty table stays empty.
    """
    return minhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that occur anywhere else, and with their new ``n_chars``.

    Null texts stay null; texts may become empty; equal rows lose what they
    share; an empty table stays empty.
    """
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null and empty texts have the end id alone, and an empty table no rows."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

#: The learned model and the differencing have no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage's result is written; its predecessor's, and what it wrote besides, is deleted then."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            kept = stored(stage(spark, docs, sf_dir))
            keep(kept)
        if last is not None:
            drop_path(spark, last)
        docs, last = kept, kept._stored_at
    return STAGES[-1][1](spark, docs, sf_dir)
