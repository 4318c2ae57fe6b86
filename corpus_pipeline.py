"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and gives a frame, which is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of documents and drop rows; the last one encodes.

Defined results. Null texts and texts without a letter go in the first stage. Rows that repeat an id are told apart by
their place, and each stage judges them one by one; null ids rank as the stage's operator says (of copies the row with
an id stays). Of equal texts exactly one row stays, of a group of near copies the smallest id. Columns that documents
don't have are carried along, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontaminate import drop_contaminated
from tessella.llm.exact_dedup import drop_copies
from tessella.llm.language import drop_rejected, learn
from tessella.llm.pieces import encode_digests
from tessella.llm.registry import model_bytes
from tessella.llm.shared import forget, scratch, table, written
from tessella.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without any letter."""
    return drop_rejected(docs, learn(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text that stays, encoded and decoded again."""
    out = encode_digests(docs, model_bytes())
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SimHash and the encoding have no SQL form; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table goes when the next one is written, and with it what operators wrote on the way."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = written(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
