"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet in the cluster's shared folder and rereads it as the next one's docs. Toxic documents go, one
document of each near-duplicate group stays, secrets are replaced by a mark, sources are mixed to
their target weights (documents taken twice are repeated under the same id), and what is left is
encoded: a row for each copy, in no order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.llm import minmax, mixing, piece_bpe, secrets, toxicity
from stemma.llm.common import cut, table
from stemma.llm.queries import tokenizer_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, chain)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(docs, tokenizer_path(), digests=True)


STAGES = [("toxicity", clean), ("near_dedup", dedup), ("secrets", redact), ("mixing", mix), ("encoding", encode)]

#: The fitted chain, the network's spans and the dependent rounding have no SQL form; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
