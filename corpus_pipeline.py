"""The corpus pipeline: a list of stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, minhash, mixing, quality, simhash, token_files
from tracemill.llm.common import shared_dir, table
from tracemill.llm.queries import mix_weights, source_domain


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_rules(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op6's fingerprints and links; texts further apart, of one Jaccard similarity, by minimum hashes."""
    return minhash.keep_one(docs, max_bits=simhash.MAX_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


#: As many tokens as there are: small leaves are read twice at most, large ones in part.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.0, 2, 1


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, source_domain(), F.col("tokens") * MIX_SHARE, MIX_EPOCHS, MIX_SEED, **mix_weights(spark))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoder = token_files.byte_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(token_files.write_tokens(docs, encoder), docs.schema["doc_id"].dataType)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source mix", mixing_stage),
    ("token files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs


#: The fingerprints, the edit search and the token ids are not expressible in SQL.
ORACLE_SQL = None
