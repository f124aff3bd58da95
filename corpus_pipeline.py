"""A training-data pipeline: five stages, each written as Parquet and read again by the next.

quality classifier -> near-duplicates -> private data -> source mix -> BPE ids

Null texts count as empty and score as the classifier's intercept does; rows with a null id are named by
their text alone.  Of repeated rows the near-duplicate stage keeps one.  Ties in scores, components and draws are
settled by ids and hashes, so a run can be repeated.  An empty table gives no rows.  Further columns stay, whatever
their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, mixing, nbsvm, near_dup, privacy
from gleaner.llm.common import dropped, first_free, shared_dir, table

WORD_BPE = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores below its bar go."""
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), where=~nbsvm.held_out())
    name = first_free(docs.columns, "score")
    return nbsvm.scores(docs, model, docs.columns, name).where(F.col(name) >= nbsvm.KEEP_FROM).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values are replaced by pseudonyms of the same format."""
    return privacy.pseudonymise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are thinned until expected domain tokens match their targets."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each remaining document."""
    return bpe.encode_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("private data", private_data),
    ("source mix", source_mix),
    ("bpe ids", token_ids),
]

#: Learned scores and near-duplicate components have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    folder, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage{i}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if i:
            dropped(spark, f"{folder}/stage{i - 1}")  # the next stage has read it
    return docs
