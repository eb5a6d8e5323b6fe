"""Corpus pipeline: four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage's result to the shared folder and hands what it reads back to the next.

1. Quality classifier: documents that it rejects go.
2. N-gram Jaccard join: one document of each group of near copies stays.
3. Mixing: every source is taken up to its target; repeated epochs repeat documents, the last one is cut.
4. BPE: the mix is encoded and decoded; one row of digests per document of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import bpe, mixing, ngram_join, quality
from tidepanel.llm.common import stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.accepted(docs, quality.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing_to_weights", mix_sources),
    ("bpe_encoding", encode),
]

# A learned classifier and a tokenizer have no SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
