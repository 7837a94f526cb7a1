"""A training-corpus pipeline over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs; all but the last return the columns of docs:

1. ``quality``: documents that the nearest-neighbour quality vote rejects (score < 0.5) go;
2. ``near_duplicates``: one document of each class of the n-gram Jaccard join stays;
3. ``decontaminate``: documents with a benchmark passage go;
4. ``encode``: token ids, and digests of the ids and of the text decoded from them.

Null or empty texts pass all stages (they score the prior, link with nothing, hold no
passage and have no ids); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from tickfeatures.llm import bpe, decontaminate, knn_quality, partenum
from tickfeatures.llm.dac import new_folder
from tickfeatures.llm.queries import TOKENIZER, quality_model, table

MIN_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = knn_quality.score_documents(docs, quality_model(docs, sf_dir), output="_quality")
    return scored.where(scored["_quality"] >= MIN_QUALITY).drop("_quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = [c for c in docs.columns if c in ("doc_id", "text", "lang", "source")]
    return bpe.encode_documents(docs.select(*columns), public_tokenizers.path(TOKENIZER), outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("encode", encode),
]

#: SQL cannot express the stages; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
