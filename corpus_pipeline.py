"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. A stage's own tables in the shared folder are deleted when a later stage begins:
by then its result has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import _common, lang_id, mixing, packing, secrets, simhash

#: Texts of which less than this share of letters is in one language are rejected.
MIN_SHARE = 0.5


def _begin(spark: SparkSession) -> None:
    _common.release_scope("pipeline")
    _common.scope("pipeline")
    _common.settle(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in no language for the most part."""
    _begin(spark)
    model = lang_id.train(docs)
    found = lang_id.identify(docs, model, keep=docs.columns, spans=False)
    return found.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_SHARE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a similarity of 0.8 or more stays, that with the least id."""
    _begin(spark)
    return simhash.deduplicate(docs, share=simhash.SHARE, width=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows."""
    _begin(spark)
    model = secrets.train(secrets.labelled(spark, docs))
    found = secrets.redact(secrets.scan(docs, model))
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their number of copies, shuffled globally."""
    _begin(spark)
    return mixing.shuffled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences of 1024."""
    _begin(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash components, models and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{_common.shared_dir(spark)}/docframe/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        _common.scope(f"{folder}/{k}")
        _common.register(spark, f"{folder}/{k}")
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        _common.release_scope(f"{folder}/{k - 1}")
    _common.release_scope("pipeline")
    _common.scope("")
    return docs
