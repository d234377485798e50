"""The thin queries of the subpackage: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, mixing, quality, repeats, sharding
from ._common import documents, remainder


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify, train

    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs, where=remainder(F.col("id"), 4) != 2)
    rows = identify(docs.select("doc_id", "text"), model, keep=["doc_id"], spans=False)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import RULES, joined, labelled, scan, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan(docs, train(labelled(spark, docs)))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    counts = [of(k).alias(f"n_{k}") for k in [*RULES, "markov"]]
    return found.select("doc_id", *counts[:-1], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), counts[-1])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    found = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return found.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "position")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited, fingerprint, following, likeness

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = following(docs.withColumn("fingerprint", fingerprint(F.col("text"))), id="doc_id", carry=["text", "fingerprint"])
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    near = lambda name: likeness(F.col("fingerprint"), F.col(name))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpylm import score, train

    docs = documents(spark, sf_dir)
    test = remainder(F.col("doc_id"), 7) == 2
    return score(docs, train(docs.filter(~test)), held_out=test)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import descend, shard, topology

    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = shard(docs, topology(8), crc="text_crc32")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", descend(topology(9), F.col("doc_id")).alias("grown_shard"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import deduplicate

    return deduplicate(documents(spark, sf_dir), keep_text=False)


QUERIES = {"op1_secrets": op1_secrets, "op2_mixing": op2_mixing, "op3_packing": op3_packing, "op4_fingerprints": op4_fingerprints, "op5_language_model": op5_language_model, "op6_simhash": op6_simhash, "op7_sharding": op7_sharding, "op8_repeats": op8_repeats, "op9_quality": op9_quality, "op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.oracle(), "op4_fingerprints": fingerprints.oracle(), "op7_sharding": sharding.oracle(), "op8_repeats": repeats.oracle(), "op9_quality": quality.oracle()}
