"""Registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, chat, embeddings, gif, langid, packing, quality, simhash, substrings, token_output
from strandloom.llm.common import scratch_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "p_good", (F.col("p_good") >= quality.MIN_P).alias("kept"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a paragraph that stands in more than one document."""
    return substrings.repeats(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return told.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_tokens(_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path(BYTE_BPE), end_id=0)
    return token_output.read_tokens(spark, shards).drop("ids")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_classes(_table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_features(gif.text_media(_table(spark, sf_dir, "documents"))).drop("histogram")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_substrings": op2_substrings,
        "op3_language_id": op3_language_id,
        "op4_token_output": op4_token_output,
        "op5_chat": op5_chat,
        "op6_simhash": op6_simhash,
        "op7_packing": op7_packing,
        "op8_embeddings": op8_embeddings,
        "op9_bpe": op9_bpe,
        "op10_gif": op10_gif,
    }


def oracle_sql() -> dict[str, str]:
    """Only the chat operator: the others are fitted, hashed or packed in ways SQL has no words for; tests hold them against brute force."""
    return {"op5_chat": chat.ORACLE_SQL}
