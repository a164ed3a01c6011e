"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, language_id, near_dedup, pii, sharding, token_count, token_store, unigram
from .common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(spark, table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-1, 0, "user", chat.ADDED_TEXT), (-1, 1, "assistant", chat.ADDED_TEXT)]
    turns = turns.unionByName(spark.createDataFrame(added, "conv_id bigint, turn bigint, role string, text string"))
    return chat.digest(chat.read_chats(chat.format_chats(turns)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, table(spark, sf_dir, "documents")).drop("locator")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(spark, docs)
    found = language_id.identify(spark, language_id.held_out(docs.select("doc_id", "text")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(spark, table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_documents(table(spark, sf_dir, "documents"), PIECES)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_token_store, op3_sharding, op4_chat, op5_exact_dedup, op6_language_id, op7_decontaminate, op8_token_count, op9_unigram, op10_near_dedup)
}
ORACLE_SQL = {"op1_pii": pii.ORACLE_SQL, "op4_chat": chat.ORACLE_SQL, "op5_exact_dedup": exact_dedup.ORACLE_SQL}
