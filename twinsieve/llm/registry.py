"""The subpackage's queries, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.chat import DIGEST_SQL, conversation_digests, format_conversations, with_control_conversation
from twinsieve.llm.decontaminate import contaminated
from twinsieve.llm.langid import fit, held_out, identify
from twinsieve.llm.licences import licence_digests, scan_licences
from twinsieve.llm.ngramlm import SCORE_SQL, ngram_scores
from twinsieve.llm.packing import DIGESTS, digest_pieces, pack_documents
from twinsieve.llm.setjoin import LINKS_SQL, jaccard_components
from twinsieve.llm.sharding import shard_documents
from twinsieve.llm.tokenfiles import token_digests, write_tokens
from twinsieve.llm.tokens import tokenizer_path
from twinsieve.llm.topk import TOP_SQL, top_k
from twinsieve.shared import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores(_table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1, length=2048, project=digest_pieces, schema=DIGESTS)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_digests(scan_licences(_table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/tokens"
    write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_digests(spark, path)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digests(format_conversations(with_control_conversation(spark, _table(spark, sf_dir, "conversations"))))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90, links=True).select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scores": op2_lm_scores,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_licences": op5_licences,
    "op6_language": op6_language,
    "op7_token_files": op7_token_files,
    "op8_topk": op8_topk,
    "op9_chat": op9_chat,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op2_lm_scores": SCORE_SQL,
    "op8_topk": TOP_SQL,
    "op9_chat": DIGEST_SQL,
    "op10_jaccard_join": LINKS_SQL,
}
