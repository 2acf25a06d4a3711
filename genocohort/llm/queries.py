"""The registered queries of the thirteen operators and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, hnsw, langid, line_dedup, lm_score, minhash_forest, mixing, runs, secrets, sharding, trie, urlgraph
from .oracles import ORACLES  # noqa: F401


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), split_pattern(), keep_ids=False)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", "n_kept", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).drop("text_hash", "n_words", "fitness")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("pieces", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("pass", "block", "shard", "from", "to")]))
    return mixing.plan_mix(_read(spark, sf_dir, "documents"), block_words=1).select("doc_id", "size", "source_size", "target", "taken", F.array_join(listed, ",").alias("pieces"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_read(spark, sf_dir, "documents"))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_embedding_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge_urls(_read(spark, sf_dir, "pages"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.planted(_read(spark, sf_dir, "documents")))


def op12_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_read(spark, sf_dir, "documents"), sharding.shard_tree(24), sharding.shard_tree(25))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.replayed(trie.sequences(_read(spark, sf_dir, "conversations")))).drop("turn_md5")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_line_dedup, op3_language_id, op4_lm_score, op5_source_mix, op6_fingerprints, op7_secret_scan, op8_minhash_forest, op9_embedding_hnsw, op10_url_graph, op11_word_runs, op12_hash_tree, op13_conversation_trie, pipeline)}
