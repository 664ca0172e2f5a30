"""The registered query of each corpus operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import byte_bpe, chat, importance, licenses, media, merkle, oracles, packing, quality, secrets, tree_bpe, whitening
from tessera.llm._tables import table
from tessera.llm.minhash import near_duplicates
from tessera.llm.suffix_dedup import remove_repeats

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    kept = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], kept.schema)
    got = chat.read(chat.windows(kept.unionByName(extra)))
    parts = F.sort_array(F.collect_list(F.struct("window", "turns", "loss_text")))
    by_conv = got.groupBy("conv_id").agg(parts.alias("w"), F.sum(F.length("text").cast("long")).alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["turns"]))
    loss = F.array_join(F.transform("w", lambda x: x["loss_text"]), "")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = by_conv.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars", F.size("w").cast("long").alias("n_windows"))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents")).select("id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.edited_fingerprints(table(spark, sf_dir, "documents"))
    return out.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store_texts(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = byte_bpe.round_trip(table(spark, sf_dir, "documents"))
    return decoded.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


def op12_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tree_bpe.round_trip(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_chat_windows, op3_suffix_dedup, op4_best_fit_packing, op5_secret_scan, op6_merkle_fingerprints, op7_quality_neighbours, op8_license_scan, op9_media_columns, op10_byte_bpe, op11_importance_resampling, op12_tree_bpe, op13_embedding_whitening)}

#: The others can't be put in SQL; each is tested against a brute-force version in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_minhash_near_dedup": oracles.NEAR_DEDUP, "op2_chat_windows": oracles.CHAT, "op3_suffix_dedup": oracles.REPEATS, "op11_importance_resampling": oracles.IMPORTANCE}
