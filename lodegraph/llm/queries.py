"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, linededup, mixing, packing, pii, quality, simhash, substring, tokenfile, topk

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.repeats_removed(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.written(documents(spark, sf_dir))
    found = tokenfile.read(spark, path).select("doc_id", "shard", "shard_start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    placed = found.join(tokenfile.shard_starts(spark, path), F.col("shard") == F.col("of_shard"))
    return placed.select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in counts], F.array_join("q_failed", ",").alias("failed_rules"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0", k=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    of = lambda k: F.filter("pii", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    scores = F.array_join(F.transform("pii", lambda x: F.round(x["score"], 2).cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(pii.digest(base).cast("binary"), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"), scores.alias("scores"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return done.select("doc_id", F.col("ld_lines").cast("long").alias("n_lines"), F.size("ld_cut").cast("long").alias("n_removed"), linededup.runs(F.col("ld_cut")).alias("removed_runs"), F.col("ld_lines_copied").cast("long").alias("longest_block"), F.col("ld_source").cast("long").alias("source_doc"), kept.alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def packed(found: DataFrame) -> DataFrame:
    """Places of pieces, with the checksum of their ids instead of the ids."""
    slim = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth")
    return packing.place(slim, found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(packing.pieces(documents(spark, sf_dir)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), mixing.MIX_WEIGHTS)


def queries() -> dict[str, Query]:
    return {
        "op1_topk": op1_topk,
        "op2_pii": op2_pii,
        "op6_line_dedup": op6_line_dedup,
        "op7_licenses": op7_licenses,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_mixing": op10_mixing,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_file": op4_token_file,
        "op5_quality_rules": op5_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {name: sql for name, sql in oracles.SQL.items() if name in queries()}
