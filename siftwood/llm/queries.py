"""The queries of this package for the driver's contract: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import chat, compression, decontaminate, licenses, packing, pii, quality, simhash, token_counts, toxicity
from siftwood.llm._shared import Scratch, table


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: all documents come in; the counts of those with a repeated line are revised to the text without
    it; exact copies (all but the smallest id of a text) go out.  Each is committed twice, the second time without
    effect.  Totals are told as they stand after the load (state loaded) and after all three (state final)."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    keys = ["doc_id", "source", "lang", "text_hash", "changed"]
    texts = docs.select(
        "doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "text",
        F.coalesce(F.size(F.array_distinct(lines)) < F.size(lines), F.lit(False)).alias("changed"),
    )
    counted = scratch.save(token_counts.count_tokens(texts, keys))
    shorter = texts.where("changed").withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    revised = scratch.save(token_counts.count_tokens(shorter, keys))
    changes = token_counts.signed(counted.where("changed"), -1).unionByName(token_counts.signed(revised, 1))
    copy = ["text_hash", "tokenizer"]
    first = scratch.save(counted.groupBy(*copy).agg(F.min("doc_id").alias("first_id")))
    current = counted.where("not changed").unionByName(revised)
    copies = current.join(first, copy).where("doc_id > first_id")
    rollup = token_counts.TokenRollup(spark, f"{scratch.root}/rollup")
    for _ in range(2):
        rollup.commit("load", token_counts.signed(counted, 1))
    loaded = rollup.totals()
    for _ in range(2):
        rollup.commit("drop repeated lines", changes)
        rollup.commit("drop exact copies", token_counts.signed(copies, -1))
    return loaded.withColumn("state", F.lit("loaded")).unionByName(rollup.totals().withColumn("state", F.lit("final")))


def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_bands(table(spark, sf_dir, "documents"))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.learn_quality(docs, table(spark, sf_dir, "labels")))


def op6_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, "base_sha256", pii.spans_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op7_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("placements", F.to_json("placements"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
        "op2_token_rollup": op2_token_rollup,
        "op3_toxicity_fm": op3_toxicity_fm,
        "op4_compression_bands": op4_compression_bands,
        "op5_quality_fm": op5_quality_fm,
        "op6_contextual_pii": op6_contextual_pii,
        "op7_snapshot_collapse": op7_snapshot_collapse,
        "op8_license_scan": op8_license_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_simhash": op10_simhash,
    }


#: Prefixes as strings: rows of a turn end with \x1e, its role and text are parted by \x1f.
CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, place, n_turns,
         string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM t),
whole AS (
  SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE place = n_turns GROUP BY ALL),
proper AS (SELECT DISTINCT prefix FROM p WHERE place < n_turns),
kept AS (SELECT conv_id, n_turns, n_copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM proper))
SELECT t.conv_id, t.turn, t.role, '<|' || t.role || '|>' || chr(10) || t.text || chr(10) || '<|end|>' || chr(10) AS rendered,
       kept.n_turns, kept.n_copies
FROM t JOIN kept USING (conv_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_snapshot_collapse": CHAT_SQL}
