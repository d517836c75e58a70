"""The registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, fingerprints, licences, line_dedup, nnls_packing, packing, quality, simhash, site_style, spelling, toxicity
from ._common import Tables, table
from .oracle import ORACLE  # noqa: F401


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected answers; a missing one is empty."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.select((F.floor(F.col("conv_id") / 2) * 2).alias("chosen_id")).distinct()
    out = chat.preference(ids.withColumn("rejected_id", F.col("chosen_id") + 1), turns)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs).groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"), F.round(F.max("dice"), 9).alias("best_dice"))
    return docs.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host: the document's source; path: its language there."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = Tables(spark).put(quality.evidence(docs.select("doc_id", "text", "source", "lang"), model, keep=["doc_id", "source", "lang"]))
    out = quality.posteriors(scored, host_col="source", path_col="lang", base=model.base if model else 0.5)
    return out.select("doc_id", "evidence", "site_mean", F.col("posterior").alias("score"), (F.col("posterior") >= 0.5).alias("keep"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_style.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    parts = Tables(spark).put(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))  # tokenised once
    return packing.pack(parts, keep=["doc_id", "piece", "start", "ids_crc32"], order=["doc_id", "piece"])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nnls_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_chat, op3_licences, op4_simhash, op5_quality, op6_main_text, op7_decontaminate, op8_line_dedup, op9_packing, op10_toxicity, op11_packing, op12_spelling, op13_filter_audit)}
