"""From raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and reads nothing but what its predecessor kept, labels and the benchmark.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, line_dedup, near_copies, packing, toxicity
from plumbline.llm._common import Tables, shared_folder, table

#: Rows of an Arrow batch: executors come to the later stages with full heaps, and a row may be a pair of whole texts.
BATCH = 1000
#: Words whose token ids a worker keeps while it packs, for the same reason.
KNOWN_WORDS = 60_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most BATCH rows from now on: a stage's plan reads the setting when it runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay."""
    bound_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one; documents stay, however little is left of them."""
    bound_batches(spark)
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), keep=[c for c in COLUMNS if c not in ("text", "n_chars")])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one document stays."""
    bound_batches(spark)
    gone = near_copies.near_duplicates(docs)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window stay."""
    bound_batches(spark)
    out = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return out.where(F.col("n_hit") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens."""
    bound_batches(spark)
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), known_words=KNOWN_WORDS)
    parts = Tables(spark).put(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))  # tokenised once
    return packing.pack(parts, keep=["doc_id", "piece", "start", "ids_crc32"], order=["doc_id", "piece"])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Fingerprints, learned scores and tokens are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
