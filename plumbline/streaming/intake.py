"""Page documents as a stream: a Spark-native extra; the rules are the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import rules
from ..sources.documents import documents


def read_stream(spark: SparkSession, path: str, *, max_files: int = 1000) -> DataFrame:
    texts = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", max_files).text(path)
    return documents(texts.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("raw")))


def validate_stream(docs: DataFrame, issues_path: str, verdicts_path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch's issues and verdicts to two Parquet tables, with the batch's number.

    The number lets readers drop what a repeated batch wrote twice: writes are at least once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            stamp = lambda df: df.withColumn("batch", F.lit(number))
            stamp(rules.validate(batch)).write.mode("append").parquet(issues_path)
            stamp(rules.report(batch)).write.mode("append").parquet(verdicts_path)
        finally:
            batch.unpersist()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events at most `gap` apart; works on streams (watermark `late`) and on tables."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(time, late)
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
