"""Documents that arrive later: their postings are appended, statistics are kept per batch and read as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.index import term_frequencies, tokens


def start_index(stream: DataFrame, folder: str, key: str = "doc_id", text: str = "text", once: bool = True):
    """Writes postings and per-batch term statistics of new documents under ``folder``; a batch that is written again
    after a failure replaces itself. ``once`` takes what is there and ends."""

    def write(batch: DataFrame, number: int) -> None:
        tf = term_frequencies(tokens(batch, key, text)).persist()
        tf.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        part = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tfs"), F.sum(F.col("tf") * F.col("tf")).alias("tfs_sq"))
        part.write.mode("overwrite").parquet(f"{folder}/stats/batch={number}")
        tf.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    """``term``, ``df``, ``tfs``, ``tfs_sq`` over all batches; the documents of the batches must be different."""
    return spark.read.parquet(f"{folder}/stats").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tfs").alias("tfs"), F.sum("tfs_sq").alias("tfs_sq"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/postings").select("doc_id", "term", "tf")


def document_vector(spark: SparkSession, folder: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vectors of unseen documents against the live statistics: ``doc_id``, ``term``, ``tf``, ``weight``."""
    tf = term_frequencies(tokens(docs, key, text))
    return tf.join(index_stats(spark, folder).select("term", "df"), "term").select("doc_id", "term", "tf", (F.col("tf") / F.col("df")).alias("weight"))
