"""Incremental ingest with last-write-wins per URL, and incremental title matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobloom.functions.text import TextProcessor, content_key
from jobloom.operators.matching import Matcher
from jobloom.operators.tables import upsert_latest
from jobloom.sources.readers import RAW_JOB_SCHEMA, job_records

BATCH = "batch"


def moment(stamp: str) -> Column:
    """A time stamp as seconds: a number as it is, a date or time parsed; null for anything else."""
    text = F.col(stamp).cast("string")
    return F.coalesce(text.try_cast("double"), text.try_cast("timestamp").try_cast("double"))


def _newest_first():
    """By time, then by the stamp's text where it is no time, then by content."""
    stamp = F.col("scrapeTimestamp")
    return [moment("scrapeTimestamp").desc_nulls_last(), stamp.desc(), content_key(F.col("content")), F.col("title")]


def _run(stream: DataFrame, handle, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_postings(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    clean: TextProcessor,
    keep: str = "jk",
    files_per_batch: int = 1000,
) -> None:
    """Take in the JSON files that arrived since the last run.

    A batch keeps its newest row per URL and is written to a folder of its own, which a repeated
    batch overwrites; older rows are never touched. `current_postings` resolves the versions.
    """
    raw = (
        spark.readStream.schema(RAW_JOB_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(source)
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = upsert_latest(batch, "url", _newest_first())
        newest.write.mode("overwrite").parquet(f"{table}/{BATCH}={batch_id}")

    _run(job_records(raw, clean, keep), handle, checkpoint)


def current_postings(spark: SparkSession, table: str) -> DataFrame:
    """The last written row per URL."""
    return upsert_latest(spark.read.parquet(table).drop(BATCH), "url", _newest_first())


def compact_postings(spark: SparkSession, table: str, target: str) -> None:
    """Write the resolved table to a new folder; the old one stays readable meanwhile."""
    current_postings(spark, table).write.mode("overwrite").parquet(f"{target}/{BATCH}=0")


def match_stream(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    table: str,
    checkpoint: str,
    matcher: Matcher,
    files_per_batch: int = 1000,
) -> None:
    """Match the titles of newly arrived rows against static lookups, batch by batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def handle(batch: DataFrame, batch_id: int) -> None:
        matched = batch.transform(matcher)
        matched.write.mode("overwrite").parquet(f"{table}/{BATCH}={batch_id}")

    _run(rows.withColumn("title", F.lower("title")), handle, checkpoint)
