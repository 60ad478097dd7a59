"""Manifest operators over file streams; each run takes what is there (AvailableNow) and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import shared_folder
from tapeloom.sources import jsonl


def line_stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream of raw shard lines from Parquet files at a path or glob."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _appended(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream to its present end into the shared folder; returns what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _counted(stream: DataFrame, key: str, counts: dict[str, Column], name: str) -> DataFrame:
    """Counts by `key` over a stream, run to its present end.

    Each micro-batch writes its own partial counts under its number, so a batch that is run again replaces itself, no
    state is kept however long the stream runs, and rows that come late still count. Reading adds the partial counts up.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(*(c.alias(n) for n, c in counts.items())).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    add(spark.createDataFrame([], stream.schema), -1)  # for a stream without rows
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy(key).agg(*(F.sum(n).alias(n) for n in counts))


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, utt_id, reason) of every line, parsed and split into good and rejected while streaming."""
    rows = line_stream(spark, path).select("line_id", jsonl.json_object(F.col("raw"), "utt_id string").alias("r"), jsonl.reject_reason(F.col("raw")).alias("reason"))
    return _appended(rows.select("line_id", F.col("r.utt_id").alias("utt_id"), "reason"), "ingested")


def interval_counts(spark: SparkSession, path: str, interval: int) -> DataFrame:
    """Per interval of `interval` line ids: lines and rejected lines, as a count-based tumbling window."""
    lines = line_stream(spark, path).select(F.expr(f"line_id div {interval}").alias("interval_no"), jsonl.reject_reason(F.col("raw")).alias("reason"))
    return _counted(lines, "interval_no", {"lines": F.count("*"), "rejected": F.count("reason")}, "intervals")


def hourly_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Lines by hour of arrival, late ones included; an addition to the manifest operators."""
    lines = line_stream(spark, path).select(F.date_format(F.date_trunc("hour", "ingested_at"), "yyyy-MM-dd HH:mm:ss").alias("hour"))
    return _counted(lines, "hour", {"lines": F.count("*")}, "arrivals")
