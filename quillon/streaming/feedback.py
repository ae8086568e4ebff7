"""Streams over an append-only feedback log: state is bounded by watermarks, or is a keyed table in files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import new_path
from .ordered import ROCKS


def log_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The log as a stream of its Parquet files, `files` a batch; path is a folder or a pattern. The schema is that of the files there;
    its event time `ts` counts as UTC."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, label: str, mode: str = "append", step: Callable[[DataFrame, int], None] | None = None, home: str | None = None) -> str:
    """Runs a stream over what is there; the path of its output. Checkpoint and output are under `home`, where a later run with the same
    one goes on; a new folder of the shared one by default. With `step`, each batch goes there instead."""
    spark, home = stream.sparkSession, home or new_path(stream.sparkSession, label)
    was = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{home}/checkpoint")
        query = (writer.foreachBatch(step) if step else writer.format("parquet")).start(None if step else f"{home}/out")
    finally:
        spark.conf.set(ROCKS[0], was)
    query.awaitTermination()
    return f"{home}/out"


def windowed_agreement(events: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """start, n, agreement by windows of ts; rows over `late` behind the latest are too late, and their windows closed."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    return by.agg(F.count("*").alias("n"), F.avg("agrees").alias("agreement")).select(F.col("w.start").alias("start"), "n", "agreement")


def distinct_requests(events: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first of equal requests within a time of each other; the state forgets a request after that."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def refit_points(counts: DataFrame, every: int = 5) -> DataFrame:
    """batch, labels, refits: after which batches a refit is due, when one comes every `every` labels. counts: batch, n (few rows)."""
    from pyspark.sql.window import Window

    so_far = F.sum("n").over(Window.orderBy("batch"))
    return counts.select("batch", so_far.alias("labels"), (F.floor(so_far / every) - F.floor((so_far - F.col("n")) / every)).alias("refits"))
