"""Streams of frames and of label lines: the same expressions as for tables, on readStream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation


def frame_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of frames as they arrive in a folder."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", "100").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)


def frame_number(path: Column) -> Column:
    """The last number in a frame's file name; null without one."""
    return F.nullif(F.regexp_extract(path, r"([0-9]+)[^0-9/\\]*$", 1), F.lit("")).cast("bigint")


def skip_odd(frames: DataFrame, number: str) -> DataFrame:
    """Every second frame, beginning with number 0."""
    return frames.where(F.col(number) % 2 == 0)


def binary_class(score: Column, low: str, high: str) -> Column:
    """The class of a binary score; 0.5 and less is the lower one."""
    return F.when(score > 0.5, high).otherwise(F.when(score.isNotNull(), low))


def label_lines(spark: SparkSession, folder: str, schema: str = "line_id bigint, label_file string, line_no int, line string") -> DataFrame:
    """Label lines, with all their errors, of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("errors", validation.line_errors(F.col("line")))


def write_apart(lines: DataFrame, valid: str, failed: str, checkpoint: str, key: str = "line_id") -> Callable:
    """Starts a query that writes valid and failed lines to two tables. A batch that is run again overwrites its own folder, so no line is written twice."""

    def both(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key]).persist()
        rows.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{valid}/batch={number}")
        rows.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{failed}/batch={number}")
        rows.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(both).start()
