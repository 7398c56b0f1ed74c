"""The same functions over streams of files: stateless scrubbing, running counts, windowed counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import whitespace_tokens
from textmill.plans.scrubber import make_pipeline


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of whole text files: name, path, text."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "path", F.decode("content", "UTF-8").alias("text"))


def parquet_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def scrubbed(stream: DataFrame, items: Iterable, text_col: str = "text") -> DataFrame:
    return stream.withColumn(text_col, make_pipeline(*items)(F.col(text_col)))


def running_term_counts(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n so far; for update or complete output."""
    return stream.select(F.explode(whitespace_tokens(F.lower(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time_col: str, by: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per time window, with a watermark that bounds the state."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_once(stream: DataFrame, to: str, checkpoint: str, *, mode: str = "append") -> None:
    """Take in all files that are there, write Parquet, stop; a later call goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
