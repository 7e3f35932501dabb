"""Scenes as a stream: files that arrive are cut into segments line by line, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scanner import lines, segments


def stream_scenes(spark: SparkSession, path: str) -> DataFrame:
    found = spark.readStream.format("text").option("wholetext", True).load(path)
    return found.select(F.regexp_extract("_metadata.file_path", r"([^/]*?)(?:\.txt)?$", 1).alias("scene_name"), F.col("value").alias("content"))


def stream_segments(scenes: DataFrame, semantics: str = "observed") -> DataFrame:
    """Every command and stretch of text of the scenes, as soon as they arrive."""
    return segments(lines(scenes, semantics), semantics)
