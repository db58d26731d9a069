"""The audit over files as they arrive; an addition, as the batch jobs have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.audit import routed, with_hash


def arriving(spark: SparkSession, root: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)


def first_of_content(files: DataFrame, class_map: dict[str, str], late: str = "1 day") -> DataFrame:
    """Routed files, each content once within the time that late files are waited for."""
    rows = files.withColumn("src_path", F.regexp_replace("path", r"^[a-z]+:/+", "/")).withColumn("raw_rel_path", F.col("src_path"))
    hashed = with_hash(routed(rows, class_map)).drop("content").withWatermark("modificationTime", late)
    return hashed.dropDuplicatesWithinWatermark(["sha256"])
