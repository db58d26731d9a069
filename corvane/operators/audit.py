"""Auditing files: routing, duplicates, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import class_code, class_name, has_suffix

VALID, INVALID, ERROR = "valid", "invalid", "error"
MISSING_CLASS = "missing_class_directory"


#: The first bytes of JPEG, PNG, GIF, BMP, TIFF (both orders); WebP has RIFF and a size before its mark.
MAGIC = ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "424D", "49492A00", "4D4D002A")


def looks_like_image(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    known = F.lit(False)
    for mark in MAGIC:
        known = known | head.startswith(mark)
    return known | (head.startswith("52494646") & head.endswith("57454250"))


def image_fault(length: Column, content: Column) -> Column:
    """Why a file is no image, in words."""
    head = F.concat(F.lit("no image begins with the bytes "), F.hex(F.substring(content, 1, 4)))
    return F.when(length == 0, F.lit("empty file")).otherwise(head)


def routed(files: DataFrame, class_map: dict[str, str], readable: Column | None = None, error: Column | None = None) -> DataFrame:
    """Adds class_code, class_name, status and error: no class is invalid, then an unreadable file is an error."""
    code = class_code(F.col("raw_rel_path"), class_map)
    ok = F.lit(True) if readable is None else readable
    status = F.when(F.col("class_code").isNull(), INVALID).when(~F.coalesce(ok, F.lit(False)), ERROR).otherwise(VALID)
    said = F.lit("unreadable image") if error is None else error
    out = files.withColumn("class_code", code).withColumn("class_name", class_name(F.col("class_code"), class_map))
    return out.withColumn("status", status).withColumn("error", F.when(F.col("status") == ERROR, said))


def images_only(files: DataFrame, extensions) -> DataFrame:
    return files.where(has_suffix(F.col("raw_rel_path"), extensions))


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("sha256", F.sha2(F.col(content), 256))


def valid_files(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == VALID).select("src_path", "class_code", "class_name", "sha256")


def invalid_files(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == INVALID).select(F.col("src_path").alias("path"), F.lit(MISSING_CLASS).alias("reason"))


def file_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == ERROR).select(F.col("src_path").alias("path"), "error")


def duplicate_files(valid: DataFrame) -> DataFrame:
    """Each file whose content another has, with the size of its group: counts are combined before the join back."""
    sizes = valid.groupBy("sha256").agg(F.count("*").alias("count")).where("count > 1")
    return valid.join(sizes, "sha256").select("sha256", F.col("src_path").alias("path"), "count")


def class_counts(valid: DataFrame) -> DataFrame:
    return valid.groupBy("class_code", "class_name").agg(F.count("*").alias("count"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counters; duplicates are the files whose content another has."""
    by_hash = rows.groupBy("status", F.when(F.col("status") == VALID, F.col("sha256")).alias("sha256")).agg(F.count("*").alias("n"))
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)).cast("long")
    repeated = F.coalesce(F.sum(F.when((F.col("status") == VALID) & (F.col("n") > 1), F.col("n"))), F.lit(0)).cast("long")
    return by_hash.agg(of(VALID).alias("valid"), of(INVALID).alias("invalid"), of(ERROR).alias("errors"), repeated.alias("duplicates"))
