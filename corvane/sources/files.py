"""Sources: file trees, manifests, reports, class maps."""

from __future__ import annotations

import csv
import io
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import schemas
from corvane.functions.paths import has_suffix, parent_name, relative
from corvane.sources import tree
from corvane.sources.store import Store

CSV = {"header": True, "escape": '"', "quote": '"', "multiLine": True, "encoding": "UTF-8"}


#: Schemes that the workers' own file systems read.
ARROW_SCHEMES = ("file", "s3", "s3a", "gs", "hdfs")


def scan_tree(spark: SparkSession, root: str, suffixes=(), content: bool = True, hidden: bool = True, sha256: bool = False) -> DataFrame:
    """(src_path, raw_rel_path, length, content) of all files below root, or of root itself if it is a file; suffixes are
    those to open, in lower case. sha256 adds each file's hash; without content no file is held whole for it.

    The file tree source (tree.py) prunes by path and suffix before it opens anything and sees hidden files. A store that
    only Spark reads is read by its binary files, without names that begin with a dot or an underscore; these are held
    whole for their hash, and fail above 2 GB."""
    scheme = str(root).split(":", 1)[0] if re.match(r"[a-z0-9]+:/", str(root)) else "file"
    if scheme in ARROW_SCHEMES:
        rows = tree.scan(spark, str(root).replace("s3a://", "s3://", 1), suffixes, content, sha256=sha256)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
        bare = "/" + root.split("://", 1)[-1].lstrip("/")
        asked = [F.sha2("content", 256).alias("sha256")] * sha256 + [F.col("content")] * content
        rows = found.select(path.alias("src_path"), relative(F.col("path"), bare).alias("raw_rel_path"), "length", *asked)
        rows = rows.where(has_suffix(F.col("raw_rel_path"), suffixes)) if suffixes else rows
    return rows if hidden else rows.where(~F.col("raw_rel_path").rlike(r"(^|/)[._]"))


def literal(path: str) -> str:
    """A path whose signs stand for themselves where Spark would take them for a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV).schema(schemas.MANIFEST).csv(path)


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One split of a manifest written by split: other splits' files are not listed."""
    return spark.read.parquet(root).where(F.col("split") == split)


def read_reports(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Class metrics of all files that match one pattern or are listed, with the name of each file's folder as split."""
    rows = spark.read.options(**CSV).schema(schemas.CLASS_METRICS).csv(pattern)
    split = F.url_decode(parent_name(F.col("_metadata.file_path")))
    return rows.select(split.alias("split"), *rows.columns)


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as strings by the names in its first record: Spark looks for the schema of a file by its path as a
    pattern, and this finds files of any name."""
    head = Store(spark).read_bytes(path, 1 << 20).decode("utf-8-sig", "replace")
    names = next(csv.reader(io.StringIO(head, newline="")))
    schema = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    return spark.read.options(**CSV).schema(schema).csv(literal(path))


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """A confusion matrix as (class, predicted, n): the first column names the true class, the others are the classes."""
    wide = _by_header(spark, path)
    first, *names = wide.columns
    return wide.select(F.col(f"`{first}`").alias("class"), *(F.col(f"`{n}`").cast("bigint").alias(n) for n in names)).unpivot(["class"], names, "predicted", "n")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The columns that the file has, by name; what the schema does not name is a double."""
    rows, kinds = _by_header(spark, path), {f.name: f.dataType for f in schemas.HISTORY}
    return rows.select(*(F.col(f"`{c}`").cast(kinds.get(c, "double")).alias(c) for c in rows.columns))


def load_json(path: str | Path):
    return json.loads(Path(path).read_text(encoding="utf-8"))
