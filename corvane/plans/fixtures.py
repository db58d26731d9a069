"""How the synthetic tables stand in for a corpus of labelled files, scores and a training history."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import SplitRatios
from corvane.functions.paths import class_name
from corvane.operators.scoring import with_probs

CLASS_MAP = {"a": "alpha", "b": "beta", "c": "gamma", "d": "delta"}
HOST_MAP = {"b": "blog", "m": "mobile", "w": "web"}
EXTENSIONS = (".html", ".jpg", ".png")
RATIOS, SEED = SplitRatios(0.70, 0.15, 0.15), 20260425
K = 10
NAMES = [f"c{i}" for i in range(K)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a file: its text the content, its source's number modulo 4 the class."""
    docs = read(spark, sf_dir, "documents")
    code = F.substr(F.lit("abcd"), (F.substring("source", 4, 9).cast("int") % 4 + 1).cast("int"), F.lit(1))
    path = F.col("doc_id").cast("string")
    files = docs.select(path.alias("src_path"), F.concat(path, F.lit(".TXT")).alias("raw_rel_path"), code.alias("class_code"), F.sha2("text", 256).alias("sha256"))
    return files.withColumn("class_name", class_name(F.col("class_code"), CLASS_MAP))


FILES_SQL = """files AS (
  SELECT CAST(doc_id AS VARCHAR) AS src_path, CAST(doc_id AS VARCHAR) || '.TXT' AS raw_rel_path,
         substr('abcd', CAST(substr(source, 4) AS INTEGER) % 4 + 1, 1) AS class_code, sha256(text) AS sha256,
         CASE CAST(substr(source, 4) AS INTEGER) % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS class_name
  FROM documents)"""


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a file below its scheme."""
    rel = F.regexp_replace("url", r"^[a-z]+://", "")
    return read(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("src_path"), rel.alias("raw_rel_path"), F.sha2("html", 256).alias("sha256"))


PAGES_SQL = """parts AS (
  SELECT page_id, url AS src_path, regexp_replace(url, '^[a-z]+://', '') AS raw_rel_path, sha256(html) AS sha256,
         list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: substr(x, 2, 1) = '.' AND substr(x, 1, 1) IN ('b', 'm', 'w')) AS known
  FROM pages),
routed AS (SELECT *, substr(known[1], 1, 1) AS class_code FROM parts)"""


def member(spark: SparkSession, sf_dir: str, start: int = 1) -> DataFrame:
    """(path, true_idx, logits, probs): ten numbers of an embedding are a model's scores."""
    e = read(spark, sf_dir, "embeddings").where(f"label between 0 and {K - 1}")
    logits = F.slice("embedding", start, K).cast("array<double>")
    return with_probs(e.select(F.col("vec_id").cast("string").alias("path"), F.col("label").cast("long").alias("true_idx"), logits.alias("logits")))


def member_sql(name: str, start: int = 1) -> str:
    return f"""{name}_z AS (
  SELECT CAST(vec_id AS VARCHAR) AS path, CAST(label AS BIGINT) AS true_idx,
         CAST(list_slice(embedding, {start}, {start + K - 1}) AS DOUBLE[]) AS z FROM embeddings WHERE label BETWEEN 0 AND {K - 1}),
{name}_e AS (SELECT path, true_idx, z, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM {name}_z),
{name} AS (SELECT path, true_idx, z, list_transform(e, lambda v: v / list_sum(e)) AS probs FROM {name}_e)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch is a day of events: its metrics are shares of event types and a mean value."""
    e = read(spark, sf_dir, "events")
    share = lambda kind: (F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)) / F.count("*"))
    return e.groupBy(F.dayofmonth("ts").cast("long").alias("epoch")).agg(share("purchase").alias("accuracy"), share("view").alias("train_loss"), share("click").alias("val_loss"))


HISTORY_SQL = """history AS (
  SELECT CAST(day(ts) AS BIGINT) AS epoch, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS accuracy,
         sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS train_loss,
         sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS val_loss
  FROM events GROUP BY 1)"""


def scaled_scorer(settings: str):
    """A scorer from outside the registry: its artefact says what to multiply the column z by."""
    scale = json.loads(Path(settings).read_text())["scale"]
    return lambda frame: [[scale * v for v in z] for z in frame["z"]]
