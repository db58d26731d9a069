"""A training corpus in five stages: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage is a function of (spark, docs, sf_dir); run() writes each result as Parquet, reads it again and hands it to
the next stage as docs. All but the last return the columns of documents; n_chars follows the text. A stage's scratch
tables belong to its caller: run() drops those of a stage once its result is written, and what a stage called without any
makes stays, so stages can also be chained before anything is written.

Cases: a null text is empty, and quality_rules rejects it, as it does all texts of under 20 words. Null ids, sources and
languages stay null; rows without an id stand last. Of repeated rows near_dedup keeps one, of rows that only share an id
each, if their texts differ enough. Ties go to the least id, then to a hash of the text. Empty tables give empty ones.
Columns beyond those of documents are dropped.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, delete, read, shared_dir
from corvane.llm.lines import deduplicate_lines
from corvane.llm.packing import place, tokenised_pieces
from corvane.llm.quality import fit, judge
from corvane.llm.simhash import keep_one
from corvane.llm.substrings import repeated_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _texts(docs: DataFrame) -> DataFrame:
    """Null texts become empty."""
    return docs.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit("")))


def _unpacked(df: DataFrame) -> DataFrame:
    """The columns of documents from (doc_id, text, rest); n_chars counts anew."""
    out = df.select("doc_id", "text", "rest.lang", "rest.source", F.char_length("text").cast("long").alias("n_chars"))
    return out.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that fail the base rules or the classifier go."""
    docs = _texts(docs)
    model = fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judge(docs, model).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Lines go that repeat an earlier one, those of five words or more within one edited word."""
    return _unpacked(deduplicate_lines(_texts(docs), scratch or Scratch(spark)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Of documents linked by SimHash, or by a Jaccard similarity of 0.8 or more, of five-word shingles one stays."""
    return keep_one(_texts(docs), scratch=scratch or Scratch(spark))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Text goes that a string of 100 bytes covers which starts earlier."""
    return _unpacked(repeated_spans(_texts(docs), with_text=True))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    pieces = tokenised_pieces(_texts(docs), public_tokenizers.path("word_bpe_49k.json"))
    return place((scratch or Scratch(spark)).table(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Training a classifier, tokenizing and packing are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    root, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        scratch = Scratch(spark)
        stage(spark, docs, sf_dir, scratch).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        scratch.release()
        if before:  # only the last stage's rows are read from here on
            delete(spark, f"{root}/{before}")
        before = name
    return docs
