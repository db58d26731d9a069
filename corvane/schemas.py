"""Schemas of the tables that jobs read and write, in column order."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType()}


def _struct(columns: str) -> T.StructType:
    """From "name type, ..."; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


VALID_FILES = _struct("src_path string, class_code string, class_name string, sha256 string")
INVALID_FILES = _struct("path string, reason string")
FILE_ERRORS = _struct("path string, error string")
DUPLICATE_FILES = _struct("sha256 string, path string, count bigint")
CLASS_COUNTS = _struct("class_code string, class_name string, count bigint")
CONFLICTS = _struct("src_path string, raw_rel_path string, class_code string, class_name string, sha256 string")
MANIFEST = _struct(
    "src_path string, raw_rel_path string, class_code string, class_name string, sha256 string, split string, class_idx bigint, processed_rel_path string"
)
PREDICTIONS = _struct("path string, true_idx bigint, true_class string, pred_idx bigint, pred_class string, confidence double")
CLASS_METRICS = _struct("class string, precision double, recall_r1 double, f1 double, support bigint")
SUMMARY = _struct(
    "accuracy double, macro_precision double, macro_recall_r1 double, macro_f1 double, weighted_precision double, weighted_recall_r1 double, weighted_f1 double"
)
HISTORY = T.StructType([*_struct("epoch bigint, train_loss double, val_loss double, lr double").fields, *SUMMARY.fields])
SPLIT_METRICS = T.StructType([T.StructField("split", T.StringType()), *CLASS_METRICS.fields])
