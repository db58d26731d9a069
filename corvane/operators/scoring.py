"""Scores to predictions: members, ensembles, top-k, and batch scorers in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.vectors import added, argmax, class_at, scaled, softmax, top_k

#: name -> factory of a function from a pandas frame to a list of logits a row; made once in each task.
SCORERS: dict[str, Callable[[], Callable[[pd.DataFrame], list]]] = {}


def scorer(name: str):
    def register(factory):
        SCORERS[name] = factory
        return factory

    return register


@scorer("slice")
def _slice_scorer(start: int = 0, length: int = 10):
    """A stand-in for a model: a part of an embedding."""
    return lambda frame: [[float(x) for x in v[start : start + length]] for v in frame["embedding"]]


def score(rows: DataFrame, name: str, *args) -> DataFrame:
    """Adds logits array<double> by a registered scorer."""
    factory = SCORERS[name]
    schema = T.StructType([*rows.schema.fields, T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(*args)
        for frame in frames:
            yield frame.assign(logits=model(frame))

    return rows.mapInPandas(run, schema)


def check_class_orders(orders: list[list[str]]) -> None:
    if any(o != orders[0] for o in orders[1:]):
        raise ValueError("members do not share one order of classes")


def ensemble(probs: list[Column], weights: list[float], normalize: bool) -> Column:
    """The weighted sum of members' probabilities in one row; normalize divides the weights by their sum."""
    if len(probs) != len(weights) or not probs:
        raise ValueError("one weight for each member")
    all_ = sum(weights)
    out = None
    for p, w in zip(probs, weights):
        part = scaled(p, w / all_ if normalize else w)
        out = part if out is None else added(out, part)
    return out


def ensemble_members(members: list[DataFrame], weights: list[float], normalize: bool, key: str = "path") -> DataFrame:
    """Joins (key, probs) tables of members on the key, never by position, and combines them."""
    joined = members[0].select(key, F.col("probs").alias("_p0"))
    for i, m in enumerate(members[1:], 1):
        joined = joined.join(m.select(key, F.col("probs").alias(f"_p{i}")), key)
    return joined.select(key, ensemble([F.col(f"_p{i}") for i in range(len(members))], weights, normalize).alias("probs"))


def store_member(scores: DataFrame, path: str, buckets: int, key: str = "path") -> DataFrame:
    """Scores of a member written in buckets of the key, sorted by it. Members stored in equally many buckets join bucket
    by bucket: once written, no ensemble of them shuffles a row."""
    name = f"member_{uuid.uuid4().hex}"
    scores.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    return scores.sparkSession.table(name)


def predictions(rows: DataFrame, names: list[str]) -> DataFrame:
    """(path, true_idx, probs) to the table of predictions, probs kept as the last column."""
    p = F.col("probs")
    out = rows.withColumn("pred_idx", argmax(p).cast("long")).withColumn("confidence", F.array_max(p))
    return out.select(
        "path", F.col("true_idx").cast("long").alias("true_idx"), class_at(names, F.col("true_idx")).alias("true_class"),
        "pred_idx", class_at(names, F.col("pred_idx")).alias("pred_class"), "confidence", "probs",
    )


def wide(predicted: DataFrame, names: list[str]) -> DataFrame:
    """A prob_<class> column for each class in place of the array."""
    return predicted.select(*(c for c in predicted.columns if c != "probs"), *(F.get("probs", F.lit(i)).alias(f"prob_{n}") for i, n in enumerate(names)))


def inference(rows: DataFrame, names: list[str], k: int) -> DataFrame:
    """(image, probs) to the best class and the k best classes with their probabilities."""
    k = min(k, len(names))
    df = rows.withColumn("_top", top_k(F.col("probs"), k))
    best = [class_at(names, F.get("_top", F.lit(0))["idx"]).alias("pred_class"), F.get("_top", F.lit(0))["prob"].alias("confidence")]
    for r in range(k):
        one = F.get("_top", F.lit(r))
        best += [class_at(names, one["idx"]).alias(f"top{r + 1}_class"), one["prob"].alias(f"top{r + 1}_prob")]
    return df.select("image", *best)


def with_probs(rows: DataFrame, logits: str = "logits") -> DataFrame:
    return rows.withColumn("probs", softmax(F.col(logits)))
