"""A linear classifier trained epoch by epoch: each step is one pass of Arrow batches and one sum over all tasks.

A task adds up the gradient and the loss of its rows; Spark sums them by place in the gradient, so what reaches the
driver is as large as the model, whatever the number of rows or tasks. The loss is the cross entropy with label
smoothing, rows weighted by their class's weight and divided by the sum of these. With several steps an epoch the
training rows are dealt into as many buckets once, by a hash of their key, and written by bucket; an epoch reads each
once, in an order drawn from its number.

An epoch is kept as the best if its metric on the validation rows is greater than all before; training ends after
`patience` epochs in a row that are not. Ties in the scores go to the lower class. Rows without a label or features are
left out; an empty training table is an error.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import report, training

METRICS = ("accuracy", "macro_precision", "macro_recall_r1", "macro_f1", "weighted_precision", "weighted_recall_r1", "weighted_f1")


@dataclass(frozen=True)
class Settings:
    epochs: int
    lr: float
    classes: int
    width: int
    optimizer: str = "adamw"
    weight_decay: float = 0.0
    scheduler: str = "cosine"
    smoothing: float = 0.0
    weighted: bool = False
    patience: int = 0
    best_metric: str = "macro_f1"
    steps: int = 1
    seed: int = 0

    def __post_init__(self):
        if self.optimizer not in ("adamw", "sgd"):
            raise ValueError(f"unsupported optimizer: {self.optimizer}")
        if self.scheduler not in ("cosine", "constant"):
            raise ValueError(f"unknown scheduler: {self.scheduler}")
        if self.best_metric not in METRICS:
            raise ValueError(f"unknown metric: {self.best_metric}")

    def rate(self, done: int) -> float:
        """The learning rate after so many epochs."""
        return self.lr if self.scheduler == "constant" else 0.5 * self.lr * (1 + math.cos(math.pi * done / self.epochs))


@dataclass
class Fitted:
    history: list[dict]
    weights: np.ndarray  # classes x (width + 1), of the best epoch; the bias last
    last: np.ndarray
    best_metric: float


def matrix(features: pa.Array, width: int) -> np.ndarray:
    """Rows of features, and a one for the bias."""
    flat = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.hstack([flat.reshape(-1, width), np.ones((len(flat) // width, 1))])


def log_shares(logits: np.ndarray) -> np.ndarray:
    z = logits - logits.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, class_weights: np.ndarray, smoothing: float) -> tuple[float, float, np.ndarray]:
    """Sums over rows: loss, weight, gradient. Smoothing gives each class its share of its own weight."""
    k = len(w)
    lp = log_shares(x @ w.T)
    aim = np.full((len(y), k), smoothing / k) * class_weights
    aim[np.arange(len(y)), y] += (1 - smoothing) * class_weights[y]
    gradient = (np.exp(lp) * aim.sum(axis=1, keepdims=True) - aim).T @ x
    return float(-(aim * lp).sum()), float(class_weights[y].sum()), gradient


def sums(rows: DataFrame, settings: Settings, w: np.ndarray, class_weights: np.ndarray, learn: bool) -> np.ndarray:
    """[loss, weight, rows, then the gradient, or else the confusion matrix] over (features, label) rows."""
    k, width, smoothing = settings.classes, settings.width, settings.smoothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 + (k * (width + 1) if learn else k * k))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column("features"), width), batch.column("label").to_numpy()
            loss, weight, gradient = loss_and_gradient(x, y, w, class_weights, smoothing)
            total[:3] += loss, weight, len(y)
            total[3:] += gradient.ravel() if learn else np.bincount(y * k + (x @ w.T).argmax(axis=1), minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    summed = rows.select("features", "label").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(3 + (k * (width + 1) if learn else k * k))
    for r in summed.collect():  # as many rows as the model has numbers
        out[r["place"]] = r["value"]
    return out


@dataclass
class Optimizer:
    settings: Settings
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, w: np.ndarray, g: np.ndarray, lr: float) -> np.ndarray:
        """AdamW with betas 0.9 and 0.999, or SGD with momentum 0.9."""
        s = self.settings
        self.steps += 1
        if s.optimizer == "sgd":
            self.first = 0.9 * self.first + g + s.weight_decay * w
            return w - lr * self.first
        self.first, self.second = 0.9 * self.first + 0.1 * g, 0.999 * self.second + 0.001 * g * g
        up, down = self.first / (1 - 0.9**self.steps), np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8
        return w * (1 - lr * s.weight_decay) - lr * up / down


def measured(spark: SparkSession, confusion: np.ndarray) -> dict[str, float]:
    k = len(confusion)
    cells = [(i, j, int(confusion[i, j])) for i in range(k) for j in range(k)]
    return report.summary(report.per_class(spark.createDataFrame(cells, "true_idx long, pred_idx long, n long"))).head().asDict()


def fit(train: DataFrame, val: DataFrame, settings: Settings, bucket_dir: str | None = None, each=lambda row: None) -> Fitted:
    """(features array, label, key for several steps) to the history of all epochs and the best weights. `each` is called
    with the row of every epoch; `bucket_dir` is a new folder that all machines share, needed for several steps."""
    s, spark = settings, train.sparkSession
    known = lambda df: df.where(F.col("label").isNotNull() & F.col("features").isNotNull())
    train, val = known(train).withColumn("label", F.col("label").cast("long")), known(val).withColumn("label", F.col("label").cast("long"))
    class_weights = np.ones(s.classes)
    if s.weighted:
        for r in training.class_weights(train, s.classes, "label").collect():
            class_weights[r["class_idx"]] = r["weight"]
    parts = [train]
    if s.steps > 1:
        bucket = F.pmod(F.xxhash64(F.lit(s.seed), "key"), F.lit(s.steps)).cast("int")
        train.select("features", "label", bucket.alias("bucket")).write.partitionBy("bucket").parquet(bucket_dir)
        dealt = spark.read.parquet(bucket_dir)
        parts = [dealt.where(F.col("bucket") == b) for b in range(s.steps)]
    w = np.zeros((s.classes, s.width + 1))
    optimizer, out, bad = Optimizer(s, np.zeros_like(w), np.zeros_like(w)), Fitted([], w, w, -1.0), 0
    for epoch in range(1, s.epochs + 1):
        order = list(range(len(parts)))
        random.Random(f"{s.seed}:{epoch}").shuffle(order)
        loss = rows = 0.0
        for b in order:
            got = sums(parts[b], s, w, class_weights, learn=True)
            if not got[2]:
                continue
            loss, rows = loss + got[0] / got[1] * got[2], rows + got[2]
            w = optimizer.step(w, got[3:].reshape(w.shape) / got[1], s.rate(epoch - 1))
        if not rows:
            raise ValueError("no training row has a label and features")
        seen = sums(val, s, w, class_weights, learn=False)
        row = {"epoch": epoch, "train_loss": float(loss / rows), "val_loss": float(seen[0] / seen[1]) if seen[1] else math.nan, "lr": s.rate(epoch)}
        row |= measured(spark, seen[3:].reshape(s.classes, s.classes))
        out.history.append(row)
        out.last = w
        if row[s.best_metric] > out.best_metric:
            out.best_metric, out.weights, bad = row[s.best_metric], w, 0
        else:
            bad += 1
        each(row)
        if s.patience and bad >= s.patience:
            break
    return out


def byte_shares(content: bytes) -> np.ndarray:
    """How often each byte value stands in a file, as shares: features of any file, without a decoder."""
    return np.bincount(np.frombuffer(content or b"", np.uint8), minlength=256) / max(1, len(content or b""))


FEATURES = {"bytes": (256, byte_shares)}


def featured(rows: DataFrame, kind: str) -> DataFrame:
    """Adds features from the content, which goes."""
    from pyspark.sql import types as T

    width, of = FEATURES[kind]
    names = [c for c in rows.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(x).tolist() for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.list_(pa.float64()))], [*names, "features"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField("features", T.ArrayType(T.DoubleType()))]))


def linear(weights: str, features: str = "bytes"):
    """A scorer of a run that fit() trained: from the contents of files, or from a column of features."""
    w = np.load(weights)["weights"]

    def score(frame):
        x = np.stack([FEATURES[features][1](c) for c in frame["content"]]) if features in FEATURES else np.stack(frame[features].to_list())
        return (np.hstack([x, np.ones((len(x), 1))]) @ w.T).tolist()

    return score
