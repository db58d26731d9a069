"""Training telemetry: class weights, losses, batches, learning rates, best epochs and early stopping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import log_softmax


def class_weights(rows: DataFrame, k: int, label: str = "true_idx") -> DataFrame:
    """(class_idx, n, weight): all / (k * n); a class without rows counts as one row."""
    counts = rows.groupBy(F.col(label).cast("long").alias("class_idx")).agg(F.count("*").alias("n"))
    dim = rows.sparkSession.range(k).withColumnRenamed("id", "class_idx")
    joined = counts.join(F.broadcast(dim), "class_idx", "full").withColumn("_all", F.sum("n").over(Window.partitionBy()))  # a row a class
    weight = F.coalesce("_all", F.lit(0)) / (F.lit(k) * F.coalesce("n", F.lit(1)))
    known = F.col("class_idx").between(0, k - 1)
    return joined.where(known).select("class_idx", F.coalesce("n", F.lit(0)).alias("n"), weight.alias("weight"))


def loss_terms(logits: Column, label: Column, weight: Column, weights: Column) -> dict[str, Column]:
    """Sums that a weighted, label-smoothed cross entropy is made of; weights: array of all classes' weights."""
    lp = log_softmax(logits)
    own = F.get(lp, label.cast("int"))
    every = F.aggregate(F.zip_with(lp, weights, lambda a, w: a * w), F.lit(0.0), lambda acc, v: acc + v)
    return {"nll": F.sum(-weight * own), "smooth": F.sum(-every), "weight": F.sum(weight), "rows": F.count("*")}


def losses(rows: DataFrame, k: int, smoothing: float, keys: list[str], weighted: bool = True) -> DataFrame:
    """(keys, rows, loss) of (true_idx, logits) rows, by keys or over all; the k class weights are read first."""
    found = {r.class_idx: r.weight for r in class_weights(rows, k).collect()} if weighted else {}
    weights = F.array(*(F.lit(float(found.get(i, 1.0))) for i in range(k)))
    terms = loss_terms(F.col("logits"), F.col("true_idx"), F.get(weights, F.col("true_idx").cast("int")), weights)
    sums = rows.groupBy(*keys).agg(*(c.alias(f"_{n}") for n, c in terms.items()))
    loss = F.lit(1 - smoothing) * F.col("_nll") / F.col("_weight") + F.lit(smoothing / k) * F.col("_smooth") / F.col("_weight")
    return sums.select(*keys, F.col("_rows").alias("rows"), loss.alias("loss"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """Batch losses weighted by their rows."""
    return batches.agg((F.sum(F.col("loss") * F.col("rows")) / F.sum("rows")).alias("loss"))


def shuffled_batches(rows: DataFrame, key: str, seed: int, epoch: int, size: int) -> DataFrame:
    """Adds position and batch, in the order of a hash of seed, epoch and key: the same on any number of machines."""
    from corvane.functions.ranks import ranked

    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
    df = rows.withColumn("_draw", draw)
    out = ranked(df.withColumn("_one", F.lit(0)), "position", ["_one"], [F.col("_draw"), F.col(key)], F.substring("_draw", 1, 2))
    return out.withColumn("position", F.col("position") - 1).withColumn("batch", F.expr(f"position div {size}")).drop("_draw", "_one")


def cosine_lr(epoch: Column, lr: float, epochs: int) -> Column:
    """The rate recorded after an epoch's step."""
    return F.lit(0.5 * lr) * (1 + F.cos(F.lit(math.pi) * epoch / epochs))


def schedule(spark, lr: float, epochs: int, scheduler: str = "cosine") -> DataFrame:
    if scheduler not in ("cosine", "constant"):
        raise ValueError(f"unknown scheduler: {scheduler}")
    rate = cosine_lr(F.col("epoch"), lr, epochs) if scheduler == "cosine" else F.lit(lr)
    return spark.range(1, epochs + 1).select(F.col("id").alias("epoch"), rate.alias("lr"))


def checkpoints(history: DataFrame, metric: str, patience: int, start: float = -1.0) -> DataFrame:
    """Adds best_so_far, improved and bad_epochs, and cuts after the epoch that ends training.

    An epoch improves if its metric is greater than every earlier one (NaN never is); after `patience` epochs in a row
    that do not, training stops; 0 never stops it. One row an epoch, so the unpartitioned windows stay small."""
    order = Window.partitionBy().orderBy("epoch")
    value = F.coalesce(F.when(~F.isnan(metric), F.col(metric)), F.lit(float("-inf")))
    before = F.greatest(F.lit(start), F.coalesce(F.max("_value").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start)))
    df = history.withColumn("_value", value).withColumn("_before", before)
    df = df.withColumn("improved", F.col("_value") > F.col("_before")).withColumn("best_so_far", F.greatest("_value", "_before"))
    df = df.withColumn("_run", F.sum(F.col("improved").cast("int")).over(order))
    within = Window.partitionBy("_run").orderBy("epoch")
    bad = F.row_number().over(within) - F.when(F.first("improved").over(within), 1).otherwise(0)
    df = df.withColumn("bad_epochs", bad.cast("long"))
    stop = F.min(F.when((F.lit(patience) > 0) & (F.col("bad_epochs") >= patience), F.col("epoch"))).over(Window.partitionBy())
    return df.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop"))).drop("_value", "_before", "_run", "_stop")


def best_checkpoint(history: DataFrame, metric: str, patience: int) -> DataFrame:
    """One row: the last epoch that improved, its metric, and the last epoch that ran."""
    ran = checkpoints(history, metric, patience)
    best = F.max(F.when(F.col("improved"), F.struct("epoch", metric)))
    return ran.agg(best.alias("_b"), F.max("epoch").alias("last_epoch")).select(F.col("_b.epoch").alias("best_epoch"), F.col(f"_b.{metric}").alias("best_metric"), "last_epoch")


def scalar_log(history: DataFrame) -> DataFrame:
    """(epoch, tag, value) of every other column."""
    tags = [c for c in history.columns if c != "epoch"]
    return history.select("epoch", *(F.col(c).cast("double").alias(c) for c in tags)).unpivot(["epoch"], tags, "tag", "value")


def curves(history: DataFrame, wanted=("train_loss", "val_loss"), need_all: bool = True) -> DataFrame | None:
    """Chart rows of the wanted columns; None if a needed one is missing."""
    have = [c for c in wanted if c in history.columns]
    if not have or (need_all and len(have) < len(wanted)):
        return None
    return scalar_log(history.select("epoch", *have))
