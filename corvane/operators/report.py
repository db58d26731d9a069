"""Classification reports from (true, predicted) pairs: one aggregate over the rows, then K x K counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labels(spark, k: int) -> DataFrame:
    return spark.range(k).withColumnRenamed("id", "idx")


def confusion(predictions: DataFrame, k: int, true: str = "true_idx", pred: str = "pred_idx") -> DataFrame:
    """(true_idx, pred_idx, n) for all k * k pairs, zeros included."""
    counts = predictions.groupBy(F.col(true).cast("long").alias("true_idx"), F.col(pred).cast("long").alias("pred_idx")).agg(F.count("*").alias("n"))
    dim = labels(predictions.sparkSession, k)
    grid = dim.select(F.col("idx").alias("true_idx"), F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")).alias("pred_idx"))
    return grid.join(counts, ["true_idx", "pred_idx"], "left").select("true_idx", "pred_idx", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(cells: DataFrame, names: list[str]) -> DataFrame:
    """A row a true class, a column a predicted one."""
    columns = [F.sum(F.when(F.col("pred_idx") == i, F.col("n")).otherwise(0)).cast("long").alias(n) for i, n in enumerate(names)]
    return cells.groupBy("true_idx").agg(*columns)


def confusion_table(cells: DataFrame, names: list[str]) -> DataFrame:
    """The same with the class's name first, in the order of the names."""
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("true_idx") + 1).cast("int")).alias("class")
    return confusion_wide(cells, names).orderBy("true_idx").select(named, *names)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def per_class(cells: DataFrame) -> DataFrame:
    """(idx, tp, predicted, support, precision, recall_r1, f1); 0 where nothing is to be divided by."""
    both = F.array(F.struct(F.col("true_idx").alias("idx"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred_idx").alias("idx"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    hit = F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)
    sums = cells.select(hit.alias("hit"), F.explode(both).alias("s")).groupBy("s.idx").agg(
        F.expr("sum(hit) div 2").alias("tp"), F.sum("s.predicted").alias("predicted"), F.sum("s.support").alias("support")
    )
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return sums.select("idx", "tp", "predicted", "support", _ratio(tp, predicted).alias("precision"), _ratio(tp, support).alias("recall_r1"), _ratio(2 * tp, predicted + support).alias("f1"))


MEASURES = ("precision", "recall_r1", "f1")


def summary(classes: DataFrame, with_support: bool = False) -> DataFrame:
    """One row: accuracy, macro and weighted means; with_support: also the rows that they are of."""
    n = F.sum("support")
    macro = [F.avg(m).alias(f"macro_{m}") for m in MEASURES]
    weighted = [_ratio(F.sum(F.col("support") * F.col(m)), n).alias(f"weighted_{m}") for m in MEASURES]
    return classes.agg(_ratio(F.sum("tp"), n).alias("accuracy"), *macro, *weighted, *([n.alias("support")] if with_support else []))


def classification_report(classes: DataFrame, names: list[str]) -> DataFrame:
    """(label, precision, recall, f1, support) of each class, then of accuracy and both means."""
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("idx") + 1).cast("int"))
    rows = classes.select(named.alias("label"), "precision", F.col("recall_r1").alias("recall"), "f1", "support")
    s = summary(classes, with_support=True)
    mean = lambda kind: s.select(F.lit(f"{kind} avg").alias("label"), *(F.col(f"{kind}_{m}") for m in MEASURES), "support")
    accuracy = s.select(F.lit("accuracy").alias("label"), *[F.col("accuracy")] * 3, "support")
    return rows.union(accuracy).union(mean("macro")).union(mean("weighted"))


def chart_rows(classes: DataFrame, names: list[str]) -> DataFrame:
    """(class, measure, value) for grouped bars."""
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("idx") + 1).cast("int"))
    return classes.withColumn("class", named).unpivot(["class"], list(MEASURES), "measure", "value")


def per_split(reports: dict[str, DataFrame]) -> DataFrame:
    """The reports of several splits below each other, with the split's name first."""
    out = None
    for split, report in reports.items():
        one = report.select(F.lit(split).alias("split"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no reports")
    return out
