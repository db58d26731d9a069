"""Jobs over run folders: training, evaluation of splits, ensembles, inference, tables for charts.

A run folder holds config.yaml (its settings, with the scorer: see models.py), class_mapping.json, checkpoints/,
metrics/ (history.csv, best_summary.json, and a folder a split), predictions/, figures/ and logs/. An older run.json
with the scorer and class_to_idx does too. Every table is written by Spark; only counts by class come to the driver.
"""

from __future__ import annotations

import io
import math
import time
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import events, fitting, models, sinks
from corvane.config import EnsembleConfig, TrainConfig
from corvane.functions.vectors import softmax
from corvane.operators import report, scoring, training
from corvane.single_csv import write_single_csv
from corvane.sources import files, tree
from corvane.sources.store import Store

#: What inference takes from a folder.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
ROWS_A_TASK = 2_000


@dataclass(frozen=True)
class Member:
    scorer: models.Scorer
    names: list[str]
    weight: float = 1.0
    settings: dict = field(default_factory=dict)

    @property
    def dataset(self) -> dict:
        return self.settings.get("dataset", {})


def ordered_names(class_to_idx: dict[str, int]) -> list[str]:
    return sorted(class_to_idx, key=class_to_idx.get)


def load_member(spark: SparkSession, run_dir: str, weight: float = 1.0) -> Member:
    store = Store(spark)
    if store.exists(f"{run_dir}/run.json"):
        run = store.load_json(f"{run_dir}/run.json")
        return Member(models.scorer(spark, run["scorer"], run_dir, run.get("args", ())), ordered_names(run["class_to_idx"]), weight, run)
    settings = yaml.safe_load(store.read_text(f"{run_dir}/config.yaml"))
    if "scorer" not in settings:
        raise ValueError(f"{run_dir}/config.yaml names no scorer")
    names = ordered_names(store.load_json(f"{run_dir}/class_mapping.json")["class_to_idx"])
    return Member(models.scorer(spark, settings["scorer"], run_dir), names, weight, settings)


def load_members(spark: SparkSession, cfg: EnsembleConfig) -> list[Member]:
    return [load_member(spark, m["run_dir"], w) for m, w in zip(cfg.members, cfg.weights)]


def new_run(spark: SparkSession, root: str, name: str, settings: dict, class_to_idx: dict[str, int]) -> str:
    """A folder of its own for a run, named by its time, with its settings and classes."""
    path, store = f"{root}/{time.strftime('%Y%m%d_%H%M%S')}_{name}", Store(spark)
    store.write_text(yaml.safe_dump(settings, allow_unicode=True, sort_keys=False), f"{path}/config.yaml")
    store.save_json({"class_to_idx": class_to_idx, "class_names": ordered_names(class_to_idx)}, f"{path}/class_mapping.json")
    return path


def with_members(rows: DataFrame, members: list[Member], normalize: bool, batch_size: int = 64, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds probs: the weighted sum of all members' probabilities. Row by row, so a bag stays a bag and nothing is joined;
    all members score in one pass."""
    scoring.check_class_orders([m.names for m in members])
    rows = models.score_all(rows, [m.scorer for m in members], batch_size, drop)
    each = [softmax(F.get("logits", F.lit(i))) for i in range(len(members))]
    return rows.withColumn("probs", scoring.ensemble(each, [m.weight for m in members], normalize)).drop("logits")


def manifest_of(spark: SparkSession, manifest: str, split: str) -> DataFrame:
    """One split of a manifest: of the table by split, or else of the CSV file or folder beside it."""
    store = Store(spark)
    if any(e.folder and e.name.startswith("split=") for e in store.entries(manifest)):
        return files.read_split(spark, manifest, split)
    return files.read_manifest(spark, f"{manifest}_{split}.csv")


def labelled(spark: SparkSession, manifest: str, split: str, processed_root: str) -> DataFrame:
    """(path, true_idx, content) of one split's materialised files: only the paths are dealt out, and each task reads its
    own files, so no other file is listed or opened."""
    rows = manifest_of(spark, manifest, split).select(F.col("processed_rel_path").alias("path"), F.col("class_idx").alias("true_idx"))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS_A_TASK))
    return tree.with_content(rows.repartition(tasks), processed_root, "path")


def write_report(predicted: DataFrame, names: list[str], out: str) -> dict:
    """Confusion matrix, class metrics, classification report and summary of (true_idx, pred_idx) rows."""
    store = Store(predicted.sparkSession)
    cells = report.confusion(predicted, len(names))
    classes = report.per_class(cells)
    write_single_csv(report.confusion_table(cells, names), f"{out}/confusion_matrix.csv")
    named = classes.withColumn("class", F.element_at(F.array(*map(F.lit, names)), (F.col("idx") + 1).cast("int")))
    write_single_csv(named.orderBy("idx").select("class", *report.MEASURES, "support"), f"{out}/per_class_metrics.csv")
    rows = report.classification_report(classes, names).collect()  # a row a class, and three
    store.save_json({r.label: {"precision": r.precision, "recall": r.recall, "f1-score": r.f1, "support": r.support} for r in rows}, f"{out}/classification_report.json")
    summary = report.summary(classes).head().asDict()
    store.save_json(summary, f"{out}/summary.json")
    return summary


def evaluate(spark: SparkSession, members: list[Member], manifest: str, processed_root: str, splits: list[str], out: str, normalize: bool = False, batch_size: int = 64) -> dict[str, dict]:
    """For each split the table of predictions, as Parquet and as one CSV file in the order of paths, and its reports; one
    member or an ensemble, whose weights count as given."""
    names, found = members[0].names, {}
    for split in splits:
        probs = with_members(labelled(spark, manifest, split, processed_root), members, normalize, batch_size, drop=("content",))
        scoring.predictions(probs, names).write.mode("overwrite").parquet(f"{out}/predictions/{split}")
        predicted = spark.read.parquet(f"{out}/predictions/{split}")
        write_single_csv(scoring.wide(predicted, names), f"{out}/predictions/{split}_predictions.csv", ["path"])
        found[split] = write_report(predicted, names, f"{out}/metrics/{split}")
    return found


def infer(spark: SparkSession, members: list[Member], images: list[str], folder: str | None, k: int, out: str) -> DataFrame:
    """The k best classes of each given image, and of each image below the folder; a path given twice has two rows.
    Weights of several members are divided by their sum."""
    parts = [files.scan_tree(spark, i) for i in images]
    if folder:
        parts.append(files.scan_tree(spark, folder, IMAGE_SUFFIXES))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = with_members(rows.select(F.col("src_path").alias("image"), "content"), members, normalize=True, drop=("content",))
    write_single_csv(scoring.inference(rows, members[0].names, k), out, ["image"])
    return spark.read.options(**files.CSV).csv(out)


def chart_tables(spark: SparkSession, run_dir: str) -> list[str]:
    """The tables that charts of a run read: per split a long confusion matrix and, where there are any, class measures;
    the class metrics of all splits below each other; curves of the history. Returns the splits. The folder may lie in
    any store that Spark reads."""
    store = Store(spark)
    metrics = {e.name: {f.name for f in store.entries(e.path)} for e in store.entries(f"{run_dir}/metrics") if e.folder}
    splits = [s for s, held in metrics.items() if "confusion_matrix.csv" in held]
    for split in splits:
        write_single_csv(files.read_confusion(spark, f"{run_dir}/metrics/{split}/confusion_matrix.csv"), f"{run_dir}/figures/{split}/confusion_matrix.csv")
        if "per_class_metrics.csv" in metrics[split]:
            rows = files.read_reports(spark, files.literal(f"{run_dir}/metrics/{split}/per_class_metrics.csv"))
            write_single_csv(rows.unpivot(["class"], list(report.MEASURES), "measure", "value"), f"{run_dir}/figures/{split}/per_class_metrics.csv")
    reports = [files.literal(f"{run_dir}/metrics/{s}/per_class_metrics.csv") for s, held in metrics.items() if "per_class_metrics.csv" in held]
    if reports:
        write_single_csv(files.read_reports(spark, reports), f"{run_dir}/metrics/per_class_metrics_all_splits.csv", ["split", "class"])
    if path := history_path(store, run_dir):
        history = files.read_history(spark, path)
        for name, wanted, need_all in (("loss", ("train_loss", "val_loss"), True), ("metrics", ("accuracy", "macro_f1", "macro_recall_r1", "weighted_f1"), False)):
            rows = training.curves(history, wanted, need_all)
            if rows is not None:
                write_single_csv(rows, f"{run_dir}/figures/{name}_curve.csv", ["tag", "epoch"])
    return splits


def history_path(store: Store, run_dir: str) -> str | None:
    """Where a run's history stands: among its metrics, or in older runs at the top."""
    return next((p for p in (f"{run_dir}/metrics/history.csv", f"{run_dir}/history.csv") if store.exists(p)), None)


def best_summary(spark: SparkSession, run_dir: str, metric: str, patience: int) -> dict:
    """The best epoch of a run's history, kept as best_summary.json beside it."""
    store = Store(spark)
    path = history_path(store, run_dir)
    found = training.best_checkpoint(files.read_history(spark, path), metric, patience).head().asDict()
    store.save_json(found | {"best_metric_name": metric}, f"{path.rpartition('/')[0]}/best_summary.json")
    return found


def _save_weights(store: Store, path: str, weights: np.ndarray) -> None:
    held = io.BytesIO()
    np.savez(held, weights=weights)
    store.write_bytes(held.getvalue(), path)


def train(spark: SparkSession, raw: dict, say=print) -> str:
    """Trains the linear classifier of fitting.py on a prepared corpus and returns its run folder, which evaluate, ensemble
    and infer then take. After each epoch the history, the last weights and, if it was the best, the best ones are kept."""
    cfg, store = TrainConfig.from_dict(raw), Store(spark)
    class_to_idx = store.load_json(cfg.class_to_idx)
    out = new_run(spark, cfg.output_root, cfg.run_name, raw | {"scorer": {"factory": "corvane.fitting:linear", "artifacts": {"weights": "checkpoints/best.npz"}, "args": {"features": cfg.features}}}, class_to_idx)
    width = fitting.FEATURES[cfg.features][0]
    settings = fitting.Settings(classes=len(class_to_idx), width=width, seed=cfg.seed, **cfg.fit)
    manifest = f"{cfg.manifest_dir}/{Path(cfg.processed_root).name}"
    work = f"{out}/work"
    for split in ("train", "val"):  # features are made once, not every epoch
        rows = labelled(spark, manifest, split, cfg.processed_root).select(F.col("path").alias("key"), F.col("true_idx").alias("label"), "content")
        fitting.featured(rows, cfg.features).write.parquet(f"{work}/{split}")
    history: list[dict] = []

    def each(row: dict) -> None:
        history.append(row)
        say(f"epoch={row['epoch']} train_loss={row['train_loss']:.4f} val_loss={row['val_loss']:.4f} {settings.best_metric}={row[settings.best_metric]:.4f}")
        store.write_text(sinks.csv_text(history), f"{out}/metrics/history.csv")

    try:
        fitted = fitting.fit(spark.read.parquet(f"{work}/train"), spark.read.parquet(f"{work}/val"), settings, f"{work}/dealt", each)
    finally:
        store.delete(work)
    _save_weights(store, f"{out}/checkpoints/best.npz", fitted.weights)
    _save_weights(store, f"{out}/checkpoints/last.npz", fitted.last)
    if len(history) < settings.epochs:
        say(f"Early stopping at epoch {history[-1]['epoch']}")
    log = training.scalar_log(files.read_history(spark, f"{out}/metrics/history.csv"))
    events.write_events(log, f"{out}/logs/tensorboard", "scalars").collect()
    store.save_json({"best_metric": fitted.best_metric, "best_metric_name": settings.best_metric}, f"{out}/metrics/best_summary.json")
    return out
