"""python -m corvane.cli audit|prepare|train|evaluate|ensemble|infer|report|visualize ...: the batch jobs."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane import jobs, schemas, sinks
from corvane.config import DatasetConfig, EnsembleConfig, check_inference_arguments, load_yaml
from corvane.operators import audit, curate, integrity
from corvane.single_csv import write_single_csv
from corvane.sources import files
from corvane.sources.store import Store

INTEGRITY = ("structure", "magic")


def _routed(spark: SparkSession, cfg: DatasetConfig, strict: bool, check: str | None) -> DataFrame:
    """Hashed and routed files; only those of the wanted suffixes are opened. check: how unreadable ones are told."""
    rows = files.scan_tree(spark, cfg.raw_root, cfg.image_extensions, content=check is not None, hidden=strict, sha256=True)
    if check == "structure":
        rows = rows.withColumn("_fault", integrity.image_faults(F.col("content")))
        return audit.routed(rows, cfg.class_map, readable=F.col("_fault").isNull(), error=F.col("_fault")).drop("_fault")
    if check == "magic":
        return audit.routed(rows, cfg.class_map, readable=audit.looks_like_image(F.col("content")), error=audit.image_fault(F.col("length"), F.col("content")))
    return audit.routed(rows, cfg.class_map)


def run_audit(spark: SparkSession, cfg: DatasetConfig, strict: bool = False, check: str = "structure") -> dict:
    """Writes the five audit tables, each one CSV file in order, and returns the counters, which are observed while the
    tables are written; the tree is read and hashed once."""
    routed, repeated = Observation("routed"), Observation("repeated")
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    rows = _routed(spark, cfg, strict, check).drop("content").observe(routed, of(audit.VALID), of(audit.INVALID), of(audit.ERROR))
    rows.write.mode("overwrite").parquet(f"{cfg.audit_dir}/routed")
    rows = spark.read.parquet(f"{cfg.audit_dir}/routed")
    valid = audit.valid_files(rows)
    audit.duplicate_files(valid).observe(repeated, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{cfg.audit_dir}/duplicates")
    tables = {
        "valid_images": (valid, ["src_path"]), "invalid_files": (audit.invalid_files(rows), ["path"]), "image_errors": (audit.file_errors(rows), ["path"]),
        "duplicate_files": (spark.read.parquet(f"{cfg.audit_dir}/duplicates"), ["sha256", "path"]), "class_counts": (audit.class_counts(valid), ["class_code", "class_name"]),
    }
    for name, (table, by) in tables.items():
        write_single_csv(table, f"{cfg.audit_dir}/{name}.csv", by)
    found = routed.get
    return {"valid": found[audit.VALID], "invalid": found[audit.INVALID], "errors": found[audit.ERROR], "duplicates": repeated.get["n"]}


def run_prepare(spark: SparkSession, cfg: DatasetConfig, force: bool = False, strict: bool = False, validate: bool = False) -> dict:
    """Curates, splits, numbers and materialises the corpus; writes its manifests and returns counts by split, class.

    All of it is written beside its places and takes them in the end: a job that dies leaves the former corpus whole.
    validate: files that the audit calls unreadable stay out."""
    store, path = Store(spark), f"{cfg.manifest_dir}/{cfg.dataset_name}"
    if store.holds_something(cfg.processed_root) and not (force or cfg.overwrite_processed):
        raise FileExistsError(f"{cfg.processed_root} holds something")
    rows = _routed(spark, cfg, strict, "structure" if validate else None).where(F.col("status") == audit.VALID)
    rows.drop("content").write.mode("overwrite").parquet(f"{cfg.manifest_dir}/hashed")
    rows = spark.read.parquet(f"{cfg.manifest_dir}/hashed")
    if rows.isEmpty():
        raise ValueError(f"{cfg.raw_root} holds no file of a known class")
    curate.curated(rows, cfg.exclude_cross_class_duplicates)  # raises where none may be left out
    curate.check_classes(curate.quotas(curate.clean_groups(rows), cfg.split))
    splits = ("train", "val", "test")
    lists = [f"{path}_{s}.csv" for s in ("all", *splits)]
    conflicts = f"{cfg.audit_dir}/cross_class_duplicates.csv"
    documents = [f"{cfg.manifest_dir}/class_to_idx.json", f"{cfg.manifest_dir}/split_config.json"]
    with store.published(cfg.processed_root, path, *lists, conflicts, *documents) as (corpus, table, *named, said, index, settings):
        write_single_csv(curate.conflicts(rows), said, ["sha256", "class_name", "src_path"])
        split = curate.with_class_index(curate.split_manifest(rows, cfg.split, cfg.seed), curate.class_index(spark, cfg.class_map))
        columns = schemas.MANIFEST.names
        sinks.write_manifest(curate.with_processed_path(split, paths=rows).select(*columns), table)
        manifest = spark.read.parquet(table)
        write_single_csv(manifest.select(*columns), named[0], ["split", "class_name", "src_path"])
        for one, target in zip(splits, named[1:]):
            write_single_csv(manifest.where(F.col("split") == one).select(*columns), target, ["class_name", "src_path"])
        sinks.materialise(manifest, corpus, cfg.copy_mode)
        store.save_json(cfg.class_to_idx, index)
        ratios = {"train": cfg.split.train, "val": cfg.split.val, "test": cfg.split.test}
        store.save_json({"dataset_name": cfg.dataset_name, "seed": cfg.seed, "split": ratios, "class_to_idx": cfg.class_to_idx}, settings)
        counts = {(r.split, r.class_name): r["count"] for r in curate.split_class_counts(manifest).collect()}
    return counts


def run_report(spark: SparkSession, predictions: str, names: list[str], out: str) -> dict:
    """Confusion matrix, class metrics, report and summary of a table of predictions."""
    return jobs.write_report(spark.read.parquet(predictions), names, out)


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One run, or an ensemble, over the splits; the run's settings say where corpus and manifest are, unless given."""
    if args.job == "evaluate":
        members, out, manifest_dir = [jobs.load_member(spark, args.run_dir)], args.run_dir, None
    else:
        raw = load_yaml(args.config)
        cfg = EnsembleConfig.from_dict(raw)
        members, manifest_dir = jobs.load_members(spark, cfg), cfg.manifest_dir
        out = jobs.new_run(spark, cfg.output_root, cfg.ensemble_name, raw, {n: i for i, n in enumerate(members[0].names)})
    dataset = members[0].dataset
    root = args.processed_root or dataset["processed_root"]
    manifest = args.manifest or f"{manifest_dir or dataset['manifest_dir']}/{Path(root).name}"
    found = jobs.evaluate(spark, members, manifest, root, args.splits, out, getattr(args, "normalize", False), args.batch_size)
    print(f"Saved to {out}")
    return found


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="job", required=True)
    for job in ("audit", "prepare"):
        p = commands.add_parser(job)
        p.add_argument("--config", default="configs/dataset.yaml")
        p.add_argument("--strict", action="store_true", help="take hidden files too")
        if job == "audit":
            p.add_argument("--check", choices=INTEGRITY, default=INTEGRITY[0], help="walk whole files, or look at their first bytes")
        else:
            p.add_argument("--force", action="store_true")
            p.add_argument("--validate", action="store_true", help="leave out files that are no whole images")
    commands.add_parser("train").add_argument("--config", required=True)
    p = commands.add_parser("report")
    p.add_argument("--predictions", required=True)
    p.add_argument("--classes", required=True, help="class_to_idx.json")
    p.add_argument("--out", required=True)
    for job in ("evaluate", "ensemble"):
        p = commands.add_parser(job)
        p.add_argument("--manifest", help="the manifest table, in place of the one that the settings name")
        p.add_argument("--processed-root")
        p.add_argument("--split", "--splits", dest="splits", nargs="+", default=["test"])
        p.add_argument("--batch-size", type=int, default=64)
        if job == "evaluate":
            p.add_argument("--run-dir", required=True)
        else:
            p.add_argument("--config", default="configs/ensemble.yaml")
            p.add_argument("--normalize", action="store_true", help="divide the weights by their sum")
    p = commands.add_parser("infer")
    p.add_argument("--image", action="append", default=[])
    p.add_argument("--image-dir")
    p.add_argument("--run-dir")
    p.add_argument("--ensemble-config")
    p.add_argument("--output", default="outputs/inference_predictions.csv")
    p.add_argument("--top-k", type=int, default=4)
    p = commands.add_parser("visualize")
    p.add_argument("--run-dir", required=True)
    args = parser.parse_args(argv)
    if args.job == "infer":
        check_inference_arguments([*args.image, *filter(None, [args.image_dir])], args.run_dir, args.ensemble_config, args.top_k)
    spark = SparkSession.builder.appName(f"corvane {args.job}").getOrCreate()
    if args.job == "report":
        print(run_report(spark, args.predictions, jobs.ordered_names(files.load_json(args.classes)), args.out))
    elif args.job in ("evaluate", "ensemble"):
        print(run_evaluate(spark, args))
    elif args.job == "infer":
        members = [jobs.load_member(spark, args.run_dir)] if args.run_dir else jobs.load_members(spark, EnsembleConfig.from_dict(load_yaml(args.ensemble_config)))
        jobs.infer(spark, members, args.image, args.image_dir, args.top_k, args.output).show(truncate=False)
        print(f"Saved to {args.output}")
    elif args.job == "visualize":
        print(jobs.chart_tables(spark, args.run_dir))
    elif args.job == "train":
        print(f"Saved to {jobs.train(spark, load_yaml(args.config))}")
    else:
        cfg = DatasetConfig.from_dict(load_yaml(args.config))
        print(run_audit(spark, cfg, args.strict, args.check) if args.job == "audit" else run_prepare(spark, cfg, args.force, args.strict, args.validate))


if __name__ == "__main__":
    main()
