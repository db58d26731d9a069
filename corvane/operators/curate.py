"""Curation: labels that contradict each other, content groups, leak-free stratified splits, manifests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SplitRatios
from corvane.functions.paths import numbered_path, suffix
from corvane.functions.ranks import bucket_between, ranked, sampled_bounds


def conflicting_hashes(files: DataFrame) -> DataFrame:
    """Contents found under more than one class name."""
    names = files.groupBy("sha256").agg(F.min("class_name").alias("least"), F.max("class_name").alias("most"))
    return names.where("least <> most").select("sha256")


def conflicts(files: DataFrame) -> DataFrame:
    return files.join(conflicting_hashes(files), "sha256", "left_semi").select("src_path", "raw_rel_path", "class_code", "class_name", "sha256")


def curated(files: DataFrame, exclude_conflicts: bool = True) -> DataFrame:
    """Files without those of contradicting contents; or an error if there are any and none may be left out."""
    bad = conflicting_hashes(files)
    if exclude_conflicts:
        return files.join(bad, "sha256", "left_anti")
    if not bad.isEmpty():
        raise ValueError("some contents stand under several classes")
    return files


def content_groups(files: DataFrame) -> DataFrame:
    """(sha256, class_name) of each content's first file by class code and path."""
    first = files.groupBy("sha256").agg(F.min(F.struct("class_code", "src_path", "class_name")).alias("first"))
    return first.select("sha256", "first.class_name")


def clean_groups(files: DataFrame) -> DataFrame:
    """content_groups of curated files, by one aggregate of all files."""
    first = F.min(F.struct("class_code", "src_path", "class_name")).alias("first")
    groups = files.groupBy("sha256").agg(first, F.min("class_name").alias("least"), F.max("class_name").alias("most"))
    return groups.where("least = most").select("sha256", "first.class_name")


def _cut(counts: DataFrame, n: str, ratio: float, name: str) -> DataFrame:
    """Adds `name`: the shares of floor(ratio * all) that classes take by largest remainder, ties by class name.

    One row a class: the windows below see no more rows than there are classes."""
    everything = Window.partitionBy()
    ranks = Window.partitionBy().orderBy(F.desc("_rem"), "class_name")
    whole = F.sum(n).over(everything)
    df = counts.withColumn("_all", whole.cast("long")).withColumn("_take", F.floor(F.lit(Decimal(str(ratio))) * F.col("_all")).cast("long"))
    df = df.withColumn("_base", F.expr(f"coalesce(_take * {n} div nullif(_all, 0), 0)")).withColumn("_rem", F.expr(f"coalesce(_take * {n} % nullif(_all, 0), 0)"))
    df = df.withColumn("_more", F.row_number().over(ranks) <= F.col("_take") - F.sum("_base").over(everything))
    return df.withColumn(name, (F.col("_base") + F.col("_more").cast("long")).cast("long")).drop("_all", "_take", "_base", "_rem", "_more")


def quotas(groups: DataFrame, ratios: SplitRatios) -> DataFrame:
    """(class_name, n, train, val, test): how many contents of each class each split takes."""
    counts = groups.groupBy("class_name").agg(F.count("*").alias("n"))
    first = _cut(counts, "n", ratios.train, "train").withColumn("rest", F.col("n") - F.col("train"))
    second = _cut(first, "rest", ratios.val_of_rest, "val")
    return second.select("class_name", "n", "train", "val", (F.col("rest") - F.col("val")).alias("test"))


def check_classes(counts: DataFrame) -> None:
    small = [r.class_name for r in counts.where("n < 2").select("class_name").limit(5).collect()]
    if small:
        raise ValueError(f"classes with fewer than two contents cannot be split: {small}")


def draw_key(sha256: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), sha256))


def split_groups(groups: DataFrame, ratios: SplitRatios, seed: int) -> DataFrame:
    """(sha256, class_name, split): a class's contents are drawn in the order of a seeded hash.

    The hash's first digits divide each class into 256 buckets in the same order, so no class fills a task."""
    keyed = groups.withColumn("_draw", draw_key(F.col("sha256"), seed))
    drawn = ranked(keyed, "_rank", ["class_name"], [F.col("_draw"), F.col("sha256")], F.substring("_draw", 1, 2))
    drawn = drawn.join(F.broadcast(quotas(groups, ratios)), "class_name")  # one row a class
    split = F.when(F.col("_rank") <= F.col("train"), "train").when(F.col("_rank") <= F.col("train") + F.col("val"), "val").otherwise("test")
    return drawn.select("sha256", "class_name", split.alias("split"))


def split_manifest(files: DataFrame, ratios: SplitRatios, seed: int) -> DataFrame:
    """Curated files with the split of their content: files of one content share it.

    Contents that contradict each other have no split, so the inner join leaves their files out."""
    return files.join(split_groups(clean_groups(files), ratios, seed).select("sha256", "split"), "sha256")


def split_class_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split", "class_name").agg(F.count("*").alias("count"))


def leakage(manifest: DataFrame) -> DataFrame:
    """One row: contents, and how many of them stand in several splits."""
    spread = manifest.groupBy("sha256").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return spread.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), 1)), F.lit(0)).cast("long").alias("leaks"))


def class_index(spark, class_map: dict[str, str]) -> DataFrame:
    names = list(dict.fromkeys(class_map.values()))
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "class_name string, class_idx bigint")


def with_class_index(manifest: DataFrame, index: DataFrame) -> DataFrame:
    return manifest.join(F.broadcast(index), "class_name", "left")  # one row a class


def with_processed_path(manifest: DataFrame, buckets: int = 128, paths: DataFrame | None = None) -> DataFrame:
    """Adds processed_rel_path: a number from 1 within split and class, in the order of src_path.

    Ordered buckets between sampled paths divide each class, whatever the paths begin with. `paths`: a written table with
    the manifest's src_path to sample from, so that the manifest is not computed for that."""
    bounds = sampled_bounds(manifest if paths is None else paths, "src_path", buckets)
    out = ranked(manifest, "_ordinal", ["split", "class_name"], [F.col("src_path")], bucket_between(F.col("src_path"), bounds))
    path = numbered_path(F.col("split"), F.col("class_name"), F.col("_ordinal"), suffix(F.col("raw_rel_path")))
    return out.withColumn("processed_rel_path", path).drop("_ordinal")
