"""Row numbers over large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets - 1 values that part the column about evenly, from the 32 * buckets rows of the least hashes."""
    rows = df.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column), column).limit(32 * buckets).collect()
    values = sorted(r[0] for r in rows)
    return sorted({values[len(values) * i // buckets] for i in range(1, buckets)}) if values else []


def bucket_between(value: Column, bounds: list) -> Column:
    """How many of the bounds are not above the value."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= value)) if bounds else F.lit(0)


def ranked(df: DataFrame, name: str, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """row_number() over (partition by keys order by order), without a task for a whole group.

    `bucket` is an expression that never falls as `order` rises, such as a prefix of the first order key: rows are
    numbered within (keys, bucket), and the counts of the lower buckets are added."""
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return numbered.join(before, [*keys, "_bucket"]).withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before", "_bucket")
