"""What the operators of this folder share: input normalisation, scratch tables and Arrow slicing."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of a Python worker handles at once.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text becomes empty, all other columns go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one of our own only where that is unset and all runs on one
    machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir names the shared folder for intermediate tables")
    if not found:
        found = getattr(spark, "_corvane_shared", None) or f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark._corvane_shared = found
    return found.rstrip("/")


class Scratch:
    """Tables written once to the shared folder, so that nothing is computed twice and lost executors cost no lineage.

    Whoever makes one may release it once all that reads its tables is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


    def release(self) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the machine: Python workers live on for later stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about `limit` bytes of the column; a longer row stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
        give_back()


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).head()[0] or 0


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows as one literal."""
    fields = [part.split() for part in schema.split(", ")]
    text = json.dumps([dict(zip((name for name, _ in fields), r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(f'{name}:{kind}' for name, kind in fields)}>>")))


PART_ROWS, PARTS = 512, 100_000


def numbered(rows: DataFrame, key: str, counts: dict[int, int], order: list[str], spread: Column, drawn: Column | None = None, part_rows: int | None = None) -> DataFrame:
    """Adds _row, from 0 within each value of the integer column `key`, of which counts says how many rows it has (there
    are so few values that the driver holds them). A value with more than part_rows rows is dealt into parts by `spread`,
    so no value fills a task; a part that holds far more, as of many equal rows, is dealt once more by `drawn`. Rows are in
    order within a part. By default parts are of PART_ROWS rows, and larger where there would be more than about PARTS of
    them. A drawn number is stored with its row, as it must not change."""
    part_rows = part_rows or max(PART_ROWS, sum(counts.values()) // PARTS)
    kind = rows.schema[key].dataType.simpleString()
    parts = small_table(rows.sparkSession, [(k, n // part_rows + 1) for k, n in counts.items()], f"{key} {kind}, _parts int")
    parted = rows.join(F.broadcast(parts), key).withColumn("_part", F.pmod(spread, F.col("_parts")).cast("int"))
    if drawn is None:
        parted = parted.withColumn("_sub", F.lit(0))
    else:
        held = parted.where("_parts > 1").groupBy(key, "_part").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * part_rows)
        again = F.pmod(drawn, F.floor(F.col("_n") / part_rows) + 1).cast("int")
        parted = parted.join(held, [key, "_part"], "left").withColumn("_sub", F.coalesce(again, F.lit(0))).drop("_n")
    place = [key, "_part", "_sub"]
    out = parted.withColumn("_row", F.row_number().over(Window.partitionBy(*place).orderBy(*order)).cast("long") - 1)
    earlier = Window.partitionBy(key).orderBy("_part", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.where("_parts > 1").groupBy(*place).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    return out.join(sizes, place, "left").withColumn("_row", F.col("_row") + F.coalesce("_before", F.lit(0))).drop("_part", "_sub", "_parts", "_before")
