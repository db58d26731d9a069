"""SimHash near-duplicates: fingerprints of word shingles linked at few differing bits, by pigeonhole blocks.

A fingerprint is cut into BLOCKS blocks; two that differ in at most `bits` bits agree in BLOCKS - bits of them. Each
distinct fingerprint is keyed by every choice of so many blocks, and fingerprints that share a key are compared. A
group of over GROUP fingerprints under one key is not compared pair by pair: each of its members is keyed by itself and
its single-bit neighbours instead. Two fingerprints at two bits or fewer share such a neighbour and at most 65 can
share one, so no link is lost and no group grows with its square. Copies share a fingerprint and are never paired.

Cases: a null text is empty; texts without words have fingerprint zero and link like any other. Ties go to the least
id; null ids never represent a component unless it has no other (then its component_id is null). Repeated rows get the
same component. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import Scratch, id_text, read, slices
from corvane.llm.components import connected_components
from corvane.llm.similar import similar_links

BLOCKS = 5
GROUP = 64
SEED = 42


def text_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 of every word shingle, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z and the white space of ASCII
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[shingle - 1 :]
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())]


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """Replaces the text by its fingerprint, fp long; other columns stay."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            hashes = [text_hashes(t or "", shingle) for t in batch.column("text").to_pylist()]
            n = np.fromiter(map(len, hashes), np.int64, len(hashes))
            each = np.fromiter((h for one in hashes for h in one), np.uint64, n.sum())
            bits = np.unpackbits(each.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            over, has = np.zeros((len(n), 64), np.uint8), np.flatnonzero(n)
            if len(has):
                starts = np.cumsum(n[has]) - n[has]
                over[has] = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > n[has][:, None]
            fp = np.packbits(over, axis=1, bitorder="little").view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fp)], [*names, "fp"])

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("fp", "long")
    return docs.mapInArrow(run, schema)


def block_masks(bits: int) -> list[int]:
    """Masks, signed, of every choice of BLOCKS - bits blocks."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """(fp) distinct to (a, b): links whose components are those of all pairs at `bits` or fewer differing bits."""
    if bits > 2:
        raise ValueError("large groups are linked through single-bit neighbours, which reach two bits")
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(block_masks(bits))))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    sizes = keyed.groupBy("choice", "key").count().where("count > 1")
    grouped = scratch.table(keyed.join(sizes, ["choice", "key"]))
    small = grouped.where(F.col("count") <= GROUP)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    a, b = (small.select("choice", "key", F.col("fp").alias(c)) for c in "ab")
    pairs = a.join(b, ["choice", "key"]).where(F.col("a") < F.col("b")).where(near).select("a", "b")
    flips = [0, *(1 << i if i < 63 else -(1 << 63) for i in range(64))]
    hubs = (
        grouped.where(F.col("count") > GROUP).select("fp").distinct()
        .select("fp", F.explode(F.transform(F.array(*(F.lit(x).cast("long") for x in flips)), lambda m: F.col("fp").bitwiseXOR(m))).alias("hub"))
        .groupBy("hub").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("members"))  # 65 members at most
        .where(F.size("members") > 1).select("a", F.explode("members").alias("b")).where("a <> b").where(near)
    )
    return pairs.union(hubs)


def _rooted(each: DataFrame, bits: int, scratch: Scratch, further=lambda found: found) -> DataFrame:
    """(fp, root) of every distinct fingerprint. further: adds to the links."""
    fps = scratch.table(each.select("fp").distinct())
    roots = connected_components(further(links(fps, bits, scratch)), scratch)
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, fp long, component_id): the least id reachable through linked fingerprints."""
    scratch = scratch or Scratch(docs.sparkSession)
    each = scratch.table(fingerprints(docs.select("doc_id", "text"), shingle))
    rooted = each.groupBy("fp").agg(F.min("doc_id").alias("first")).join(_rooted(each, bits, scratch), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return each.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that stand first, by id (null last) and text hash, in their component; of repeated rows one.

    Linked are fingerprints at `bits` or fewer differing bits, and all texts whose sets of shingles have a Jaccard
    similarity of 0.8 or more (similar.py)."""
    scratch = scratch or Scratch(docs.sparkSession)
    order = {"_did": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "_hash": F.xxhash64("text")}
    texts = docs.select("text", *(c.alias(n) for n, c in order.items()))
    each = scratch.table(fingerprints(texts, shingle))
    # Equal texts are one: their sets are equal.
    firsts = each.groupBy("_hash").agg(F.min("_did").alias("doc_id"), F.min("fp").alias("fp")).withColumnRenamed("_hash", "hash")
    texts = texts.select(F.col("_did").alias("doc_id"), F.col("_hash").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    further = lambda found: similar_links(texts, firsts, shingle, found, scratch)
    first = each.groupBy("fp").agg(F.min(F.struct("_did", "_hash")).alias("first")).join(_rooted(each, bits, scratch, further), "fp")
    keepers = first.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    return docs.withColumns(order).join(keepers, list(order), "left_semi").dropDuplicates(list(order)).drop(*order)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(id_text(read(spark, sf_dir, "documents")), shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
