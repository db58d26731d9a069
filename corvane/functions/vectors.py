"""Expressions over score vectors held as array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def softmax(logits: Column) -> Column:
    powers = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(powers, lambda v: v / total(powers))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    norm = F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    return F.transform(logits, lambda v: v - top - norm)


def argmax(values: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def scaled(values: Column, weight: Column | float) -> Column:
    return F.transform(values, lambda v: v * weight)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def top_k(values: Column, k: int) -> Column:
    """array<struct<prob, idx>> of the k largest values; ties by place."""
    if k < 1:
        raise ValueError("k is 1 at least")
    pairs = F.transform(values, lambda v, i: F.struct((-v).alias("neg"), i.cast("long").alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct((-s["neg"]).alias("prob"), s["idx"].alias("idx")))


def class_at(names: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (idx + 1).cast("int"))


def micro(value: Column) -> Column:
    """Millionths, rounded half up: a form of a double that engines agree on."""
    return F.floor(value * 1e6 + 0.5).cast("long")
