"""URL filters: rules by host and path, then exact membership of the host in a list by a Bloom filter cascade.

The first filter of a cascade encodes the listed keys, the second those unlisted keys of the corpus that pass it, the
third the listed keys that pass the second, and so on, until no key passes wrongly. Over the key universe that it was
built from, a cascade answers exactly, and no row is joined. Each level's bits are set by a Spark aggregate. Keys are
dealt by their hash over as many cascades as keep each under about MAX_BITS, which bounds what the driver gathers and a
task holds; each judges the rows of its own keys.

Cases: a null url, or one without "://", has an empty host and path, which no rule fits. Null ids stay null; repeated
rows are judged each; ties between rules cannot occur, as rules differ. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, read

MAX_BITS = 1 << 28  # of a cascade, about: 32 MB in every task
#: Rule, verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: A host that has one of these labels is listed.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as text; null where none does."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


@dataclass
class Cascade:
    """levels: (number of bits, number of probes, 64-bit words)."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def add(self, bits: int, probes: int, words: np.ndarray) -> None:
        self.levels.append((bits, probes, words))

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, probes, words = self.levels[level]
        out = np.ones(len(h1), bool)
        for at in positions(level, bits, probes, h1, h2):
            out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        member, live = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in range(len(self.levels)):
            live = live[self.passes(level, h1[live], h2[live])]
            member[live] = level % 2 == 0
        return member


def positions(level: int, bits: int, probes: int, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
    for j in range(probes):
        yield (h1 + np.uint64(level * 64 + j) * (h2 | np.uint64(1))) % np.uint64(bits)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"_h1": F.xxhash64(F.lit(1), key), "_h2": F.xxhash64(F.lit(2), key)})


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy().view(np.uint64) for c in ("_h1", "_h2"))


def _words(include: DataFrame, level: int, bits: int, probes: int) -> np.ndarray:
    """The level's bits, set by the keys' positions and or-ed on the executors; `bits` bounds what comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(list(positions(level, bits, probes, *_hashes(batch))))
            mask = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(mask)], ["word", "mask"])

    got = include.select("_h1", "_h2").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64 + 1, np.uint64)
    words[got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return words


def _passing(df: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(cascade.passes(level, *_hashes(batch))))

    return df.mapInArrow(run, df.schema)


def rate_of(listed: int, others: int) -> float:
    """Of the first level: it lets through about as many unlisted keys as there are listed ones."""
    return min(0.5, max(listed, 1) * math.sqrt(0.5) / max(others, 1))


def build_cascade(universe: DataFrame, scratch: Scratch) -> Cascade:
    """universe: (_h1, _h2, listed boolean), each key once."""
    include, exclude = universe.where("listed").select("_h1", "_h2"), universe.where("not listed").select("_h1", "_h2")
    n, others, cascade = include.count(), exclude.count(), Cascade()
    while n:
        rate = 0.5 if cascade.levels else rate_of(n, others)  # later levels halve
        probes, level = max(1, round(math.log2(1 / rate))), len(cascade.levels)
        bits = 64 + math.ceil(n * probes / math.log(2))
        cascade.add(bits, probes, _words(include, level, bits, probes))
        include, exclude = scratch.table(_passing(exclude, cascade, level)), include
        n = include.count()
    return cascade


def shards_of(universe: DataFrame) -> int:
    """How many cascades hold the universe. Levels after the first take about three times the listed keys in bits."""
    size = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("others")).head()
    probes = max(1, round(math.log2(1 / rate_of(size.listed, size.others))))
    return max(1, math.ceil(size.listed * (probes / math.log(2) + 5) / MAX_BITS))


def with_membership(df: DataFrame, key: str, listed: Column, scratch: Scratch) -> DataFrame:
    """Adds `listed`: whether the row's key is a listed one. `listed` tells that of a column named key."""
    universe = scratch.table(_hashed(df.select(F.col(key).alias("key")).distinct().withColumn("listed", listed), "key"))
    names, hashed = df.columns, _hashed(df, key)
    shards = shards_of(universe)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def judged(cascade: Cascade) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pa.array(cascade.contains(*_hashes(batch)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], [*names, "listed"])

        return run

    mine = lambda rows, shard: rows.where(F.pmod("_h1", F.lit(shards)) == shard) if shards > 1 else rows
    parts = [mine(hashed, i).mapInArrow(judged(build_cascade(mine(universe, i), scratch)), f"{fields}, listed boolean") for i in range(shards)]
    return reduce(DataFrame.union, parts)


def judge_urls(pages: DataFrame, rules=RULES, blocked_labels=BLOCKED_LABELS) -> DataFrame:
    """(page_id, url, ...) to (page_id, host, path, rule, verdict)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, blocked_labels)))
    judged = with_membership(rows, "host", listed, Scratch(pages.sparkSession)).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op6_urls(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))


def _oracle() -> str:
    fits = [
        f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda r: -len(r[0]))
    ]
    labels = ", ".join(f"'{x}'" for x in BLOCKED_LABELS)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), ruled AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)}
            WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


OP6_SQL = _oracle()
