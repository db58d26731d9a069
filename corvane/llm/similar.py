"""Links between documents whose sets of word shingles have a Jaccard similarity of SIMILAR or more: an exact join.

The shingles of a set are ordered by the number of texts that hold them, then by hash; two sets that similar share one
of the first n - ceil(SIMILAR * n) + 1 of each (prefix filter), and where they first meet, at places p and q, no more
than min(n - p, m - q) shingles are in both (positional filter). Blocks and buckets (blocks.py) count the texts, so only
sets whose rare shingles stand in other texts too leave their block, and each leaves once with the shingles that others
hold. Sets that share such a shingle are compared where sizes and places leave room.

Large groups of near copies are not paired: for each of its shingles a set is compared with one hub, first the set with
the least part of rare shingles (of near copies the one that is edited least), then one at random, and what is linked by
then counts as one. Pairs are built of what is left, sets not yet linked, so no link is lost. Groups of over GROUP
unlinked sets under one shingle are dealt by a salt; each pair still meets once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.blocks import PACKED, answer, blocked, pack, packed_table, rows_of, settle, unpack
from corvane.llm.common import Scratch, give_back, slices
from corvane.llm.components import connected_components
from corvane.llm.quality import Texts
from corvane.llm.segments import mix, segment_hashes

SIMILAR = (4, 5)  # as a fraction: 0.8
ROUNDS = 2
GROUP = 256


def shingle_sets(rows: pa.Table, shingle: int) -> list[np.ndarray]:
    """The hashes of the distinct word shingles of each row, A-Z in lower case; a shorter text is one shingle."""
    out = []
    for batch in slices(rows.select(["text"]).to_batches()):
        texts = Texts([(t or "").encode("utf-8", "replace").lower().decode() for t in batch.column("text").to_pylist()])
        of, begins = texts.word_text, np.searchsorted(texts.word_text, np.arange(texts.n + 1))
        start = np.arange(len(of))
        end = np.minimum(start + shingle, begins[of + 1])
        whole = (end - start == shingle) | (start == begins[of])
        hashes, of = segment_hashes(texts.word_hash, start[whole], end[whole]), of[whole]
        cuts = np.searchsorted(of, np.arange(texts.n + 1)).tolist()
        out += [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]
    return out


def _distinct(sets: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct shingles, in how many rows each stands, their order by bucket, and where each bucket begins."""
    keys, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return keys, times, order, np.searchsorted(bucket[order], np.arange(n + 1))


def prefix_size(n: int) -> int:
    """How many of n shingles in order hold one that any set as similar shares."""
    a, b = SIMILAR
    return n - (n * a + b - 1) // b + 1


def candidates(texts: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hash, text) and (doc_id, hash, fp), where each distinct text stands first, to (fp, sid, n int, shared
    array<long>, prefix array<struct<key: long, place: int>>): a row for each text whose prefix holds a shingle of another
    text. shared: its shingles that other texts hold; n: how many in all."""
    key = F.xxhash64("doc_id", "hash")
    base, n = blocked(texts.select("doc_id", "text", "hash"), by=key)
    firsts = firsts.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), "doc_id", "hash", "fp").repartition(n, "block")

    def which(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return packed_table([])
        rows, block = rows_of(left), left["block"][0].as_py()
        first = dict(zip(zip(right["doc_id"].to_pylist(), right["hash"].to_pylist()), right["fp"].to_pylist()))
        hashes = pc.struct_field(rows["rest"].combine_chunks(), "hash").to_pylist()
        found = [first.pop(k, None) for k in zip(rows["doc_id"].to_pylist(), hashes)]  # of repeated rows one
        at = np.array([i for i, fp in enumerate(found) if fp is not None], np.int32)
        keys, times, order, begins = _distinct(shingle_sets(rows.take(at), shingle), n)
        out = [(n + block, block, pack(at, np.array([fp for fp in found if fp is not None], np.int64)))]
        for b in range(n):
            mine = order[begins[b] : begins[b + 1]]
            if len(mine):
                out.append((b, block, pack(keys[mine], times[mine].astype(np.uint32))))
        give_back()
        return packed_table(out)

    def counted(questions: list[bytes]) -> list[bytes]:
        parts = [unpack(q, np.uint64, np.uint32) for q in questions]
        _, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[1] for p in parts]))[inverse].astype(np.uint32)
        ends = np.cumsum([0] + [len(p[0]) for p in parts])
        return [pack(total[a:b]) for a, b in zip(ends, ends[1:])]

    def send(rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        at, fps = unpack(answers.pop(n + rows["block"][0].as_py()), np.int32, np.int64)
        sets = shingle_sets(rows.take(at), shingle)
        keys, _, order, begins = _distinct(sets, n)
        count = np.zeros(len(keys), np.uint32)
        for b, data in answers.items():
            count[order[begins[b] : begins[b + 1]]] = unpack(data, np.uint32)[0]
        out, known = [], set()
        for fp, one in zip(fps.tolist(), sets):
            if not len(one):
                continue
            times = count[np.searchsorted(keys, one)]
            first = np.lexsort((one, times))[: prefix_size(len(one))]
            at = np.flatnonzero(times[first] > 1)
            sid = int(mix(np.array([mix(one).sum(dtype=np.uint64)])).view(np.int64)[0])
            if len(at) and sid not in known:
                known.add(sid)
                prefix = [{"key": k, "place": p} for k, p in zip(one[first[at]].view(np.int64).tolist(), at.tolist())]
                out.append({"fp": fp, "sid": sid, "n": len(one), "shared": one[times > 1].view(np.int64), "prefix": prefix})
        return pa.Table.from_pylist(out, kind)

    place = pa.struct([("key", pa.int64()), ("place", pa.int32())])
    kind = pa.schema([("fp", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("shared", pa.list_(pa.int64())), ("prefix", pa.list_(place))])
    schema = "fp long, sid long, n int, shared array<long>, prefix array<struct<key: long, place: int>>"
    asked = base.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(which, PACKED)
    return settle(base, answer(asked, counted, n), send, schema)


def _fits(n: Column, p: Column, m: Column, q: Column) -> Column:
    """Whether sets of n and m shingles that first meet at places p and q may be as similar."""
    x, y = SIMILAR
    n, m = n.cast("long"), m.cast("long")
    return (n * y >= m * x) & (m * y >= n * x) & (F.least(n - p, m - q) * (x + y) >= (n + m) * x)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of sids to (a, b, fp_a, fp_b) of those that are similar."""
    x, y = SIMILAR
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("n").cast("long").alias(f"n_{c}"), F.col("shared").alias(f"shared_{c}"))
    both = F.size(F.array_intersect("shared_a", "shared_b")).cast("long")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.where(both * (x + y) >= (F.col("n_a") + F.col("n_b")) * x).select("a", "b", "fp_a", "fp_b")


def similar_links(texts: DataFrame, firsts: DataFrame, shingle: int, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Texts and where each distinct one stands first, as candidates() takes them, and links (a, b) between fingerprints
    to (a, b): the known links and further ones, whose components are those of the known links and of all pairs of texts
    that are similar."""
    found = scratch.table(candidates(texts, firsts, shingle))
    # Texts of one fingerprint are linked as it is; one set may stand under two fingerprints only by a clash of hashes.
    sets = scratch.table(found.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("fp", "n", "shared", "prefix"))))
    keyed = sets.select("sid", "fp", "n", F.explode("prefix").alias("p")).select("sid", "fp", "n", "p.key", "p.place")
    several = keyed.groupBy("key").count().where("count > 1").select("key")
    keyed = scratch.table(keyed.join(several, "key"))
    links = scratch.table(known.select("a", "b"))

    def rooted() -> DataFrame:
        """The keyed sets with their component, of keys that join several components."""
        roots = connected_components(links, scratch).withColumnRenamed("node", "fp")
        of = keyed.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")).drop("fp")
        apart = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high")
        return scratch.table(of.join(apart.select("key", "size"), "key"))

    for turn in range(ROUNDS):
        left = rooted()
        chance = F.xxhash64("sid", F.lit(turn))
        order = F.struct(F.col("place") / F.col("n"), chance) if turn == 0 else chance
        hubs = left.groupBy("key").agg(F.min_by(F.struct("sid", "root", "n", "place"), order).alias("hub"))
        met = left.join(hubs, "key").where("root <> hub.root").where(_fits(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place")))
        pairs = met.select(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).distinct()
        links = scratch.table(links.union(_similar(pairs, sets).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))))

    left = rooted()
    parts = F.ceil(F.col("size") / GROUP).cast("int")
    salt = F.pmod(F.xxhash64("sid", F.lit("salt")), parts.cast("long")).cast("int")
    spread = left.select("*", parts.alias("parts"), salt.alias("salt"))
    cells = lambda cell, other: spread.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(other)).withColumnRenamed("salt", cell)
    a, b = cells("row", "column").alias("a"), cells("column", "row").alias("b")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.column") == F.col("b.column"))
    fits = _fits(F.col("a.n"), F.col("a.place"), F.col("b.n"), F.col("b.place"))
    pairs = a.join(b, met & (F.col("a.sid") < F.col("b.sid")) & (F.col("a.root") != F.col("b.root")) & fits)
    pairs = pairs.select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()
    return links.union(_similar(pairs, sets).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
