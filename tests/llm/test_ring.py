"""The ring against rows that walk it one by one, and what balance and little movement mean."""

import hashlib
import zlib
from collections import Counter

import duckdb
from fixtures_docs import documents, odd_documents
from pyspark.sql import functions as F

from corvane.llm.ring import OP11_SQL, fill, op11_sharding, ring, rooms, shard_rows


def position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def walked(ids, shards, points, slack=0.0):
    """By rounds, row by row: every waiting row walks from its hash to the first point with room when the round began."""
    spots = sorted((position(f"{s}:{i}"), s) for s in range(shards) for i in range(points))
    n = len(ids)
    room = [int((n // shards + (s < n % shards)) * (1 + slack)) for s in range(shards)]
    waiting, out = [], {}
    for i in ids:
        arc = next((k for k, (p, _) in enumerate(spots) if p >= position(f"key:{i}")), 0)
        waiting.append((arc, i))
    waiting.sort()
    while waiting:
        free, still = [r > 0 for r in room], []
        for arc, i in waiting:
            k = arc
            while not free[spots[k][1]]:
                k = (k + 1) % len(spots)
            shard = spots[k][1]
            if room[shard]:
                room[shard] -= 1
                out[i] = shard
            else:
                still.append((arc, i))
        waiting = still
    return out


def test_rows_go_where_walking_leads(spark):
    ids = list(range(700))
    docs = spark.createDataFrame([(i, "x" * (i % 9)) for i in ids], "doc_id long, text string")
    for slack in (0.0, 0.1):
        got = {r["doc_id"]: r for r in shard_rows(docs, 7, points=5, slack=slack).collect()}
        assert {i: r["shard"] for i, r in got.items()} == walked(ids, 7, 5, slack)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(OP11_SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in op11_sharding(spark, sf).drop("grown_shard").withColumn("grown_shard", F.lit(0)).collect()) == sorted(
        tuple(0 if n == "grown_shard" else v for n, v in zip(names, r)) for r in want.fetchall()
    )


def test_counts_slots_and_checksums(spark):
    texts = [f"ü{i % 50}" * (i % 13) for i in range(1003)]
    got = shard_rows(documents(spark, texts), 40).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == 1003 and max(counts.values()) - min(counts.values()) == 1 and len(counts) == 40
    assert Counter((r["shard"], r["slot"]) for r in got) == Counter((s, k) for s, n in counts.items() for k in range(n))
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 16 for r in got)


def test_one_id_of_a_third_of_the_rows_is_numbered_in_parts(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    got = shard_rows(docs, 8, points=16, arc_rows=50).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts.values()) == {375}
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(8) for k in range(375)]


def test_two_runs_place_rows_alike(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    one, two = (sorted(map(tuple, shard_rows(docs.repartition(n), 8, points=4, arc_rows=20).collect())) for n in (3, 5))
    assert one == two


def test_growth_moves_little():
    """Against 1/41 of the rows, which no way of growing can undercut."""
    ids = range(20_000)

    def owners(shards):
        spots = ring(shards)
        points = [p for p, _ in spots]
        import bisect

        arcs = {}
        for i in ids:
            arcs.setdefault(bisect.bisect_left(points, position(f"key:{i}")) % len(points), []).append(i)
        runs = fill({a: len(r) for a, r in arcs.items()}, [s for _, s in spots], rooms(len(ids), shards))
        return {i: shard for arc, first, rows, shard, _ in runs for i in arcs[arc][first : first + rows]}

    before, after = owners(40), owners(41)
    assert 1 / 41 <= sum(before[i] != after[i] for i in ids) / len(ids) < 2 / 41


def test_as_few_rows_overflow_as_can(spark):
    got = shard_rows(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text")), 10, points=8).collect()
    home, room = Counter(r["home_shard"] for r in got), rooms(5000, 10)
    assert sum(r["shard"] != r["home_shard"] for r in got) == sum(max(0, home[s] - room[s]) for s in range(10))


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark).union(odd_documents(spark).withColumn("doc_id", F.lit(None).cast("long")))
    clashing = docs.withColumn("shard", F.lit("x")).withColumn("arc", F.lit("y")).withColumn("_part", F.lit(0))
    got = shard_rows(clashing, 3, points=4).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [7, 7, 8]
    assert sum(r["doc_id"] is None for r in got) == 11 and all(r["text_crc32"] is not None for r in got)
    assert shard_rows(docs.limit(0), 3).count() == 0
