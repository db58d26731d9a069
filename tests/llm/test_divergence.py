"""The audit against plain loops, at any size of blocks and chunks, and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from fixtures_docs import odd_documents
from pyspark.sql import functions as F

from corvane.llm.divergence import OP13_SQL, PairCounts, divergence, scan, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plainly(rows, top=200):
    """From (text, lang, source), every cell of terms and sources looked at."""
    df, counts, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lower(text))
        counts[lang, source].update(terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= 3)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        by_source = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            p = by_source[s]
            pairs = [(sum((p[t] - by_source[o][t]) ** 2 // by_source[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def some_rows(n=300):
    chance = random.Random(8)
    words = ["the", "The", "ÉTÉ", "été", "x", "don't", "a1b", "漢字", "🙂", "ſ", "K", "straße", *(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90))]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(chance.choices(words, weights, k=chance.choice([0, 1, 5, 60]))) for _ in range(n)]
    return [(t, chance.choice(["en", "fr", None, ""]), chance.choice(["s1", "s2", "S10", None, "é"])) for t in texts]


def got(df, **more):
    return sorted(tuple(r) for r in divergence(df, **more).collect())


def test_equals_plain_loops(spark):
    rows = some_rows() + [(None, "de", "empty"), ("once only", "de", "s1"), ("", "it", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    want = plainly(rows)
    assert got(df) == want
    assert got(df, block_bytes=300, chunk_rows=7) == want  # many blocks, runs and chunks
    assert got(df, top=2) == plainly(rows, top=2)


def test_all_ranges_are_cut_inside_terms(spark):
    """More parts than terms: nearly every term is open on both sides."""
    rows = [(f"hot hot w{'abc'[i % 3]}", "en", f"s{i % 9}") for i in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(spark.createDataFrame(rows, "text string, lang string, source string"), block_bytes=20) == plainly(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equals_sql(spark, tmp_path):
    df = spark.createDataFrame(some_rows(400), "text string, lang string, source string").withColumn("doc_id", F.lit(1))
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got(df) == sorted(con.sql(OP13_SQL).fetchall())


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    clashing = docs.withColumn("n", F.lit("x")).withColumn("term", F.lit("y")).withColumn("kept", F.lit(0)).withColumn("part", F.lit(None))
    assert got(clashing) == plainly([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert got(docs.limit(0)) == []


def test_terms_of_bytes():
    texts = ["", "A-b C", "é", "\x7f[`{@x", "x"]
    terms, of = terms_of([t.encode() for t in texts])
    assert list(zip(terms.to_pylist(), of.tolist())) == [("a", 1), ("b", 1), ("c", 1), ("é", 2), ("x", 3), ("x", 4)]


def test_many_sources_and_large_counts_in_one_term(monkeypatch):
    """Pairs beyond what is held at once come out in parts; counts beyond 16 bits as rows of their own."""
    monkeypatch.setattr("corvane.llm.divergence.PAIRS", 50)
    n = np.array([1, 70_000, 3, *range(1, 20)])
    pairs = PairCounts()
    out = list(pairs.add(np.arange(22), n, np.array([0]), np.array([22]))) if pairs.ids.update({("l", f"s{i}"): i for i in range(22)}) is None else []
    rows = [r for b in [*out, *pairs.rest()] for r in b.to_pylist()]
    assert Counter((r["source"], r["other"], r["n"], r["total"]) for r in rows for _ in range(r["m"])) == Counter(
        (f"s{i}", f"s{j}", int(n[i]), int(n[j])) for i in range(22) for j in range(i + 1, 22)
    )


def test_a_term_longer_than_a_chunk_stays_whole():
    rows = [("en", "a", "s", 1, 1), *(("en", "b", f"s{i:03}", 1, 2) for i in range(50) for _ in range(4)), ("en", "c", "s", 9, 9)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "docs", "n"), r)) for r in rows[i : i + 10]]) for i in range(0, len(rows), 10)]
    out = [r for b in scan(3, 20)(iter(batches)) for r in b.to_pylist()]
    assert [(r["term"], r["n"]) for r in out if r["kind"] == "open"] == [("a", 1), ("c", 9)]
    kept = [r for r in out if r["kind"] == "term"]
    assert len(kept) == 50 and {(r["n"], r["total"]) for r in kept} == {(8, 400)} and sum(r["m"] for r in kept) == 1
    assert sum(r["m"] for r in out if r["kind"] == "pair") == 50 * 49 // 2
