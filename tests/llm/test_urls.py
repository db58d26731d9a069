import random

import duckdb
from pyspark.sql import functions as F

from corvane.llm import urls
from corvane.llm.common import Scratch

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/en/1", "http://xexample.org/es/", "x://b.org", "x://b.org/",
        "https://q.com/fr/1?x=/de/", "https://q.com/de/1#a", "https://com/de/", "https://ads-track.net?u=http://a.org/", "http://m.ads-track.net/a", "http://a.b\n/c\nd?e",
        "//a.org/x", "http://É.Example.com/DE/", "http://spam-farm.example.org/en/12", "http://spam-farm.example.org/es/", "http://free-bets", "twin://t.net/", "twin://t.net/"]


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], None), (5, URLS[5], "h")]
    spark.createDataFrame(rows, "page_id long, url string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in urls.op6_urls(spark, str(tmp_path)).collect()]
    pages = duckdb.read_parquet(f"{tmp_path}/pages.parquet/*.parquet")  # noqa: F841
    want = duckdb.sql(urls.OP6_SQL).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[4] for r in got} == {"allow", "block"} and len({r[3] for r in got}) == 6


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    rng = random.Random(6)
    keys = [f"k{rng.random()}" for _ in range(3000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys * 2)], "key string, n long")
    listed = F.xxhash64("key") % 5 == 0
    for most in (urls.MAX_BITS, 1500):  # the second is too few for one cascade
        monkeypatch.setattr(urls, "MAX_BITS", most)
        got = urls.with_membership(df, "key", listed, Scratch(spark)).withColumn("want", listed)
        assert got.where("listed <> want").count() == 0 and got.count() == 6000
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    universe = urls._hashed(df.select("key").distinct().withColumn("listed", listed), "key")
    assert urls.shards_of(universe) > 2
    cascade = urls.build_cascade(universe, Scratch(spark))
    assert len(cascade.levels) >= 3 and sum(bits for bits, _, _ in cascade.levels) < 1500 * urls.shards_of(universe)


def test_empty_and_unlisted(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert urls.judge_urls(one).head().verdict == "allow"
