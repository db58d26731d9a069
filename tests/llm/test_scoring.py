import math
import random
from collections import Counter

import pytest
from fixtures_docs import ODD, documents
from pyspark.sql import functions as F

from corvane.llm import blocks, scoring
from corvane.llm.common import id_text


def brute(docs, good):
    words = [(i, split(t or "")) for i, t in docs]
    total, target, pairs, target_pairs = Counter(), Counter(), Counter(), Counter()
    for i, ws in words:
        total.update(ws)
        pairs.update(zip(ws, ws[1:]))
        target.update(ws if i in good else [])
        target_pairs.update(zip(ws, ws[1:]) if i in good else [])
    n, n_all = sum(target.values()), sum(total.values())
    models = [(1, target, target_pairs), (n / n_all, total, pairs)]
    out = []
    for i, ws in words:
        losses = []
        for scale, c, cc in models:
            loss = 0
            for j, w in enumerate(ws):
                p = (1 - scoring.SHARE) * c[w] * scale / n + scoring.SHARE * total[w] / n_all
                if j:
                    p = (cc[ws[j - 1], w] * scale + scoring.STRENGTH * p) / (c[ws[j - 1]] * scale + scoring.STRENGTH)
                loss -= math.log(p)
            losses.append(loss / len(ws) if ws else None)
        out.append((i, len(ws), *losses))
    return out


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "total_bytes", lambda df: 1 << 27)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choices("abcdefghi", weights=range(27, 0, -3), k=rng.randint(1, 60))) + f" x{i}" for i in range(60)]
    df = documents(spark, texts)
    df = df.union(df.where("doc_id = 12")).union(df.where("doc_id = 13").withColumn("doc_id", F.lit(None).cast("long")))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(40)] + [(15, 0, None), (None, 1, 0), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = {i for i in range(40) if i % 2 and i % 7}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(brute(docs, good), key=order)
    got = sorted((tuple(r)[:4] for r in scoring.op1_scoring(spark, str(tmp_path)).collect()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2]
        assert g[2:] == (None, None) if w[2] is None else g[2:] == pytest.approx(w[2:], rel=1e-9)


def test_like_the_target_scores_lower(spark):
    texts = ["sun moon star sky " * 20 if i % 2 else "mud dirt rust dust " * 20 for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = scoring.score(id_text(documents(spark, texts)), labels).collect()
    assert max(r.score for r in rows if r.doc_id % 2) < 0 < min(r.score for r in rows if r.doc_id % 2 == 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert scoring.score(id_text(documents(spark, [])), none).count() == 0
    assert {r.score for r in scoring.score(id_text(documents(spark, ["a b", "", "c"])), none).collect()} == {0.0, None}
