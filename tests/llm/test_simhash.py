import random
import re

import xxhash
from fixtures_docs import ODD, documents, odd_documents

from corvane.llm import simhash
from corvane.llm.common import Scratch, id_text
from corvane.llm.components import connected_components


def brute_fp(text, n=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_texts(rng, n):
    base = [" ".join(rng.choice(["ab", "Cd", "ef", "gh", "ij"]) for _ in range(150)) for _ in range(6)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 4])):
            words[rng.randrange(len(words))] = rng.choice(["zz", "yy", "xx"])
        out.append(" ".join(words))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = ODD[:-1] + near_texts(random.Random(1), 150) + [ODD[-1]]
    df = documents(spark, texts)
    df.union(df.where("doc_id = 3")).write.parquet(f"{tmp_path}/documents.parquet")
    fps = [brute_fp(t) for t in texts]
    rows = simhash.op4_simhash(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    want = components(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, want))}


def test_large_groups_keep_every_link(spark, monkeypatch):
    rng = random.Random(4)
    fps = list({x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in [rng.getrandbits(64) for _ in range(4)] for _ in range(60)})
    monkeypatch.setattr(simhash, "GROUP", 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, scratch)
    roots = {r.node: r.root for r in connected_components(edges, scratch).collect()}
    want = components(fps)
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, set()).add(f)
    assert {min(g): len(g) for g in groups.values()} == {min(g): sum(roots.get(f, f) == min(g) for f in g) for g in groups.values()}


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(id_text(documents(spark, []))).count() == 0
    df = spark.createDataFrame([(None, "a b"), (7, "a b"), (None, "quite another text")], "doc_id long, text string")
    assert sorted(r.component_id or -1 for r in simhash.near_duplicates(df).collect()) == [-1, 7, 7]


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges, Scratch(spark)).collect()}
    assert roots == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
